"""Samples as an aligner writes them, made from the order tables and read back: the readers' registered queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis import highly_variable_events, pseudo_correlation, result
from ..container import CountSet, event_pairs, make_exclusion, validation_report
from ..functions import shared_folder, spread, staged, with_index
from ..sources import read_genes, read_junctions, read_velocity
from .proxy import events_and_counts, junction_reads, libraries, table
from .queries import COX_SNELL, EVENTS, LIBRARY, query

SAMPLES = ("s0", "s1")


#: Lines of a file that one task sorts, and inclusion counts of a set for which there are 16 buckets.
LINES, BUCKETED = 2_000_000, 10_000_000


def write_file(rows: DataFrame, path: str, n: int | None = None) -> None:
    """Rows (place, value), n in all, as the lines of one file, in order; one file is what an aligner writes. Many are sorted by
    ranges, each in a task and a file of its own, which one task then copies one after the other, line by line."""
    spark, part = rows.sparkSession, f"{path}.parts"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = lambda folder: sorted(str(s.getPath()) for s in fs.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-"))
    ranges = 1 + (rows.count() if n is None else n) // LINES
    if ranges == 1:
        rows.coalesce(1).sortWithinPartitions("place").select("value").write.text(part)
    else:
        rows.repartitionByRange(ranges, "place").sortWithinPartitions("place").select("value").write.text(f"{part}/ranges")
        reduce(DataFrame.unionAll, [spark.read.text(f) for f in files(f"{part}/ranges")]).coalesce(1).write.mode("append").text(part)
    fs.rename(hadoop.Path(files(part)[0]), hadoop.Path(path))
    fs.delete(hadoop.Path(part), True)


def write_lists(rows: DataFrame, fields: list[str], path: str) -> None:
    write_file(rows.select(F.col("place"), F.concat_ws("\t", *fields).alias("value")), path)


def write_matrix(rows: DataFrame, shape: tuple[int, int], path: str, more: str = "general") -> None:
    """A MatrixMarket file of rows (row, col from 0, value)."""
    rows = staged(rows)
    n = rows.count()
    head = rows.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix coordinate real {more}"), (1, "% counts"), (2, f"{shape[0]} {shape[1]} {n}")], "place long, value string")
    body = rows.select((F.lit(3) + F.col("row")).alias("place"), F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "value").alias("value"))
    write_file(head.unionByName(body), path, n)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    return with_index(rows, order, "place")


def cells_of(spark: SparkSession, sf_dir: str, sample: str) -> DataFrame:
    """(cell, barcode, place): suppliers of the sample, in order."""
    rows = table(spark, sf_dir, "supplier").where(F.expr("concat('s', s_nationkey % 2)") == sample)
    return numbered(rows.select(F.col("s_suppkey").alias("cell"), F.concat(F.lit("ACGT"), "s_suppkey").alias("barcode"), "s_acctbal", "s_nationkey"), ["cell"])


def write_junctions(spark: SparkSession, sf_dir: str) -> str:
    """Two samples of junctions; of a junction, reads of other flags than R are unique ones."""
    base = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    reads = staged(junction_reads(spark, sf_dir).withColumn("chr", F.concat_ws(".", "chr", "code")))  # a name has no strand
    for sample in SAMPLES:
        cells = cells_of(spark, sf_dir, sample)
        own = reads.join(cells.select(F.col("cell").alias("cell_idx"), F.col("place").alias("col")), "cell_idx")
        key = ["chr", "start", "end", "code"]
        found = numbered(own.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("unique"), F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("annot")), key)
        solo = f"{base}/{sample}/Solo.out/SJ/raw"
        write_lists(cells, ["barcode"], f"{solo}/barcodes.tsv")
        write_lists(found, ["chr", "start", "end", "code", F.expr("start % 3"), "annot", "unique", F.expr("n - unique"), F.lit(9)], f"{base}/{sample}/SJ.out.tab")
        counts = own.join(found.select(*key, F.col("place").alias("row")), key).groupBy("row", "col").agg(F.sum("value").cast("long").alias("value"))
        write_matrix(counts, (found.count(), cells.count()), f"{solo}/matrix.mtx")
        write_lists(cells.where("s_acctbal > 0"), ["barcode"], f"{base}/{sample}/listed.tsv")
    return base


def junction_set(spark: SparkSession, sf_dir: str, **how) -> CountSet:
    base = write_junctions(spark, sf_dir)
    lists = [f"{base}/{s}/listed.tsv" for s in SAMPLES]
    return read_junctions(spark, [f"{base}/{s}/Solo.out/SJ" for s in SAMPLES], SAMPLES, barcode_whitelists=lists, **how)


#: The same from the tables: `least` is the bound on an event's counts, `kept` which junctions of a sample stay.
_SET = """WITH own AS (SELECT 's' || (s_nationkey % 2) AS sample, s_acctbal, p_brand || '.' || CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS chr, CAST(floor(p_size / 5) AS BIGINT) AS "start", CAST(l_linenumber AS BIGINT) AS "end",
  CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_suppkey AS cell, CAST(l_quantity AS BIGINT) AS value, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
rows AS (SELECT sample, chr, "start", "end", strand, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS annot, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS uniq FROM own GROUP BY ALL HAVING {kept}),
junctions AS (SELECT chr, "start", "end", strand, CAST(max(annot) AS INT) AS is_annot, CAST(max(uniq) AS BIGINT) AS unique_mapped, CAST("start" % 3 AS INT) AS intron_motif FROM rows GROUP BY chr, "start", "end", strand),
sized AS (SELECT *, count(*) OVER (PARTITION BY chr, "start", strand) AS ns, count(*) OVER (PARTITION BY chr, "end", strand) AS ne FROM junctions),
events AS (SELECT *, 'S' AS kind, 'S' || chr || '|' || "start" || strand AS gkey FROM sized WHERE ns > 1 UNION ALL SELECT *, 'E', 'E' || chr || '|' || "end" || strand FROM sized WHERE ne > 1),
m1 AS (SELECT kind, e.chr, e."start", e."end", e.strand, gkey, cell, sample, sum(value) AS value FROM events e JOIN own o USING (chr, "start", "end", strand) SEMI JOIN rows USING (sample, chr, "start", "end", strand) WHERE s_acctbal > 0 GROUP BY ALL),
passed AS (SELECT e.* FROM events e LEFT JOIN (SELECT kind, chr, "start", "end", strand, sum(value) AS t FROM m1 GROUP BY ALL) USING (kind, chr, "start", "end", strand) WHERE coalesce(t, 0) >= {least}),
final AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY gkey) AS members FROM passed) WHERE members > 1 OR {least} = 0)"""
_NAME = """chr || ':' || "start" || '-' || "end" || '_' || kind AS name, strand"""


def _set_sql(kept: str, least: int) -> str:
    return _SET.replace("{kept}", kept).replace("{least}", str(least))


@query(_set_sql("uniq > 0", 20) + f" SELECT {_NAME}, kind AS group_kind, CAST(members AS INT) AS group_count, is_annot, unique_mapped, intron_motif FROM final")
def read_junction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two samples' files: strands decoded, multi-mapped ones dropped, united, grouped, min_counts, grouped again."""
    var = junction_set(spark, sf_dir, min_counts=20).var
    return var.select("name", "strand", "group_kind", "group_count", *[F.col(c).cast(k).alias(c) for c, k in (("is_annot", "int"), ("unique_mapped", "long"), ("intron_motif", "int"))])


@query(_set_sql("true", 0) + f" SELECT {_NAME}, 'ACGT' || cell || '-' || sample AS cell, CAST(value AS DOUBLE) AS value FROM m1")
def read_junction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion counts of the listed cells by names of events and cells, with multi-mapped junctions, saved and loaded."""
    found = junction_set(spark, sf_dir, keep_multi_mapped=True, min_counts=0)
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    found.save(path)
    return named(CountSet.load(spark, path), "M1")


@query(_set_sql("uniq > 0", 20) + f""", pairs AS (SELECT e.*, t.cell, t.sample, t.total - coalesce(m.value, 0) AS m2 FROM final e JOIN (SELECT gkey, cell, any_value(sample) AS sample, sum(value) AS total FROM m1 SEMI JOIN final USING (kind, chr, "start", "end", strand) GROUP BY gkey, cell) t USING (gkey)
  LEFT JOIN m1 m ON m.kind = e.kind AND m.chr = e.chr AND m."start" = e."start" AND m."end" = e."end" AND m.strand = e.strand AND m.cell = t.cell)
SELECT {_NAME}, 'ACGT' || cell || '-' || sample AS cell, CAST(m2 AS DOUBLE) AS value FROM pairs WHERE m2 <> 0""")
def read_junction_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion counts of the set that was read."""
    return named(make_exclusion(junction_set(spark, sf_dir, min_counts=20)), "M2")


@query(_set_sql("uniq > 0", 20) + f""", mine AS (SELECT m.* FROM m1 m SEMI JOIN final USING (kind, chr, "start", "end", strand)), totals AS (SELECT gkey, sample, cell, sum(value) AS total FROM mine GROUP BY ALL)
SELECT t.sample AS library, CAST(sum(t.total) AS DOUBLE) AS m1, CAST(sum(t.total * (n.members - 1)) AS DOUBLE) AS m2
FROM totals t JOIN (SELECT gkey, any_value(members) AS members FROM final GROUP BY gkey) n USING (gkey) GROUP BY t.sample""")
def read_junction_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both counts of a set side by side, by its sample column, added up."""
    pairs = event_pairs(make_exclusion(junction_set(spark, sf_dir, min_counts=20)), "sample_id")
    return pairs.groupBy("library").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))


def named(found: CountSet, layer: str) -> DataFrame:
    joined = found.layers[layer].join(found.var.select("feature_idx", "name", "strand"), "feature_idx").join(found.obs.select("cell_idx", "cell"), "cell_idx")
    return joined.select("name", "strand", "cell", "value")


def genes(spark: SparkSession, sf_dir: str, sample: str) -> DataFrame:
    """(l_partkey, place): the parts that the sample counts, the last first."""
    own = table(spark, sf_dir, "lineitem").join(cells_of(spark, sf_dir, sample).select(F.col("cell").alias("l_suppkey")), "l_suppkey").select("l_partkey").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("concat(p_type, if(p_partkey % 7 = 0, '-1', ''))").alias("symbol"))
    return numbered(own.join(parts, "l_partkey").withColumn("back", -F.col("l_partkey")), ["back"])


def write_genes(spark: SparkSession, sf_dir: str, velocity: bool = False, layouts: bool = False) -> str:
    """Two samples of genes; of velocity counts the first has its layers apart and the second stacked; of layouts the first has
    a second raw matrix of twice the counts, and the second a filtered one of the listed cells."""
    base = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    for sample in SAMPLES:
        cells, own = cells_of(spark, sf_dir, sample), genes(spark, sf_dir, sample)
        rows = table(spark, sf_dir, "lineitem").join(cells.select(F.col("cell").alias("l_suppkey"), F.col("place").alias("col")), "l_suppkey").join(own.select("l_partkey", F.col("place").alias("row")), "l_partkey")
        block = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("block")
        counts = staged(rows.groupBy("row", "col", *([block] if velocity else [])).agg(F.sum("l_quantity").cast("long").alias("value")))
        n, m = own.count(), cells.count()
        raw = f"{base}/{sample}/Solo.out/{'Velocyto' if velocity else 'Gene'}/raw"
        write_lists(cells, ["barcode"], f"{raw}/barcodes.tsv")
        write_lists(own, ["l_partkey", "symbol", F.lit("Gene Expression")], f"{raw}/features.tsv")
        write_lists(cells.where("s_acctbal > 0"), ["barcode"], f"{base}/{sample}/Solo.out/Gene/filtered/barcodes.tsv")
        write_lists(cells.withColumn("place", F.col("place") + 1).where("s_acctbal > 5000"), [F.concat_ws(",", "barcode", F.lit(1), "s_nationkey", "cell", "s_acctbal", F.lit(0.5))], f"{base}/{sample}/positions.csv")
        if not velocity:
            write_matrix(counts, (n, m), f"{raw}/matrix.mtx")
            if layouts and sample == "s0":
                write_matrix(counts.withColumn("value", 2 * F.col("value")), (n, m), f"{raw}/UniqueAndMult-EM.mtx")
            elif layouts:
                kept = numbered(cells.where("s_acctbal > 0").select("cell", F.col("place").alias("col")), ["cell"]).select("col", "place")
                filtered = f"{base}/{sample}/Solo.out/Gene/filtered"
                write_lists(own, ["l_partkey", "symbol", F.lit("Gene Expression")], f"{filtered}/features.tsv")
                write_matrix(counts.join(kept, "col").select("row", F.col("place").alias("col"), "value"), (n, kept.count()), f"{filtered}/matrix.mtx")
        elif sample == "s0":
            for i, layer in enumerate(("spliced", "unspliced", "ambiguous")):
                write_matrix(counts.where(F.col("block") == i).drop("block"), (n, m), f"{raw}/{layer}.mtx")
        else:
            write_matrix(counts.select((F.col("block") * n + F.col("row")).alias("row"), "col", "value"), (3 * n, m), f"{raw}/matrix.mtx")
    return base


_GENES = """WITH own AS (SELECT 's' || (s_nationkey % 2) AS sample, s_acctbal, s_nationkey, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
seen AS (SELECT l_partkey, min(sample) AS sample FROM own GROUP BY l_partkey),
ordered AS (SELECT l_partkey, p_type || CASE WHEN p_partkey % 7 = 0 THEN '-1' ELSE '' END AS symbol, row_number() OVER (ORDER BY sample, l_partkey DESC) AS feature FROM seen JOIN part ON p_partkey = l_partkey),
nth AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feature) - 1 AS k FROM ordered),
names AS (SELECT l_partkey, CASE WHEN k = 0 THEN symbol ELSE symbol || '-' || (k + CASE WHEN symbol || '-1' IN (SELECT symbol FROM ordered) THEN 1 ELSE 0 END) END AS name FROM nth)"""


@query("""WITH own AS (SELECT 's' || (s_nationkey % 2) AS sample, s_acctbal, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT CAST(l_partkey AS VARCHAR) AS gene, 'ACGT' || l_suppkey || '-' || sample AS cell, CAST(sum(value) AS DOUBLE) AS value FROM own WHERE s_acctbal > 0 GROUP BY ALL""")
def read_gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene counts of two samples' files, cells by the aligner's own list."""
    base = write_genes(spark, sf_dir)
    found = read_genes(spark, [f"{base}/{s}" for s in SAMPLES], SAMPLES)
    joined = found.layers["X"].join(found.var.select("feature_idx", F.col("gene_id").alias("gene")), "feature_idx").join(found.obs.select("cell_idx", "cell"), "cell_idx")
    return joined.select("gene", "cell", "value")


@query("""SELECT 'ACGT' || s_suppkey || '-s' || (s_nationkey % 2) AS cell, CAST(1 AS INT) AS in_tissue, CAST(s_nationkey AS INT) AS array_row, CAST(s_suppkey AS INT) AS array_col, CAST(0.5 AS DOUBLE) AS x, CAST(s_acctbal AS DOUBLE) AS y FROM supplier WHERE s_acctbal > 5000""")
def read_gene_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the same files where tissue positions decide, which go before the aligner's list."""
    base = write_genes(spark, sf_dir)
    obs = read_genes(spark, [f"{base}/{s}" for s in SAMPLES], SAMPLES, tissue_positions=[f"{base}/{s}/positions.csv" for s in SAMPLES]).obs
    return obs.select("cell", F.col("in_tissue").cast("int").alias("in_tissue"), "array_row", "array_col", F.element_at("spatial", 1).alias("x"), F.element_at("spatial", 2).alias("y"))


@query("""WITH own AS (SELECT 's' || (s_nationkey % 2) AS sample, s_acctbal, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT CASE l_returnflag WHEN 'A' THEN 'spliced' WHEN 'N' THEN 'unspliced' ELSE 'ambiguous' END AS layer, CAST(l_partkey AS VARCHAR) AS gene, 'ACGT' || l_suppkey || '-' || sample AS cell, CAST(sum(value) AS DOUBLE) AS value FROM own WHERE s_acctbal > 0 GROUP BY ALL""")
def read_velocity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity counts of two samples' files, one with layers apart and one stacked."""
    base = write_genes(spark, sf_dir, velocity=True)
    found = read_velocity(spark, [f"{base}/{s}" for s in SAMPLES], SAMPLES)
    of = lambda n: found.layers[n].withColumn("layer", F.lit(n))
    rows = of("spliced").unionByName(of("unspliced")).unionByName(of("ambiguous"))
    joined = rows.join(found.var.select("feature_idx", F.col("gene_id").alias("gene")), "feature_idx").join(found.obs.select("cell_idx", "cell"), "cell_idx")
    return joined.select("layer", "gene", "cell", "value")


@query(_GENES + " SELECT CAST(l_partkey AS VARCHAR) AS gene, name FROM names")
def read_gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique names of genes by symbol, some of which look like numbered ones."""
    base = write_genes(spark, sf_dir)
    return read_genes(spark, [f"{base}/{s}" for s in SAMPLES], SAMPLES, use_internal_whitelist=False, var_names="gene_symbols").var.select(F.col("gene_id").alias("gene"), "name")


def event_set(spark: SparkSession, sf_dir: str) -> CountSet:
    """Events, their counts and cells with libraries as a set; names tell strands apart."""
    events, m1 = events_and_counts(spark, sf_dir)
    var = events.withColumn("name", F.concat("name", "strand")).withColumnRenamed("event_idx", "feature_idx")
    obs = libraries(spark, sf_dir).withColumnRenamed("library", "sample_id")
    return CountSet(obs, var, {"M1": m1.select(F.col("event_idx").alias("feature_idx"), "cell_idx", F.col("value").cast("double").alias("value"))})


def saved(counts: CountSet, **how) -> CountSet:
    spark = counts.obs.sparkSession
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    counts.save(path, **how)
    return CountSet.load(spark, path)


@query(COX_SNELL)
def association_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An association with two draws that is saved with its set, loaded, and read by result()."""
    counts = make_exclusion(event_set(spark, sf_dir))
    counts = counts.with_layer("M2", staged(counts.layers["M2"]))  # made once: it is fitted and saved
    cells = staged(counts.obs.groupBy().agg(F.array_sort(F.collect_list("cell_idx")).alias("cells")))
    z = spread(counts.var.select("feature_idx", "start", "end"), "feature_idx").join(F.broadcast(cells)).select("feature_idx", F.transform("cells", lambda c: ((7 * c + 3 * F.col("start") + F.col("end")) % 2).cast("double")).alias("z"))
    found = result(saved(pseudo_correlation(counts, z, n_permutations=2, seed=1)))
    events = counts.var.select(F.col("feature_idx").alias("event_idx"))
    return events.join(found.observed, "event_idx", "left").select("event_idx", (F.round("observed", 5) + 0.0).alias("observed"))


@query(f"""WITH {LIBRARY}, ranked AS (SELECT event_idx, row_number() OVER (ORDER BY deviance DESC, event_idx) AS r FROM scores)
SELECT n.event_idx, round(deviance, 5) AS sum_deviance, r IS NOT NULL AND r <= 500 AS highly_variable FROM numbered n LEFT JOIN ranked USING (event_idx) LEFT JOIN scores USING (event_idx)""")
def hve_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highly variable events of a set whose layers were saved in buckets: their join and first sums are made in place. Buckets
    grow in number, not in size."""
    found = event_set(spark, sf_dir)
    found = found.with_layer("M1", staged(found.layers["M1"]))
    held = saved(make_exclusion(found), buckets=16 * (1 + found.layers["M1"].count() // BUCKETED))
    return highly_variable_events(held, n_top=500).var.select(F.col("feature_idx").alias("event_idx"), F.round("sum_deviance", 5).alias("sum_deviance"), "highly_variable")


@query(f"""WITH {EVENTS}, items AS (SELECT e.event_idx, r.cell_idx, r.value FROM reads r JOIN numbered e USING (chr, "start", "end", strand)),
wanted AS (SELECT * FROM numbered WHERE n < 12), names AS (SELECT chr || "start" || '-' || "end" || kind AS name, count(*) AS k FROM wanted GROUP BY ALL)
SELECT 'names' AS rule, CAST(coalesce(sum(k), 0) AS BIGINT) AS n FROM names WHERE k > 1
UNION ALL SELECT 'kinds', 0 UNION ALL SELECT 'group_count', 0 UNION ALL SELECT 'values', count(*) FROM items WHERE value < 0
UNION ALL SELECT 'repeated', CAST(count(*) - count(DISTINCT (event_idx, cell_idx)) AS BIGINT) FROM items
UNION ALL SELECT 'features', count(*) FROM items ANTI JOIN wanted USING (event_idx) UNION ALL SELECT 'cells', count(*) FROM items ANTI JOIN (SELECT s_suppkey AS cell_idx FROM supplier WHERE s_acctbal > 0) USING (cell_idx)""")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a set that breaks some: names without strands or separators, a count per line item, no large groups, listed
    cells only."""
    events, _ = events_and_counts(spark, sf_dir)
    items = junction_reads(spark, sf_dir).join(events.select("chr", "start", "end", "strand", "event_idx"), ["chr", "start", "end", "strand"])
    var = events.where("group_count < 12").withColumnRenamed("event_idx", "feature_idx").withColumn("name", F.concat("chr", "start", F.lit("-"), "end", "group_kind"))
    obs = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cell_idx"))
    return validation_report(CountSet(obs, var, {"M1": items.select(F.col("event_idx").alias("feature_idx"), "cell_idx", F.col("value").cast("double").alias("value"))}))


@query("""WITH own AS (SELECT 's' || (s_nationkey % 2) AS sample, s_acctbal, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT CAST(l_partkey AS VARCHAR) AS gene, 'ACGT' || l_suppkey || '-' || sample AS cell, CAST(sum(CASE sample WHEN 's0' THEN 2 * value ELSE value END) AS DOUBLE) AS value FROM own WHERE s_acctbal > 0 GROUP BY ALL""")
def read_gene_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout that is found: the first sample has a raw matrix and, before it, one of expectation-maximisation with twice
    the counts; the second has a filtered matrix beside the raw one."""
    base = write_genes(spark, sf_dir, layouts=True)
    found = read_genes(spark, [f"{base}/{s}" for s in SAMPLES], SAMPLES, matrix_source="auto")
    joined = found.layers["X"].join(found.var.select("feature_idx", F.col("gene_id").alias("gene")), "feature_idx").join(found.obs.select("cell_idx", "cell"), "cell_idx")
    return joined.select("gene", "cell", "value")
