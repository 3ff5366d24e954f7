"""A corpus pipeline over the operators of junctura.llm: toxic documents go, one of each group of near copies stays,
personal data is masked, sources are mixed to weights, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import mixing, ngram_join, packing, pii, toxicity
from junctura.llm.common import stage, table


#: Documents that go to Python at a time, where the session has Spark's own number: its 10,000 texts take tens of MB, several
#: times over, in each task.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def _small_batches(spark: SparkSession) -> None:
    name, default, few = BATCH
    if spark.conf.get(name) == default:
        spark.conf.set(name, few)


def _named(docs: DataFrame) -> DataFrame:
    """For each row of docs: row, all of its columns; id, or a hash of its text where it has none; text and source; and key and
    sum, two hashes of the row. Rows of one key are equal, or differ in columns that can't be hashed (maps) alone. Whatever
    docs' columns are called, they are in `row` and stay as they are."""
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    hashed = [own[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row, text = F.struct(*own.values()), F.coalesce(own["text"], F.lit(""))
    key = F.xxhash64(F.lit(1), *hashed)
    return docs.select(row.alias("row"), F.coalesce(own["doc_id"].cast("long"), F.xxhash64(text)).alias("id"), own["text"].alias("text"), own["source"].alias("source") if "source" in own else F.lit(None).cast("string").alias("source"), key.alias("key"), F.xxhash64(F.lit(2), *reversed(hashed)).alias("sum"))


def _once(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted keys (key, n, more...: n rows have the key), one of each set of equal rows, with more. Where keys
    are repeated, rows that are alone in theirs pass by, and others are aggregated in their tasks first: a row that is a third
    of the table comes once from each task."""
    wanted = stage(wanted, "pipeline-keys")
    rows = named.select("row", "key", "sum").join(wanted.hint("merge"), "key")  # a row per document: the same plan at every size
    if not wanted.where("n > 1").limit(1).count():
        return rows
    repeated = rows.where("n > 1").groupBy("key", "sum").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("key", "sum")])
    return rows.where("n = 1").unionByName(repeated)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    _small_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; of repeated rows one."""
    _small_batches(spark)
    named = _named(docs)
    groups = ngram_join.similar_documents(named.select("key", "text"), key="key")
    counts = named.groupBy("key", "id").agg(F.count("*").alias("n"))
    least = groups.distinct().join(counts, "key").groupBy("component_id").agg(F.min(F.struct("id", "key", "n")).alias("least"))
    return _once(named, least.select("least.key", "least.n")).select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    _small_batches(spark)
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a part counting as a whole; so at most three times, or not at all."""
    _small_batches(spark)
    named = _named(docs)
    taken = mixing.mix(named.select("key", "text", "source"), key="key")["taken"]
    # Equal rows take what all of them are given together.
    times = taken.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("taken") > 0, F.expr("(taken + size - 1) div size")).otherwise(0)).alias("times"))
    return _once(named, times.where("times > 0")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' token pieces in sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Several stages go beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents, each staged as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
