"""Counts in the shape of sequencing data, from the order tables: parts are coordinates, suppliers are cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import staged, with_index
from ..operators.grouping import number_events, splice_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def junction_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: its junction (chr, start, end, strand) and cell, and how many reads."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("chr"), F.expr("cast(floor(p_size / 5) as bigint)").alias("start"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("end"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("code"), F.col("l_suppkey").alias("cell_idx"), F.col("l_quantity").alias("value"), "l_returnflag")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("strand", F.when(F.col("code") == 1, "+").otherwise("-"))


def junction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junction_reads(spark, sf_dir).groupBy("chr", "start", "end", "strand", "cell_idx").agg(F.sum("value").alias("value"))


#: Line items of which most are counts of their own: above so many a task doesn't add up before they are shuffled.
LINES = 2_000_000


def _many_counts(spark: SparkSession, sf_dir: str, lines: int) -> DataFrame:
    """junction_counts() of many line items. Sites (chr, start) are numbered, so that rows of numbers are shuffled and added
    up, LINES in a task or so; adding up before that, when nearly all keys differ, would only fill the tasks' memory."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("chr"), F.expr("cast(floor(p_size / 5) as bigint)").alias("start"))
    sites = staged(part.select("chr", "start").distinct().withColumn("site", F.monotonically_increasing_id()))
    site = part.alias("p").join(sites.alias("s"), F.expr("p.chr <=> s.chr and p.start <=> s.start")).select("p_partkey", "site")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").cast("long").alias("end"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("code"), F.col("l_suppkey").alias("cell_idx"), F.col("l_quantity").alias("value"))
    n = max(-(-max(lines, part.count()) // LINES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    reads = items.repartition(n, "p_partkey").join(site.repartition(n, "p_partkey").hint("shuffle_hash"), "p_partkey")
    key = ["site", "end", "code", "cell_idx"]
    counts = reads.select(*key, "value").repartition(n, *key).groupBy(*key).agg(F.sum("value").alias("value"))
    return counts.join(sites, "site").select("chr", "start", "end", F.when(F.col("code") == 1, "+").otherwise("-").alias("strand"), "cell_idx", "value")


def events_and_counts(spark: SparkSession, sf_dir: str, kind: str = "start_end") -> tuple[DataFrame, DataFrame]:
    """Numbered events and their inclusion counts (event_idx, cell_idx, value)."""
    lines = table(spark, sf_dir, "lineitem").count()
    counts = staged(junction_counts(spark, sf_dir) if lines <= LINES else _many_counts(spark, sf_dir, lines))
    key = ["chr", "start", "end", "strand"]
    junctions = with_index(counts.select(*key).distinct(), key, "junction_idx")
    events = staged(number_events(splice_events(junctions, kind)))
    m1 = counts.join(events.select(*key, "event_idx"), key).select("event_idx", "cell_idx", "value")
    return events, m1


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_idx"), F.expr("concat('s', s_nationkey % 4)").alias("library"))


def gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature_idx"), F.col("l_suppkey").alias("cell_idx")).agg(F.sum("l_quantity").alias("value"))
