"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="junctura-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, and read again."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_numbers(df: DataFrame) -> DataFrame:
    """staged(df), where tasks hand short rows of numbers to Python: batches are bounded by their number of rows alone, as
    Spark otherwise weighs a batch anew with each row, which takes longer than the rest."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(2**31 - 1))
    try:
        return staged(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over as many tasks as shuffles have, however small it is: for rows of which each is made into much."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """staged(df), and what aggregates of its rows come to, taken while they are written: checks need no job of their own."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return out, seen.get


#: Bits of a place within a partition, below the partition's number.
WITHIN = 33


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df in order by range partitions, written once: `_at` has the partition's number above the row's place in it. Ranges are
    sampled from df itself, whose shuffles are done once; so df gives the same rows each time it is computed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def with_index(df: DataFrame, order: list, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order, and for each entry new: column of `sums` what the column adds up to in
    all rows before. Rows are range partitioned, sorted and written with their place in the partition; a row per partition
    gives its totals, and prefix sums over those give what comes before it. The result reads the written table: it needn't
    be staged again, and without `sums` nothing is shuffled."""
    sums = sums or {}
    ranged = _ranged(df, order).withColumn("_part", F.shiftright("_at", WITHIN))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{s}") for s, c in sums.items()])
    places = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_sum_{s}" for s in sums))])
    joined = ranged.join(F.broadcast(places), "_part")  # a row per partition
    new = [(F.col("_before_n") + F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))).alias(name)]
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new += [(F.col(f"_before_sum_{s}") + F.sum(c).over(within) - F.col(c)).alias(s) for s, c in sums.items()]
    return joined.select(*df.columns, *new)


def first_seen_index(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds a dense code of `key` (from 0) by the first appearance in `order`."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    codes = with_index(first, ["_first"], name).select(key, name)
    return df.join(codes, key)


def adjusted(df: DataFrame, p: str, name: str, block: int = 100_000) -> DataFrame:
    """Adds p values adjusted by the step-up rule of false discovery: the least p * n / rank of all with as high a rank.
    Null p values stay out and get null. Ranks are cut into blocks; within a block the least value so far is taken from the
    highest rank down, and a row per block tells the least of the blocks above."""
    placed = with_index(df, [F.col(p).asc_nulls_last()], "_rank")
    n = placed.agg(F.count(p).alias("n")).first()["n"]
    ranked = placed.withColumn("_q", F.col(p) * n / (F.col("_rank") + 1)).withColumn("_block", F.expr(f"_rank div {block}"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranked.groupBy("_block").agg(F.min("_q").alias("_least")).select("_block", F.min("_least").over(above).alias("_later"))
    down = Window.partitionBy("_block").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(down), F.col("_later")))
    return ranked.join(later, "_block").withColumn(name, least).drop("_rank", "_q", "_block", "_later")
