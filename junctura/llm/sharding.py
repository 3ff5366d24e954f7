"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in key order, cut into `n_shards` contiguous shards at equal shares of all bytes.

    The rows (without their text) are range partitioned by key and sorted once. One row per partition carries its bytes
    and rows; prefix sums over those rows give each partition's place in the whole, so no task sees more than its own
    range. A row goes to the shard in whose share its middle byte lies, hence a shard is off its target by at most half
    a row at either end.

    Size: UTF-8 bytes of the text plus 1; a null or empty text has size 1 and checksum 0. Null keys come first; rows of
    equal key follow in order of checksum, and equal rows are interchangeable. An empty table gives no rows. Other
    columns of the input are ignored, whatever their names.
    Returns key, size, text_crc32, start (bytes before the row), shard, slot (place in the shard).
    """
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["key", "crc", "tie"]
    ranged = stage(rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "shard-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # One row per partition: bounded by the number of partitions, so it may be broadcast.
    places = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(places), "part").select(
        "key", "size", "crc",
        (F.col("bytes_before") + F.sum("size").over(within) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.count("*").over(within) - 1).alias("row"),
        "all_bytes",
    ).withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div (2 * all_bytes)) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "start", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
