"""Mixing sources to target weights by a low-discrepancy schedule of equal word blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: Relative weights of the sources in code-point order, repeated.
WEIGHTS = (5, 2, 1)
#: At most so often a source (and so any document) is repeated.
REPEATS = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = 1024) -> DataFrame:
    """From a row per source (skey, source, source_size): its target, in words and in slots of the schedule.

    Targets are the weights' shares of all words; none is above `repeats` times its source's size, and the excess is shared
    by weight among the others. In order of cap over weight, the capped sources come first; the level is the least
    (rest of the words) / (rest of the weights) that the next source can hold. These windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "skey")
    everything = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights)))
    capped = weighed.withColumn("cap", repeats * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    levels = (
        capped.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    sized = levels.withColumn("target", target).withColumn("words", F.least(F.round("target").cast("long"), F.col("cap")))
    # A pass over a source is `blocks` slots, the last of them short; what is left of the target is cut into slots again.
    slots = (
        sized.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )
    return slots.withColumn("first_point", F.sum("slots").over(by_name) - F.col("slots")).withColumn("points", F.sum("slots").over(everything)).select("skey", "rank", "source_size", "target", "words", "blocks", "passes", "rest", "slots", "first_point", "points")


def schedule(targets: DataFrame, block: int = 1024, run: int = 4096) -> DataFrame:
    """The slots of the mix: position, skey, nth (rank of the slot within its source), block, used (words taken from it).

    The points of the van der Corput sequence in base 2 with 2^m >= points are a permutation of the cells of [0, 1); each
    source owns as many neighbouring cells as it has slots (its cumulative weight), the rest is nobody's. A cell's position
    is its index with the bits reversed. Ranks within a source: counts per stretch of positions, prefix sums over them, and
    a rank within each stretch, so that a source with a large share of the slots is spread over tasks.
    """
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("points"), F.lit(1)).cast("double")))).cast("int")
    runs = targets.where("slots > 0").withColumn("bits", bits).withColumn("run", F.explode(F.expr(f"sequence(0L, (slots - 1) div {run})")))
    cells = runs.repartition("skey", "run").withColumn("cell", F.explode(F.expr(f"sequence(first_point + run * {run}, first_point + least(slots, (run + 1) * {run}) - 1)")))
    placed = cells.withColumn("position", F.conv(F.reverse(F.lpad(F.bin("cell"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")).withColumn("stretch", F.expr(f"position div {16 * run}"))
    kept = placed.select("skey", "position", "stretch", "blocks", "passes", "rest")
    counts = kept.groupBy("skey", "stretch").count().withColumn("before", F.sum("count").over(Window.partitionBy("skey").orderBy("stretch")) - F.col("count")).select("skey", "stretch", "before")
    # A schedule is made from a row per source, so Spark takes it for small and would send it to every task.
    ranked = kept.join(counts.hint("merge"), ["skey", "stretch"]).withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("skey", "stretch").orderBy("position")) - 1)
    return ranked.select(
        "position", "skey", "nth",
        F.expr("nth % blocks").alias("block"),
        F.when(F.expr("nth div blocks") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.expr("nth % blocks") * block)).cast("long").alias("used"),
    )


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = 1024, key: str = "doc_id", text: str = "text", source: str = "source", rows_per_stretch: int = 4_096) -> dict[str, DataFrame]:
    """A mix of the sources by weight.

    Each source's documents are shuffled by a hash of key and seed and laid end to end; the line is cut into blocks of
    `block` words. The schedule calls the blocks of each source in turn (and again from the start in further passes), and
    the last slot is cut so that the words taken equal the rounded target. Everything is DataFrame operations; a document
    is placed by prefix sums over stretches of the hash, so that a source with most of the rows is spread over tasks.

    Gives `schedule` (see there), `pieces` (row, block, from, until: the parts of documents in blocks), `taken` (the
    documents with size, source_size, target and the words taken, repeats counted) and `targets` (a row per source).
    A null text has no words and is never taken; a null source is a source of its own and the last; null and repeated keys
    and repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), skey.alias("skey"), words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.xxhash64(text))).alias("h")), "mix-rows")
    sources = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stage(source_targets(sources.select("skey", "source", "source_size"), weights, repeats, block), "mix-targets")
    n = rows.count()
    bits = max(1, (n // rows_per_stretch).bit_length())  # stretches of the hash
    lined = rows.withColumn("stretch", F.shiftrightunsigned("h", 64 - bits))
    totals = lined.groupBy("skey", "stretch").agg(F.sum("size").alias("stretch_size"))
    starts = totals.withColumn("before", F.sum("stretch_size").over(Window.partitionBy("skey").orderBy("stretch")) - F.col("stretch_size")).join(targets.select("skey", "source_size", "target"), "skey")
    within = Window.partitionBy("skey", "stretch").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stage(
        lined.join(starts, ["skey", "stretch"]).withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size")).select("key", "skey", "size", "source_size", "target", "start"),
        "mix-placed",
    )
    pieces = (
        placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .select("key", "skey", "size", "source_size", "target", "start", "block", F.expr(f"greatest(0, start - block * {block})").alias("from"), F.expr(f"least({block}, start + size - block * {block})").alias("until"))
    )
    slots = schedule(targets, block)
    # A block has at most `repeats` slots, so the join makes at most that many rows of a piece.
    met = pieces.join(slots.select("skey", "block", "used").hint("merge"), ["skey", "block"], "left").withColumn("took", F.greatest(F.lit(0), F.least(F.col("until"), F.coalesce("used", F.lit(0))) - F.col("from")))
    taken = met.groupBy("skey", "start").agg(*[F.first(c).alias(c) for c in ("key", "size", "source_size", "target")], F.sum("took").alias("taken"))
    columns = [F.col("key").alias(key), "size", "source_size", "target", "taken"]
    nothing = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return {"schedule": slots, "pieces": pieces, "targets": targets, "taken": taken.select(*columns).unionByName(nothing.select(*columns))}
