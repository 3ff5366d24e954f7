"""Merkle trees over the paragraphs and sections of texts, as columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: A paragraph ends after a run of line ends or sentence marks, or after 96 characters without one.
PARAGRAPH = r"[^\n.!?]{0,95}+[\n.!?]+|[^\n.!?]{1,96}+"
LOWEST = -(1 << 63)


def leaves(text: Column) -> Column:
    """SHA-256 digests (hex) of the paragraphs, which together are the whole text."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.sha2(p, 256))


def tree(hashes: Column, digits: int = 64) -> Column:
    """The first digits of the paragraphs' digests by section: a section ends after a paragraph whose digest is a multiple of
    8, so that sections fall in step again after an edit. Paragraphs are divided by commas, sections by bars."""
    return F.array_join(F.transform(hashes, lambda h: F.concat(F.substring(h, 1, digits), F.when(F.substring(h, 64, 1).isin("0", "8"), F.lit("|")).otherwise(F.lit(",")))), "")


def root(hashes: Column) -> Column:
    """The digest of the digests of the sections, which are those of the paragraphs' whole digests."""
    return F.sha2(F.array_join(F.transform(F.split(tree(hashes), r"\|"), lambda s: F.sha2(s, 256)), "|"), 256)


def fingerprint(hashes: Column) -> Column:
    """root:tree. Texts are equal where roots are (up to a collision of SHA-256); else the differing sections and then
    paragraphs, of which the tree has 48 bits each, locate the edits."""
    return F.concat(root(hashes), F.lit(":"), tree(hashes, 12))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common paragraphs over the sum of both numbers of paragraphs (distinct ones); 1 for two empty texts."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def edits(old: Column, new: Column) -> Column:
    """Paragraph digests of the new fingerprint that its changed sections have and the old fingerprint's sections lack.
    Sections of equal digest are passed over; equal roots give an empty array."""
    sections = lambda f: F.split(F.element_at(F.split(f, ":"), 2), r"\|")
    inside = lambda s: F.filter(F.flatten(F.transform(s, lambda x: F.split(x, ","))), lambda x: x != "")
    changed, gone = F.array_except(sections(new), sections(old)), F.array_except(sections(old), sections(new))
    return F.when(F.substring(old, 1, 64) == F.substring(new, 1, 64), F.array().cast("array<string>")).otherwise(F.array_except(inside(changed), inside(gone)))


def _numbers(values: list[int | None], kind: str) -> Column:
    """An array of numbers as one literal, however many there are: Spark folds the cast of a split text, so that a row costs
    no more than looking numbers up. Missing ones are the lowest."""
    return F.split(F.lit(",".join(str(LOWEST if v is None else v) for v in values)), ",").cast(f"array<{kind}>")


def _block_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at most (key, tie), by binary search in two literal arrays."""
    if not bounds:
        return F.lit(0)
    keys, ties = (_numbers([b[i] for b in bounds], "long") for i in (0, 1))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def narrow(at: Column, step: Column) -> Column:
        nth = F.least(at + step, F.lit(len(bounds))) - 1
        below = (F.get(keys, nth) < key) | (F.get(keys, nth) == key) & (F.get(ties, nth) <= tie)
        return F.when((at + step <= len(bounds)) & below, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), narrow)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks_per_partition: int = 4) -> DataFrame:
    """Columns key, text (null: empty), next_text: each row with its successor in order of key; after the last comes the
    first. Null keys come first; rows of equal key follow by hash of the text.

    Keys are cut into ranges at approximate quantiles; a range is a block of a window, so texts are shuffled once. A key
    that takes several quantiles (nulls, say) is cut into as many ranges of the texts' hashes. The first row of each block
    is also sent to the block before it. What the driver holds is two numbers for each block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("k"))
    n = partitions(spark) * blocks_per_partition
    cuts = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first()["c"] or []
    bounds = [(c, LOWEST + j * (1 << 64) // times) for c, times in sorted(Counter(cuts).items()) for j in range(times)]
    tied = rows.withColumn("tie", F.xxhash64("text"))
    block = _block_of(F.col("k"), F.col("tie"), bounds)
    firsts = {r["b"]: r["f"] for r in tied.groupBy(block.alias("b")).agg(F.min(F.struct("k", "tie")).alias("f")).collect()}  # a row per block
    full = sorted(firsts)
    before = dict(zip(full, [full[-1], *full])) if full else {}
    every = range(len(bounds) + 1)
    first_k, first_tie = (_numbers([firsts[b][i] if b in firsts else None for b in every], "long") for i in (0, 1))
    block_before = _numbers([before.get(b, -1) for b in every], "int")
    leads = (F.get(first_k, F.col("b")) == F.col("k")) & (F.get(first_tie, F.col("b")) == F.col("tie"))
    home = F.struct(F.col("b").alias("block"), F.lit(0).alias("guest"))
    homed = tied.withColumn("b", block).select("key", "text", "k", "tie", F.explode(F.when(leads, F.array(home, F.struct(F.get(block_before, F.col("b")).alias("block"), F.lit(1).alias("guest")))).otherwise(F.array(home))).alias("home"))
    dealt = homed.select("key", "text", "k", "tie", "home.block", "home.guest").repartition(partitions(spark), "block")
    order = Window.partitionBy("block").orderBy("guest", "k", "tie")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select(F.col("key").alias(key), "text", "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint. Null and empty texts have no paragraphs and one fingerprint; repeated rows repeat; very long
    texts are hashed whole; other columns are ignored; an empty table gives no rows. No shuffle."""
    return docs.select(F.col(key), leaves(F.coalesce(F.col(text), F.lit(""))).alias("leaves")).select(key, fingerprint(F.col("leaves")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter of code points is replaced by as many from the
    start of the next text (all of it, if shorter), with likenesses to the edited form and to the next text.
    Nulls, ties and empty tables: as in with_next(); very long texts: as in fingerprints()."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = with_next(docs, key, text).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.substring(F.col("next_text"), F.lit(1), quarter)))
    hashed = edited.withColumn("leaves", leaves(F.col("text"))).withColumn("edited_leaves", leaves(F.col("edited"))).withColumn("next_leaves", leaves(F.col("next_text")))
    return hashed.select(
        key,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("leaves")).alias("fingerprint"),
        fingerprint(F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )
