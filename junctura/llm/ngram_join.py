"""Similarity join of documents by word shingles: vertical partitions of the global shingle order."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, utf8
from .components import components
from .shingles import SHINGLE, shingle_sets

#: Shingles are counted in so many cells (powers of two); the counts give the order, and no result depends on them.
CELL_BITS, SLOT_BITS = 21, 6
#: Bits of the map of classes that are in candidate pairs; a chance hit costs work only.
MAP_BITS = 24
#: Classes of a bucket that are compared in one piece.
BLOCK = 4096
#: Fragments of the order: level 0 by the two top bits of the hash, then by level.
LEVEL_CUTS = (1, 24, 48, 80)


def class_id(found: np.ndarray) -> int:
    """64 bits that stand for a set of shingles."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def documents_and_counts(docs: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, bytes]:
    """(key, n, cid) of each document: its number of shingles and its class, null for the empty set; and the level, 0 to
    127, of each cell of shingles, higher for more frequent ones.

    Each task counts the shingles of its documents by cell and gives the counts in compressed slices, which are added by
    slice: about 2 MB for each task, whatever it read. The levels have a fixed size of 2 MB.
    """

    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        names = ["key", "n", "cid", "slot", "counts"]
        for batch in found:
            if not batch.num_rows:
                continue
            n, cid = [], []
            for s in shingle_sets(batch.column(1), k):
                cells, times = np.unique(_cells(s), return_counts=True)
                counts[cells] += times.astype(np.uint32)
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        slices = counts.reshape(1 << SLOT_BITS, -1)
        used = [i for i in range(len(slices)) if slices[i].any()]
        if used:
            size = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array(used, pa.int32()), pa.array([zlib.compress(slices[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())], names=names)

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in found:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(data.as_py()), "<u4").astype(np.int64)
                sums[slot] = sums[slot] + part if slot in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slot", "counts"])

    spark = docs.sparkSession
    scanned = stage(docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("data")).mapInArrow(scan, "key long, n long, cid long, slot int, counts binary"), "join-scan")
    slices = scanned.where("slot is not null").select("slot", "counts").repartition(min(partitions(spark), 1 << SLOT_BITS), "slot")
    total = np.zeros((1 << SLOT_BITS, 1 << (CELL_BITS - SLOT_BITS)), np.int64)
    for row in slices.mapInArrow(add, "slot int, counts binary").toLocalIterator():  # 64 slices of fixed size
        total[row["slot"]] = np.frombuffer(row["counts"], np.int64)
    above = np.maximum(0, total.ravel() - np.median(total))
    levels = np.minimum(127, np.round(8 * np.log2(1 + above / 4))).astype(np.uint8).tobytes()
    return scanned.where("slot is null").select("key", "n", "cid"), levels


def ranks(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places in the global order: by level, then by hash. Rare shingles come first."""
    return (levels[_cells(found)].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)).astype(np.int64)


def class_map(cids: DataFrame):
    """A broadcast map of 2^24 bits with the classes of column c; the driver gets at most 2^19 numbers."""
    bits = cids.select(F.shiftrightunsigned("c", 64 - MAP_BITS).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    flags = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    for row in bits.toLocalIterator():
        flags[row["word"]] = row["bits"]
    return cids.sparkSession.sparkContext.broadcast(flags.tobytes())


def in_map(flags: np.ndarray, cid: int) -> bool:
    at = (cid & ((1 << 64) - 1)) >> (64 - MAP_BITS)
    return bool(flags[at >> 5] >> np.uint32(at & 31) & np.uint32(1))


def sketch(found: np.ndarray) -> bytes | None:
    """How many shingles have each value of their top bits, two counts to a byte; there are more than half as many values as
    shingles, and at most as many. None where a count is over 15."""
    bits = max(3, len(found).bit_length() - 1)
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return None if counts.max() > 15 else (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def most_common(a: bytes | None, b: bytes | None) -> float:
    """No more shingles than this are in both sets: the lesser counts of their sketches, added up."""
    if a is None or b is None:
        return np.inf
    x, y = (np.stack([v & 15, v >> 4], axis=1).ravel().astype(np.int64) for v in (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(axis=1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(x, y).sum())


def prefixes(docs: DataFrame, text: str, levels, copied, k: int) -> DataFrame:
    """(cid, n, last, common, prefix, sketch) of each class: its first n - ceil(0.8 n) + 1 shingles in the global order. Two
    sets of similarity 0.8 or more have a shingle of both prefixes in common. `common` is the mean level: how common its
    shingles are. Shingles are given by their ranks in the order. Only classes in the map `copied` can have several rows, so
    only those are shuffled to keep one."""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, flags = np.frombuffer(levels.value, np.uint8), np.frombuffer(copied.value, np.uint32)
        for batch in found:
            cid, n, last, common, prefix, sketches = [], [], [], [], [], []
            for s in shingle_sets(batch.column(0), k):
                if not len(s):
                    continue
                rank = ranks(s, level)
                p = len(s) + (-8 * len(s)) // 10 + 1
                order = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
                cid.append(class_id(s))
                n.append(len(s))
                last.append(int(rank[order].max()))
                common.append(float((rank >> 56).mean()))
                prefix.append(rank[order])
                sketches.append(sketch(s))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefix], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(common, pa.float32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sketches, pa.binary()), pa.array([in_map(flags, c) for c in cid], pa.bool_())], names=["cid", "n", "last", "common", "prefix", "sketch", "copied"])

    made = stage(docs.select(utf8(text).alias("data")).mapInArrow(cut, "cid long, n long, last long, common float, prefix array<long>, sketch binary, copied boolean"), "join-prefixes")
    one = stage(made.where("copied").groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "last", "common", "prefix", "sketch")]), "join-copied")
    return made.where("not copied").drop("copied").unionByName(one)


def shared_only(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (h, cid) whose h more than one class has, and (h, blocks) of each h that more than `block` classes have:
    one pass over sorted partitions, in which a bucket may span batches and is never held."""

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda h, cid, m: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(cid, pa.int64()), pa.array(m, pa.int64())], names=["h", "cid", "m"])
        held = None  # the last row, and the rows of its bucket before it
        for batch in found:
            if not batch.num_rows:
                continue
            h, cid = (batch.column(i).to_numpy() for i in range(2))
            before = 0
            if held is not None:
                h, cid, before = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], cid]), held[2]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(heads, len(h)))
            sizes[0] += before
            multiple = np.repeat(sizes > 1, np.diff(np.append(heads, len(h))))
            held = (h[-1], cid[-1], int(sizes[-1]) - 1)
            out = np.flatnonzero(multiple[:-1])
            if len(out):
                yield give(h[out], cid[out], pa.nulls(len(out), pa.int64()))
            large = np.flatnonzero(sizes[:-1] > block)
            if len(large):
                yield give(h[heads[large]], pa.nulls(len(large), pa.int64()), sizes[large])
        if held is not None and held[2]:
            yield give([held[0]], [held[1]], [None])
            if held[2] >= block:
                yield give([held[0]], [None], [held[2] + 1])

    dealt = rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h")
    found = stage(dealt.mapInArrow(keep, "h long, cid long, m long"), "join-shared")
    large = stage(found.where("m is not null").select("h", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "join-large")
    return found.where("m is null").select("h", "cid"), large


def possible(pairs: DataFrame, signed: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule the similarity out."""

    def check(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
            keep = [100 * o >= similarity * (x + y - o) if (o := most_common(s, t)) < np.inf else True for x, y, s, t in zip(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: signed.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return met.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, text: str, levels, copied, k: int, fan: int) -> DataFrame:
    """(a, b, overlap, na, nb) of pairs of classes (a, b): the sets are cut into fragments of the global order, overlaps are
    counted in each fragment apart and summed for each pair.

    A class's fragments are sent to its pairs, and the two of a pair meet by pair and fragment. A class that has more than
    `fan` pairs is first copied to as many lots of its pairs as that makes, so that no task serves them all."""
    wanted = class_map(pairs.select(F.explode(F.array("a", "b")).alias("c")))
    n_fragments = 4 + len(LEVEL_CUTS)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, flags, often = np.frombuffer(levels.value, np.uint8), np.frombuffer(wanted.value, np.uint32), np.frombuffer(copied.value, np.uint32)
        for batch in found:
            cids, fragments, parts, sizes, repeats = [], [], [], [], []
            for s in shingle_sets(batch.column(0), k):
                if not len(s):
                    continue
                cid = class_id(s)
                if not in_map(flags, cid):
                    continue
                lv = level[_cells(s)]
                f = np.where(lv < LEVEL_CUTS[0], (s >> np.uint64(62)).astype(np.int64), 3 + np.searchsorted(LEVEL_CUTS, lv, side="right"))
                for i in range(n_fragments):
                    part = s[f == i]
                    if len(part):
                        cids.append(cid)
                        fragments.append(i)
                        sizes.append(len(s))
                        repeats.append(in_map(often, cid))
                        parts.append(part.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(fragments, pa.int32()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(repeats, pa.bool_())], names=["cid", "fragment", "n", "part", "copied"])

    made = stage(docs.select(utf8(text).alias("data")).mapInArrow(cut, "cid long, fragment int, n long, part array<long>, copied boolean"), "join-parts")
    one = made.where("copied").groupBy("cid", "fragment").agg(F.first("n").alias("n"), F.first("part").alias("part"))
    parts = made.where("not copied").drop("copied").unionByName(one)
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("cid"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cid"), F.lit(1).alias("side")))).alias("x")).select("a", "b", "x.cid", "x.side")
    hubs = stage(sides.groupBy("cid").count().where(F.col("count") > fan).select("cid", F.expr(f"cast((count + {fan - 1}) div {fan} as int)").alias("lots")), "join-hubs")
    lot = F.pmod(F.xxhash64("a", "b"), F.coalesce("lots", F.lit(1))).cast("int")
    asked = sides.join(hubs, "cid", "left").withColumn("lot", lot).drop("lots")
    given = parts.join(hubs, "cid", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    sent = asked.join(given, ["cid", "lot"]).select("a", "b", "fragment", "side", "n", "part")
    of = lambda c, x: F.max(F.when(F.col("side") == x, F.col(c)))
    met = sent.repartition(partitions(docs.sparkSession), "a", "b", "fragment").groupBy("a", "b", "fragment").agg(of("n", 0).alias("na"), of("n", 1).alias("nb"), F.collect_list("part").alias("parts"))
    both = F.when(F.size("parts") == 2, F.size(F.array_intersect(F.get("parts", F.lit(0)), F.get("parts", F.lit(1))))).otherwise(0)
    return met.groupBy("a", "b").agg(F.sum(both).alias("overlap"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def linked(pairs: DataFrame, signed: DataFrame, docs: DataFrame, text: str, levels, copied, k: int, similarity: int, fan: int) -> DataFrame:
    likely = stage(possible(pairs, signed, similarity), "join-likely")
    found = verified(likely, docs, text, levels, copied, k, fan)
    return stage(found.where(F.col("overlap") * 100 >= similarity * (F.col("na") + F.col("nb") - F.col("overlap"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "join-links")


def _may_link(first, second, n, last, after):
    """Of pairs of places in these vectors: whether they are of near sizes, and could have enough in common if this bucket's
    shingle is the first that they share. Of the set whose prefix ends first, all that the other can have is at this shingle
    or later in its prefix (`after`), or behind it."""
    ends = np.where(last[first] <= last[second], first, second)
    need = np.ceil((n[first] + n[second]) * 4 / 9 - 1e-9)
    near = 10 * np.minimum(n[first], n[second]) >= 8 * np.maximum(n[first], n[second])
    return near & (after[ends] + -(-8 * n[ends] // 10) - 1 >= need)


def star_pairs(members: DataFrame) -> DataFrame:
    """In each bucket, pairs (a, b) of the class with the commonest shingles and all others that may link with it; from
    rows (h, cid, n, last, after, common). Rows come sorted with this class first, and only its row is held."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list | None = None
        for batch in found:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if head is not None:
                rows = [np.concatenate([[a], b]) for a, b in zip(head, rows)]
            h, cid, n, last, after = rows
            first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
            at = np.arange(len(h))
            may = (first != at) & (cid[first] != cid) & _may_link(first, at, n, last, after)
            head = [x[first[-1]] for x in rows]
            a, b = np.minimum(cid[first], cid)[may], np.maximum(cid[first], cid)[may]
            got = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    dealt = members.repartition(partitions(members.sparkSession), "h").sortWithinPartitions("h", F.desc("common"), "cid")
    return dealt.select("h", "cid", "n", "last", "after").mapInArrow(run, "a long, b long")


def large_stars(members: DataFrame) -> DataFrame:
    """star_pairs() of the large buckets: their heads by aggregation, joined, so that a bucket is spread over tasks."""
    heads = members.groupBy("h").agg(F.max(F.struct("common", F.expr("-cid").alias("order"), "cid", "n", "last", "after")).alias("head"))
    behind = lambda n: F.ceil(n * 8 / 10) - 1
    room = F.when(F.col("last") <= F.col("head.last"), F.col("after") + behind(F.col("n"))).otherwise(F.col("head.after") + behind(F.col("head.n")))
    return (
        members.join(heads, "h").where(F.col("head.cid") != F.col("cid"))
        .where(10 * F.least("n", "head.n") >= 8 * F.greatest("n", "head.n"))
        .where(room >= F.ceil((F.col("n") + F.col("head.n")) * 4 / F.lit(9) - 1e-9))
        .select(F.least("cid", "head.cid").alias("a"), F.greatest("cid", "head.cid").alias("b"))
    )


def cross_pairs(members: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may link, from rows (h, cid, n, last, after, comp): all members of a bucket
    are compared at one distance in order of size after the other, until sizes are too far apart. A large bucket is cut
    into blocks by hash, and each pair of blocks is a bucket of its own, so that a task holds two blocks at most."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, pair, block, cid, n, last, after, comp = rows
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            group = np.cumsum(fresh)
            within = pair // (1 << 31) == pair % (1 << 31)
            at, d, out, size = np.arange(len(key) - 1), 1, [], 0
            while len(at):
                at = at[(group[at] == group[at + d]) & (10 * n[at] >= 8 * n[at + d])]
                use = at[(comp[at] != comp[at + d]) & (within[at] | (block[at] != block[at + d]))]
                use = use[_may_link(use, use + d, n, last, after)]
                if len(use):
                    out.append(np.stack([np.minimum(cid[use], cid[use + d]), np.maximum(cid[use], cid[use + d])], axis=1))
                    size += len(use)
                d += 1
                at = at[at + d < len(key)]
                if out and (size > 200_000 or not len(at)):
                    got = np.unique(np.concatenate(out), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])
                    out, size = [], 0

        held: list[np.ndarray] | None = None
        for batch in found:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            cut = len(rows[0])
            if cut:  # the last bucket may go on
                other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from meet([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield from meet(held)

    blocks = F.coalesce("blocks", F.lit(1))
    cut = members.join(large, "h", "left").withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = (F.shiftleft(F.least("block", "other").cast("long"), 31) + F.greatest("block", "other")).alias("pair")
    rows = cut.select("h", pair, F.col("block").cast("int").alias("block"), "cid", "n", "last", "after", "comp")
    return rows.repartition(partitions(members.sparkSession), "h", "pair").sortWithinPartitions("h", "pair", "n").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: int = 80, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) of every row: sets of distinct k-word shingles link at a Jaccard similarity of
    `similarity` percent (80 or more), and a component is named by its smallest key.

    Steps: (1) each distinct set is a class, so copies cost nothing further. (2) Shingles are ordered, rare ones first, by
    counts in a table of fixed size. (3) Classes that share a shingle of their prefixes are candidates. In each such bucket
    the class with the commonest shingles is tried with all others (a star: as many pairs as rows). (4) Pairs that their
    sketches don't rule out are verified by fragments of the order, and links joined to components. (5) In each bucket,
    pairs of different components that may still link are tried in the same way. So every pair that could link is either
    verified, ruled out by a bound, or already in one component: components are exact, and no group emits all its pairs.
    Buckets of more than `block` classes are cut into pairs of blocks, and classes of many pairs are copied to lots of them.

    Sets are compared as 64-bit hashes of shingles. A text of fewer than k words has one shingle, all of its words; null
    and empty texts have none, are linked with nothing, and are components of their own. A null key stays null and never
    names a component that has another key. Repeated rows get the same component; an empty table gives no rows; other
    columns are ignored. A very long text is hashed alone, and its shingles travel as rows of their own or in fragments.
    """
    if similarity != 80:
        raise ValueError("prefixes and bounds are cut for a similarity of 80 percent")
    spark = docs.sparkSession
    rows, counted = documents_and_counts(docs, key, text, k)
    levels = spark.sparkContext.broadcast(counted)
    copied = class_map(rows.groupBy(F.col("cid").alias("c")).count().where("count > 1 and c is not null").select("c"))
    signed = prefixes(docs, text, levels, copied, k)
    shared, large = shared_only(signed.select(F.explode("prefix").alias("h"), "cid"), block)
    lists = shared.groupBy("cid").agg(F.array_sort(F.collect_list("h")).alias("shared"))  # at most a prefix each
    members = stage(signed.select("cid", "n", "last", "common").join(lists, "cid"), "join-members")

    def spread(rows: DataFrame) -> DataFrame:
        """A row per shared shingle, with how many of the list are at it or later."""
        flat = rows.select(*[c for c in rows.columns if c != "shared"], F.size("shared").alias("_size"), F.posexplode("shared").alias("_at", "h"))
        return flat.withColumn("after", F.col("_size") - F.col("_at")).drop("_size", "_at")

    bucketed = spread(members)
    stars = star_pairs(bucketed.join(large, "h", "left_anti")).unionByName(large_stars(bucketed.join(large, "h", "left_semi")))
    links = linked(stage(stars.distinct(), "join-star"), signed, docs, text, levels, copied, k, similarity, 4 * block)
    joined = components(links)
    placed = members.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component", "common")
    more = stage(cross_pairs(spread(placed), large).distinct(), "join-cross")
    found = joined
    if more.limit(1).count():  # components that further links join
        label = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        further = linked(more, signed, docs, text, levels, copied, k, similarity, 4 * block).join(label("u"), "u", "left").join(label("v"), "v", "left")
        merged = components(further.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")))
        deeper = merged.withColumnRenamed("component", "deep").withColumnRenamed("node", "component")
        old = joined.join(deeper, "component", "left").select("node", F.coalesce("deep", "component").alias("component"))
        found = old.unionByName(merged.join(joined.select("node"), "node", "left_anti"))
    named = rows.where("cid is not null").groupBy("cid").agg(F.min("key").alias("least"))
    groups = named.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    least = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = groups.select("cid", "comp").join(least, "comp").select("cid", "component_id")
    with_set = rows.where("cid is not null").join(names, "cid").select("key", "n", "component_id")
    without = rows.where("cid is null").select("key", "n", F.col("key").alias("component_id"))
    return with_set.unionByName(without).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
