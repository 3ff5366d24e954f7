"""Removal of byte strings that occur elsewhere, by suffix arrays over content-dealt shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, partitions, stage, utf8
from .suffix_array import common_prefixes, mixed, powers, prefix_sums, span_hashes, suffix_array

#: Length of the strings, and of the grams whose least hash deals a string to its shard.
LENGTH, GRAM = 200, 32
#: Bytes that are hashed together, and bytes of a shard's suffix array (at most twice as many are held).
CHUNK, SHARD = 1 << 20, 1 << 21
#: How many neighbouring places of the anchor in a string share a key, round by round, where an anchor's contexts exceed a
#: shard. In the last round a key is a whole string, so that what shares it is equal.
WIDTHS = (64, 16, 4, 1)
#: Tasks that the parts of one content are dealt to.
SALTS = 16


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def contexts(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """doc, anchor, content hash, first and last start of each context, from (doc, place in it, bytes) of LENGTH or more.

    A string's anchor is the first place of the least hash of its grams, so equal strings have equal hashes there.
    Neighbouring starts with one anchor are a context, whose bytes run to the end of the last start's string; each start is
    in one context, which has at most LENGTH - GRAM + 1 of them.
    """
    sizes = np.array([len(p[2]) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = prefix_sums(data)
    n = len(data)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
    anchors = least(grams, LENGTH - GRAM + 1)
    valid = np.ones(len(anchors), bool)
    for b in (begins[1:]).tolist():  # no string crosses parts
        valid[b - LENGTH + 1 : b] = False
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | ~valid[:-1] | (grams[: len(anchors) - 1] == anchors[:-1])
    first = np.flatnonzero(fresh & valid)
    ends = np.append(np.flatnonzero(fresh | ~valid), len(anchors))
    last = ends[np.searchsorted(ends, first, side="right")] - 1
    part = np.searchsorted(begins, first, side="right") - 1
    shift = np.array([p[1] for p in parts], np.int64)[part] - begins[part]
    return np.array([p[0] for p in parts], np.int64)[part], anchors[first].view(np.int64), span_hashes(sums, first, last + LENGTH).view(np.int64), first + shift, last + shift


def once_each(doc: np.ndarray, h: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, ...]:
    """One of each text's contexts of equal content, and `own` rows for what those that are there twice or more cover,
    joined where they touch: so text that repeats a phrase over and over has few rows, and no anchor gathers them."""
    order = np.lexsort((s, c, h, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    often = np.bincount(np.cumsum(fresh) - 1)
    first = np.zeros(len(doc), bool)
    first[order[fresh]] = True
    many = np.zeros(len(doc), bool)
    many[order] = np.repeat(often > 1, often)
    d, a, b = doc[many], s[many], e[many] + LENGTH
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1])])) if len(d) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(d)) - 1 if len(d) else starts
    spread = mixed(cid[d[starts]].view(np.uint64) + a[starts].astype(np.uint64)).view(np.int64)
    own = np.concatenate([np.zeros(int(first.sum()), bool), np.ones(len(starts), bool)])
    columns = [np.concatenate(x) for x in ((doc[first], d[starts]), (h[first], spread), (c[first], spread), (s[first], a[starts]), (e[first], b[ends] - LENGTH))] + [own]
    by_doc = np.argsort(columns[0], kind="stable")
    return tuple(x[by_doc] for x in columns)


def _scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the contexts of each text, as lists."""
    for batch in found:
        held: list[tuple[int, int, bytes]] = []
        weight, got = 0, []
        for i, value in enumerate(batch.column(1)):
            data = value.as_py()
            for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
                part = data[at : at + CHUNK + LENGTH - 1]
                if held and weight + len(part) > CHUNK:
                    got.append(contexts(held))
                    held, weight = [], 0
                held.append((i, at, part))
                weight += len(part)
        if held:
            got.append(contexts(held))
        doc, h, c, s, e, own = once_each(*(np.concatenate(x) for x in zip(*got)), batch.column(0).to_numpy()) if got else (np.empty(0, np.int64),) * 6
        offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        columns = ((h, pa.int64()), (c, pa.int64()), (s.astype(np.int32), pa.int32()), (e.astype(np.int32), pa.int32()), (own.astype(bool), pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in columns)], names=["cid", "h", "c", "s", "e", "own"])


def _mark(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts in order of (anchor, content): those whose anchor others have, `whole` where one of equal content is
    among them, `fetch` for the first of each content where the anchor has several. Neighbours decide, so that an anchor
    may have any number of contexts: what is held is one batch, the last row, and an anchor's first row."""
    names = ["h", "c", "cid", "s", "e"]
    held = None  # the last row, and whether it equals the one before in (anchor, content)
    opening = None  # the first row of the current anchor, until a second content is seen

    def give(rows: list[np.ndarray], whole: np.ndarray, fetch: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), pa.array(whole), pa.array(fetch)], names=[*names, "whole", "fetch"])

    def handle(rows: list[np.ndarray], before: tuple | None, final: bool):
        nonlocal opening
        h, c = rows[0], rows[1]
        n = len(h)
        same_h, same_c = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # with the row before
        same_h[1:n] = h[1:] == h[:-1]
        same_c[1:n] = same_h[1:n] & (c[1:] == c[:-1])
        if before is not None:
            same_h[0], same_c[0] = before[0] == h[0], before[0] == h[0] and before[1] == c[0]
        size = n if final else n - 1  # the last row waits for its successor
        own = rows[5][:size].astype(bool)
        shared = same_h[:size] | same_h[1 : size + 1] | own
        whole = same_c[:size] | same_c[1 : size + 1] | own
        change = same_h[:n] & ~same_c[:n]
        fetch = change[:size].copy()
        extra = []
        heads = np.flatnonzero(~same_h[:n])
        group = np.searchsorted(heads, np.flatnonzero(change), side="right") - 1  # -1: the anchor began in an earlier batch
        for g in np.unique(group).tolist():
            if g < 0:
                if opening is not None:
                    extra.append(opening)
                    opening = None
            elif heads[g] < size:
                fetch[heads[g]] = True
        if len(heads):
            opening = None if len(group) and group[-1] == len(heads) - 1 else tuple(int(x[heads[-1]]) for x in rows[:5])
        if shared.any():
            yield give([x[:size][shared] for x in rows[:5]], whole[shared], fetch[shared])
        if extra:
            yield give([np.array([r[i] for r in extra]) for i in range(5)], np.zeros(len(extra), bool), np.ones(len(extra), bool))

    before = None
    for batch in found:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if held is not None:
            rows = [np.concatenate([[a], b]) for a, b in zip(held, rows)]
        if len(rows[0]) > 1:
            yield from handle(rows, before, False)
            before = (rows[0][-2], rows[1][-2])
        held = tuple(x[-1] for x in rows)
    if held is not None:
        yield from handle([np.array([x]) for x in held], before, True)


CONTEXTS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("cid", pa.int64()), ("s", pa.int64()), ("data", pa.binary())])
SPANS = pa.schema([("cid", pa.int64()), ("start", pa.int64()), ("until", pa.int64())])


def _fetch(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""

    def rows():
        for batch in found:
            for cid, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = data.as_py()
                for w in wanted:
                    part = data[w["s"] : w["e"] + LENGTH]
                    yield len(part) + 40, (w["h"], w["c"], cid, w["s"], part)

    yield from batches(rows(), CONTEXTS)


def repeated(parts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its starts have a string that also starts elsewhere in the contexts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_array(data)
    common = common_prefixes(data, order, LENGTH)
    valid = np.zeros(len(data), bool)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    marks = np.zeros(len(data) + 1, np.int32)
    marks[begins] += 1
    marks[ends - LENGTH + 1] -= 1
    valid = np.cumsum(marks[:-1]) > 0
    run = np.cumsum(common[order] < LENGTH)  # suffixes that begin with the same string
    counts = np.bincount(run[valid[order]], minlength=run[-1] + 1)
    twice = np.zeros(len(data), bool)
    twice[order] = counts[run] > 1
    twice &= valid
    return [twice[b : e - LENGTH + 1] for b, e in zip(begins.tolist(), ends.tolist())]


def matched(shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans that strings found elsewhere cover, from contexts in order of anchor: whole anchors are put together until
    their bytes make a shard, and each shard gets its suffix array. Anchors with one content are passed over."""

    def solve(held: list[tuple]):
        for (_, _, cid, s, _), hit in zip(held, repeated([r[4] for r in held])):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
                yield 24, (cid, s + a, s + b - 1 + LENGTH)

    def rows(found: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        opened, weight = 0, 0  # where the last anchor begins, and the bytes of those before it
        for batch in found:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and row[0] != held[-1][0]:
                    if len(held) == opened + 1:
                        held.pop()
                    weight += sum(len(r[4]) for r in held[opened:])
                    if weight >= shard:
                        yield from solve(held)
                        held, weight = [], 0
                    opened = len(held)
                if len(held) > opened and held[-1][:2] == row[:2]:
                    continue  # a repeated row of the same document
                held.append(row)
        if len(held) == opened + 1:
            held.pop()
        if held:
            yield from solve(held)

    return lambda found: batches(rows(found), SPANS)


PARTS = pa.schema([*CONTEXTS, ("at", pa.int64())])


def narrowed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts cut by where in their strings the anchor lies, `width` neighbouring places in one part. All strings of a
    part have the bytes around the anchor that its first and last place share: their hash is the part's key. `at` is the
    place of the anchor in the context, null where it is yet to be found."""

    def rows(found: Iterator[pa.RecordBatch]):
        for batch in found:
            for h, _, cid, s, data, at in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if at is None:
                    sums = prefix_sums(np.frombuffer(data, np.uint8))
                    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(data) - GRAM + 1])
                    at = int(np.argmax(grams.view(np.int64) == h))
                low, high = at - (len(data) - LENGTH), at
                for k in range(low // width, high // width + 1):
                    first, last = k * width, min((k + 1) * width - 1, LENGTH - GRAM)
                    a, b = max(first, low), min(last, high)
                    part, shared = data[at - b : at - a + LENGTH], data[at - first : at - last + LENGTH]
                    key = hashlib.blake2b(b"%d:%d:%d:" % (h, width, k) + shared, digest_size=8).digest()
                    content = hashlib.blake2b(part, digest_size=8).digest()
                    yield len(part) + 48, (int.from_bytes(key, "big", signed=True), int.from_bytes(content, "big", signed=True), cid, s + at - b, part, b)

    return lambda found: batches(rows(found), PARTS)


def thinned(fetched: DataFrame, heavy: DataFrame, shard: int) -> tuple[DataFrame, list[DataFrame]]:
    """fetched with the anchors of `heavy`, whose contexts exceed a shard, dealt anew: parts that keep no key to themselves
    meet in smaller groups, round by round, and those of equal content are whole. Contexts, and spans of whole parts.

    A context has at most four parts a round, of which those stay whose strings have the neighbours of many others."""
    light, spans = fetched.join(heavy, "h", "left_anti"), []
    held = fetched.join(heavy, "h", "left_semi").withColumn("at", F.lit(None).cast("long"))
    for width in WIDTHS:
        parts = stage(held.mapInArrow(narrowed(width), "h long, c long, cid long, s long, data binary, at long"), "dedup-parts")
        contents = parts.groupBy("h", "c").agg(F.count("*").alias("n"), F.first(F.struct("cid", "s", "data", "at")).alias("x"))
        contents = stage(contents.select("h", "c", "x.cid", "x.s", "x.data", "x.at", "n"), "dedup-contents")
        salted = contents.where("n > 1").select("h", "c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        whole = parts.withColumn("salt", F.pmod(F.xxhash64("cid", "s"), F.lit(SALTS)).cast("int")).join(salted, ["h", "c", "salt"], "left_semi")
        spans.append(whole.select("cid", F.col("s").alias("start"), (F.col("s") + F.length("data")).alias("until")))
        contents = contents.drop("n")
        heavy = stage(contents.groupBy("h").agg(F.sum(F.length("data")).alias("size"), F.count("*").alias("n")).where(f"size > {shard} and n > 1").select("h"), "dedup-heavy")
        light = light.unionByName(contents.join(heavy, "h", "left_anti").drop("at"))
        if heavy.isEmpty():
            break
        held = contents.join(heavy, "h", "left_semi")
    return light, spans


KEPT = pa.schema([("cid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def removed_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_bytes: bool = False, shard: int = SHARD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row: each byte of the texts' UTF-8 that a string of 200
    bytes covers which also starts anywhere else, in the same text or another, is removed; strings never cross texts.
    With keep_bytes, `kept` has the remaining bytes where some but not all were removed.

    Equal texts of 200 bytes or more are removed whole, and one of each takes part in the rest. Strings are dealt out by
    their anchors, which equal strings share: contexts of an anchor no one else has are done, contexts of equal content
    are covered whole, and where an anchor has contexts of different content, their bytes are fetched and ordered in
    suffix arrays by shard; neighbours with 200 bytes in common repeat. An anchor whose contexts exceed a shard is dealt
    anew by the bytes around it (thinned()). Contents are compared by 64-bit hashes but for the suffix arrays, which
    compare bytes.

    Null and empty texts have 0 bytes; texts under 200 bytes lose none; null keys and repeated rows count as texts of
    their own; an empty table gives no rows; other columns are ignored. What a task holds is a batch, or two shards.
    """
    n = partitions(docs.sparkSession)
    named = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("data")).withColumn("cid", F.xxhash64("data"))
    base = stage(named.select("key", F.length("data").cast("long").alias("n_bytes"), "cid", F.sha2("data", 256).alias("whole_sha256")), "dedup-base")
    classes = base.groupBy("cid").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    lists = named.select("cid", "data").mapInArrow(_scan, "cid long, h array<long>, c array<long>, s array<int>, e array<int>, own array<boolean>").where("size(h) > 0")
    once = lists.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("h", "c", "s", "e", "own")])
    rows = once.select("cid", F.explode(F.arrays_zip("h", "c", "s", "e", "own")).alias("x")).select("x.h", "x.c", "cid", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.own")
    marked = stage(rows.repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(_mark, "h long, c long, cid long, s long, e long, whole boolean, fetch boolean"), "dedup-marked")
    wanted = marked.groupBy("cid").agg(F.collect_list(F.when(F.col("fetch"), F.struct("h", "c", "s", "e"))).alias("wanted")).join(classes, "cid")
    texts = stage(named.join(wanted, "cid").where(F.col("key").eqNullSafe(F.col("least"))).select("cid", "data", "wanted", "copies"), "dedup-texts")
    fetched = texts.where("size(wanted) > 0").select("cid", "data", "wanted").mapInArrow(_fetch, "h long, c long, cid long, s long, data binary")
    sizes = marked.where("fetch").groupBy("h").agg(F.sum(F.col("e") - F.col("s") + LENGTH).alias("size"))
    heavy = stage(sizes.where(f"size > {shard}").select("h"), "dedup-heavy")
    spans = [marked.where("whole").select("cid", F.col("s").alias("start"), (F.col("e") + LENGTH).alias("until"))]
    if not heavy.isEmpty():
        fetched, more = thinned(fetched, heavy, shard)
        spans += more
    spans.append(fetched.repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(matched(shard), "cid long, start long, until long"))
    spans = reduce(DataFrame.unionByName, spans)
    cover = spans.groupBy("cid").agg(F.collect_list(F.struct("start", "until")).alias("spans"))

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            for batch in found:
                for cid, data, covered in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    data = data.as_py()
                    at, gone, runs, kept = 0, 0, 0, []
                    end = -1
                    for a, b in sorted((x["start"], x["until"]) for x in covered):
                        if a > end:
                            kept.append(data[at:a])
                            runs += 1
                            gone += b - a
                            end = b
                        elif b > end:
                            gone += b - end
                            end = b
                        at = max(at, end)
                    kept.append(data[at:])
                    left = b"".join(kept)
                    yield 100 + len(left) * keep_bytes, (cid, gone, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None)

        yield from batches(done(), KEPT)

    partly = texts.where("copies = 1").select("cid", "data").join(cover, "cid").mapInArrow(cut, "cid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    joined = base.join(classes.select("cid", "copies"), "cid").join(partly, "cid", "left")
    columns = [
        F.col("key").alias(key), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    return joined.select(*columns, *(["kept"] if keep_bytes else []))
