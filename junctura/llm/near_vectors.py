"""Near-duplicate vectors: sign hashes in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage
from .components import components
from .shingles import mixed
from .vectors import NO_ID, finite, matrix, runs

THRESHOLD = 0.93
#: A pair at the threshold is found with this probability; nearer pairs with higher ones.
RECALL = 0.9999


def planes(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = 512) -> tuple[int, int]:
    """Bits of a table's hash and the number of tables for n vectors that may be compared with each other: so many bits that
    unlike vectors make buckets of `bucket`, and so many tables that a pair at the threshold meets in one with probability
    `recall`."""
    bits = min(40, max(4, ceil(log2(max(n, 1) / bucket)) if n > bucket else 4))
    alike = (1 - acos(threshold) / pi) ** bits
    return bits, 1 if alike >= 1 else ceil(log(1 - recall) / log(1 - alike))


def _units(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists by length; components are scaled first, so that squares stay in range."""
    sizes = np.diff(np.asarray(lists.offsets))
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        v = matrix(lists.take(pa.array(at)), width)
        v /= np.abs(v).max(1, keepdims=True)
        yield at, v / np.sqrt((v * v).sum(1, keepdims=True))


def _signed(classes: DataFrame, bits: int, tables: int, code_bits: int, seed: int) -> DataFrame:
    """Adds keys (array<long>: a hash of group, table and signs for each table) and code (the same of code_bits signs)."""

    def sign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in found:
            group = np.asarray(batch.column(2)).astype(np.uint64)
            keys, code = np.zeros((batch.num_rows, tables), np.uint64), np.zeros(batch.num_rows, np.uint64)
            for at, unit in _units(batch.column(4)):
                width = unit.shape[1]
                if width not in drawn:
                    drawn[width] = np.random.default_rng([seed, width]).standard_normal((width, max(tables * bits, code_bits)))
                above = unit @ drawn[width] >= 0
                weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
                for t in range(tables):
                    keys[at, t] = (above[:, t * bits : (t + 1) * bits] * weights[:bits]).sum(1, dtype=np.uint64) + np.uint64((t << 40) + width)
                code[at] = (above[:, :code_bits] * weights[:code_bits]).sum(1, dtype=np.uint64)
            keys, code = mixed(mixed(keys) ^ group[:, None]), mixed(mixed(code) ^ group)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(code.astype(np.int64))], names=[*batch.schema.names, "keys", "code"])

    kind = dict(classes.dtypes)["v"]
    return classes.mapInArrow(sign, f"id long, h long, grp long, n long, v {kind}, keys array<bigint>, code long")


def _cores(signed: DataFrame, threshold: float, block: int, tables: int = 4) -> DataFrame:
    """(id, h, core_id, core_h): vectors within half the threshold's angle of a pivot. All pairs of a core link for sure.

    Pivots are members of crowds: `block` vectors or more that agree in many signs. Each bucket of the first tables has at
    most one, so a vector meets at most `tables` of them, of which it takes the least.
    """
    node = F.struct("id", "h")
    crowds = signed.groupBy("grp", "code").agg(F.count("*").alias("size"), F.min_by(F.struct("id", "h", "v", "keys"), node).alias("p")).where(F.col("size") >= block)
    first = lambda keys: F.slice(keys, 1, tables)
    pivots = crowds.select("size", "p.id", "p.h", "p.v", F.explode(first("p.keys")).alias("key")).groupBy("key").agg(F.max_by(F.struct("id", "h", "v"), F.struct("size", F.negative("id"))).alias("p"))
    met = signed.select("id", "h", "v", F.explode(first("keys")).alias("key")).join(pivots, "key").select("id", "h", F.col("p.id").alias("core_id"), F.col("p.h").alias("core_h"), "v", F.col("p.v").alias("w"))
    sure = cos(acos(threshold) / 2) + 1e-9

    def close(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keep = np.zeros(batch.num_rows, bool)
            pairs = zip(_units(batch.column(4)), _units(batch.column(5)))
            for (at, a), (_, b) in pairs:  # of one group, so of one length
                keep[at] = (a * b).sum(1) >= sure
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    near = met.mapInArrow(close, "id long, h long, core_id long, core_h long")
    return near.groupBy("id", "h").agg(F.min(F.struct("core_id", "core_h")).alias("c")).select("id", "h", "c.*")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """The members of each bucket in chunks of at most about 2 x block rows: (chunk, side, ...). A bucket of up to `block`
    members is one chunk. A larger one is cut into blocks, a large core into blocks of its own, and two blocks make a chunk,
    unless they belong to one core, whose pairs are known."""
    put = members.select("*", F.posexplode("keys").alias("nth", "key"))
    counts = stage(put.groupBy("key", "core").agg(F.count("*").alias("size")), "near-counts")
    large = counts.groupBy("key").agg(F.sum("size").alias("all")).where(F.col("all") > block).select("key")
    own = F.when((F.col("core") != 0) & (F.col("size") > block), F.col("core")).otherwise(F.lit(0))
    pools = counts.join(large, "key").select("key", "core", "size", own.alias("pool"))
    sizes = pools.groupBy("key", "pool").agg(F.sum("size").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    order = Window.partitionBy("key").orderBy("pool")  # a row per core of more than `block` members
    placed = sizes.withColumn("begin", (F.sum("blocks").over(order) - F.col("blocks")).cast("int")).withColumn("all", F.sum("blocks").over(Window.partitionBy("key")).cast("int"))
    plan = pools.select("key", "core", "pool").join(placed, ["key", "pool"]).select("key", "core", "pool", "blocks", "begin", "all")
    met = put.join(plan, ["key", "core"], "left")
    mine = F.coalesce(F.col("begin") + F.pmod(F.xxhash64("id", "h"), F.col("blocks")), F.lit(0)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.coalesce(F.col("all"), F.lit(1)) - 1), lambda j: F.coalesce(F.col("pool"), F.lit(0)).eqNullSafe(0) | (j < F.col("begin")) | (j >= F.col("begin") + F.col("blocks")))
    spread = met.withColumn("mine", mine).withColumn("other", F.explode(others))
    chunk = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return spread.select(chunk.alias("chunk"), (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") != F.col("other")).cast("int").alias("two"), "nth", "id", "h", "n", "core", "v", "keys")


def _groups(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected with."""
    root = np.arange(len(linked))
    left = linked.any(1)
    while left.any():
        first = int(left.argmax())
        seen = np.zeros(len(linked), bool)
        front = seen.copy()
        front[first] = True
        while front.any():
            seen |= front
            front = linked[front].any(0) & ~seen
        root[seen] = first
        left &= ~seen
    return root


def _compared(dealt: DataFrame, threshold: float) -> DataFrame:
    """(id, h, links, root_id, root_h) of the members that link in a chunk. A pair counts in the first table in which it meets,
    and not where both are of one core; so no pair is counted twice and none has to be sent."""

    def compare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: pa.Table) -> pa.RecordBatch | None:
            side, two, nth, ids, hs, n, core = (np.asarray(rows.column(i)) for i in range(1, 8))
            (_, unit), *_ = _units(rows.column(8).combine_chunks())  # a bucket's vectors have one length
            keys = matrix_of_longs(rows.column(9).combine_chunks(), len(ids))
            near = unit @ unit.T
            close = np.argwhere(np.abs(near - threshold) < 1e-9)
            for a, b in close.tolist():
                near[a, b] = float(np.dot(unit[a], unit[b]))
            linked = np.triu(near >= threshold, 1)
            if two[0]:
                linked &= side[:, None] != side[None, :]
            linked &= (core[:, None] != core[None, :]) | (core[:, None] == 0)
            a, b = np.nonzero(linked)
            if not len(a):
                return None
            t = int(nth[0])
            if t:
                for at in range(0, len(a), 1 << 16):
                    p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    met = (keys[p, :t] == keys[q, :t]).any(1)
                    linked[p[met], q[met]] = False
            linked |= linked.T
            links = linked @ n
            root = _groups(linked)
            told = np.flatnonzero(links)
            if not len(told):
                return None
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[told], hs[told], links[told], ids[root[told]], hs[root[told]])], names=["id", "h", "links", "root_id", "root_h"])

        held: list[pa.RecordBatch] = []
        for _, rows, opens in runs(found, 1):
            if opens and held:
                if out := solve(pa.Table.from_batches(held)):
                    yield out
                held = []
            held.append(rows)
        if held and (out := solve(pa.Table.from_batches(held))):
            yield out

    spark = dealt.sparkSession
    sorted_ = dealt.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")
    return sorted_.mapInArrow(compare, "id long, h long, links long, root_id long, root_h long")


def matrix_of_longs(lists: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.int64).reshape(rows, -1)


def linked_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = 256, bucket: int = 512, seed: int = 11, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): vectors of one label link where their cosine is `threshold` or more.

    Equal vectors of a label are one class with a number; classes are hashed by the signs of random projections into several
    tables (see planes()); members of a bucket are compared by exact cosines in double precision. Buckets hold every class of
    their key, in blocks (see _dealt()); crowds that link for certain are cores, which are counted and not compared. A pair
    counts where it first meets. Links and a spanning edge per member are added up by class, components come from large-star
    and small-star steps over tables, and no list of pairs is made or sent.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing:
    a row each with 0 links and themselves as component. Vectors of unlike lengths don't link. Repeated rows are vectors of
    their own, which link (also where their keys are equal); null keys come last, and a component without another key has
    null. component_id is the least key reachable. An empty table gives no rows; other columns are ignored.
    """
    v = F.col(vector)
    fit = finite(v) & F.col(label).isNotNull() & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    named = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(fit, F.lit(False)).alias("fit"), F.xxhash64(F.col(label), F.size(v)).alias("grp"), v.alias("v"), F.xxhash64(F.col(label), v).alias("h"), F.xxhash64(F.lit(seed), v, F.col(label)).alias("h2"))
    good = named.where("fit")
    classes = stage(good.groupBy("h", "h2").agg(F.min(F.coalesce("key", F.lit(NO_ID))).alias("id"), F.first("grp").alias("grp"), F.count("*").alias("n"), F.first("v").alias("v")), "near-classes")
    most = classes.groupBy("grp").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bits, tables = planes(most, threshold, recall, bucket)
    code_bits = min(60, bits * tables, bits + 16)
    signed = stage(_signed(classes.select("id", "h", "grp", "n", "v"), bits, tables, code_bits, seed), "near-signed")
    cores = stage(_cores(signed, threshold, block, min(4, tables)), "near-cores")
    core = F.when(F.col("core_id").isNotNull(), F.xxhash64("core_id", "core_h")).otherwise(F.lit(0)).alias("core")
    members = stage(signed.join(cores, ["id", "h"], "left").select("id", "h", "n", "v", "keys", core), "near-members")
    found = stage(_compared(_dealt(members, block), threshold), "near-links")
    edges = found.select(F.struct("id", "h").alias("u"), F.struct(F.col("root_id").alias("id"), F.col("root_h").alias("h")).alias("v")).unionByName(cores.select(F.struct("id", "h").alias("u"), F.struct(F.col("core_id").alias("id"), F.col("core_h").alias("h")).alias("v")))
    parts = components(edges).select("node.id", "node.h", F.col("component.id").alias("component"))
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    crowd = members.where("core <> 0").groupBy("core").agg(F.sum("n").alias("crowd"))
    sums = members.select("id", "h", "n", "core").join(links, ["id", "h"], "left").join(crowd, "core", "left").join(parts, ["id", "h"], "left")
    # Of its core and of its class, a member links with all but itself; the class is part of the core.
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("crowd", F.col("n")) - 1
    by_class = sums.select("id", "h", n_links.alias("n_links"), F.coalesce("component", F.col("id")).alias("component"))
    known = classes.select("id", "h", "h2").join(by_class, ["id", "h"]).select("h", "h2", "n_links", "component")
    joined = good.select("key", "h", "h2").join(known, ["h", "h2"]).select("key", "n_links", "component")
    alone = named.where("not fit").select("key", F.lit(0).cast("long").alias("n_links"), F.coalesce("key", F.lit(NO_ID)).alias("component"))
    told = F.when(F.col("component") != NO_ID, F.col("component"))
    return joined.unionByName(alone).select(F.col("key").alias(key), "n_links", told.alias("component_id"), F.coalesce(F.col("key") == told, F.lit(False)).alias("kept"))
