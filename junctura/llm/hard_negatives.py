"""Hard negatives: exact nearest vectors by one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage
from .vectors import NO_ID, finite, matrix, runs

#: At most so many pivots, and intervals of each pivot's distances; the driver and each task hold a few numbers for each.
PIVOTS, RINGS = 64, 64
#: Rows of a part of an interval, and queries that meet it at a time.
PART = (512, 4096)
QUERIES = 2048
#: Scaled components are cut to it on both sides, which keeps scores finite.
LARGEST = float(1 << 31)
#: Rows that a query's first scan covers, and by how much each further scan grows.
FIRST_SCAN, GROWTH = 4096, 16


@dataclass(frozen=True)
class Index:
    """`table`: (pivot, distance, ring, part, row, id, label, v), written in order of (pivot, distance). Vectors x of whole
    numbers are augmented by sqrt(bound - |x|^2), so that they all have one norm, and a query by zero: the nearer an augmented
    vector, the higher its inner product. `rings` has for each interval of a pivot's distances its least and greatest
    distance, rows and parts."""

    table: DataFrame
    pivots: np.ndarray
    bound: float
    width: int
    scale: float
    rings: np.ndarray


def _whole(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    return np.clip(np.floor(matrix(lists, width) * scale), -LARGEST, LARGEST)


def _augmented(x: np.ndarray, bound: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, bound - (x * x).sum(1)))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, squares))


def build_index(rows: DataFrame, scale: float = 256) -> Index:
    """The index of rows (row, id, label, v). Pivots are up to PIVOTS rows of least hash, which bounds them; every row is
    indexed. Each row has its nearest pivot; a pivot's distances are cut at approximate quantiles into rings, and a ring that
    many equal distances make large is cut into parts by hash."""
    v = F.transform("v", lambda x: F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.floor(x.cast("double") * scale).cast("double"))))
    size = rows.select(F.size("v").alias("w"), F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x).alias("n2")).agg(F.count("*").alias("n"), F.max("w").alias("w"), F.max("n2").alias("n2")).first()
    n, width, bound = size["n"], size["w"] or 0, (size["n2"] or 0.0) * (1 + 1e-9) + 1
    part = min(PART[1], max(PART[0], n // 1024))
    wanted = min(PIVOTS, max(4, n // (4 * part)))
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("v", "id"), "row").select("v").limit(wanted).collect()]
    pivots = np.unique(_augmented(_whole(pa.array(drawn or [[]], pa.list_(pa.float64())), width, scale), bound), axis=0)

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            apart = _distances(_augmented(_whole(batch.column(3), width, scale), bound), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart.argmin(1).astype(np.int32)), pa.array(apart.min(1))], names=[*batch.schema.names, "pivot", "distance"])

    kind = dict(rows.dtypes)["v"]
    placed = stage(rows.select("row", "id", "label", "v").mapInArrow(assign, f"row long, id long, label long, v {kind}, pivot int, distance double"), "keys-placed")
    steps = [i / RINGS for i in range(1, RINGS)]
    cuts: dict[int, np.ndarray] = {}
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", steps, 10_000).alias("q")).collect():  # a row per pivot
        rings = min(RINGS, max(1, -(-r["n"] // part)))
        cuts[r["pivot"]] = np.unique([r["q"][i * RINGS // rings - 1] for i in range(1, rings)])

    def ringed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            pivot, distance = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ring = np.zeros(batch.num_rows, np.int32)
            for p in np.unique(pivot).tolist():
                own = pivot == p
                ring[own] = np.searchsorted(cuts[p], distance[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], names=[*batch.schema.names, "ring"])

    order = ["pivot", "distance", F.xxhash64("row")]
    ordered = placed.select("pivot", "distance", "row", "id", "label", "v").repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    table = stage(ordered.mapInArrow(ringed, f"pivot int, distance double, row long, id long, label long, v {kind}, ring int"), "keys-table")
    rings = table.groupBy("pivot", "ring").agg(F.min("distance"), F.max("distance"), F.count("*")).collect()  # at most PIVOTS x RINGS
    told = np.array([[p, r, a, b, c, -(-c // part)] for p, r, a, b, c in rings], float).reshape(-1, 6)
    parts = rows.sparkSession.createDataFrame([(int(r[0]), int(r[1]), int(r[5])) for r in told], "pivot int, ring int, parts int")
    parted = table.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))  # a row per ring
    return Index(parted, pivots, bound, width, scale, told)


SLOTS = "array<struct<slot:int,lo:double,hi:double,kth:double>>"


def _visits(queries: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """A row for each query and part of a ring in the scan: a query's rings in order of the best score that they can hold, of
    which this scan takes those that begin after `begin` and before `end` rows. A ring is passed over for good where, for
    each slot, it can't hold a score from max(lo, kth) to hi."""
    rings, pivots, bound, width, scale = index.rings, index.pivots, index.bound, index.width, index.scale

    def plan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, least, most, sizes, parts = rings[:, 0].astype(int), rings[:, 2], rings[:, 3], rings[:, 4], rings[:, 5].astype(int)
        for batch in found:
            x = _whole(batch.column(2), width, scale)
            own = (x * x).sum(1)
            apart = _distances(np.column_stack([x, np.zeros(len(x))]), pivots)
            slots = batch.column(3).to_pylist()
            picks, where = [], []
            for i in range(len(x)):
                d = apart[i, of]
                near, far = np.maximum(0, np.maximum(d - most, least - d)), d + most
                slack = 1e-9 * (own[i] + bound) + 1e-3
                best, worst = (own[i] + bound - near * near) / 2 + slack, (own[i] + bound - far * far) / 2 - slack
                order = np.lexsort((np.arange(len(d)), -best))
                before = np.cumsum(sizes[order]) - sizes[order]
                order = order[(before >= begin) & (before < end)]
                need = np.zeros(len(order), bool)
                for s in slots[i]:
                    need |= (best[order] >= max(s["lo"], s["kth"])) & (worst[order] <= s["hi"])
                for r in order[need].tolist():
                    picks += [i] * parts[r]
                    where += [(rings[r, 0], rings[r, 1], p) for p in range(parts[r])]
            for at in range(0, len(picks), 10_000):
                p = pa.array(picks[at : at + 10_000], pa.int32())
                to = np.array(where[at : at + 10_000], np.int32).reshape(-1, 3)
                rows = batch.take(p)
                yield pa.RecordBatch.from_arrays([*(pa.array(to[:, j]) for j in range(3)), *rows.columns], names=["pivot", "ring", "part", "row", "label", "v", "slots"])

    kind = dict(queries.dtypes)["v"]
    return queries.select("row", "label", "v", "slots").mapInArrow(plan, f"pivot int, ring int, part int, row long, label long, v {kind}, slots {SLOTS}")


def _scanned(visits: DataFrame, index: Index, n_queries: int, k: int, same: bool) -> DataFrame:
    """(query, slot, id, row, score): for each query and slot of a visit the first k rows of the part in its window. The rows of
    a part and at most about QUERIES of its queries meet in a task, the queries first; rings that no query visits aren't sent."""
    lots = max(1, -(-n_queries // QUERIES))
    width, scale = index.width, index.scale
    key = ["pivot", "ring", "part", "lot"]
    asking = visits.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int"))
    visited = F.broadcast(visits.select("pivot", "ring").distinct())  # at most PIVOTS x RINGS rows
    data = index.table.join(visited, ["pivot", "ring"], "left_semi").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asking.select(*key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "row", "label", "v", "slots")
    both = asked.unionByName(data.select(*key, F.lit(1).alias("kind"), "id", "row", "label", "v", F.lit(None).cast(SLOTS).alias("slots")))

    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None
        for key, rows, opens in runs(found, 5, 512):
            if key[4] == 0:
                if opens:
                    if best:
                        yield from best.told()
                    group, held, best = key[:4], [], None
                held.append(rows)
            elif key[:4] == group:  # rows without queries are passed over
                if best is None:
                    asked = pa.Table.from_batches(held).combine_chunks()
                    best = _Best(asked, _whole(asked.column(8).combine_chunks(), width, scale), k, same)
                    held = []
                best.meet(rows, _whole(rows.column(8), width, scale))
        if best:
            yield from best.told()

    met = both.repartition(partitions(visits.sparkSession), *key).sortWithinPartitions(*key, "kind")
    return met.mapInArrow(scan, "query long, slot int, id long, row long, score double")


class _Best:
    """The first k rows so far of some queries, by slot."""

    def __init__(self, asked: pa.Table, x: np.ndarray, k: int, same: bool):
        self.rows, self.labels, self.x, self.k, self.same = np.asarray(asked.column(6)), np.asarray(asked.column(7)), x, k, same
        slots = asked.column(9).to_pylist()
        self.windows = {s: np.full((3, len(slots)), np.nan) for s in sorted({s["slot"] for q in slots for s in q})}
        for i, q in enumerate(slots):
            for s in q:
                self.windows[s["slot"]][:, i] = s["lo"], s["hi"], s["kth"]
        self.roof = np.array([max((s["hi"] for s in q), default=-np.inf) for q in slots])
        self.best: dict[int, tuple[np.ndarray, ...]] = {}

    def meet(self, rows: pa.RecordBatch, y: np.ndarray) -> None:
        ids, own = np.asarray(rows.column(5)), np.asarray(rows.column(6))
        floor = np.full(len(self.roof), np.inf)
        for lo, _, kth in self.windows.values():
            floor = np.fmin(floor, np.fmax(lo, kth))
        scores = self.x @ y.T
        alike = self.labels[:, None] == np.asarray(rows.column(7))[None, :]
        q, r = np.nonzero((scores >= floor[:, None]) & (scores <= self.roof[:, None]) & (alike if self.same else ~alike))
        other = self.rows[q] != own[r]
        q, r = q[other], r[other]
        found = scores[q, r]
        for s, (lo, hi, kth) in self.windows.items():
            into = (found >= lo[q]) & (found <= hi[q]) & (found >= kth[q])
            if into.any():
                self._merge(s, (q[into], -found[into], ids[r[into]], own[r[into]]), kth)

    def _merge(self, s: int, new: tuple[np.ndarray, ...], kth: np.ndarray) -> None:
        both = tuple(np.concatenate(c) for c in zip(self.best[s], new)) if s in self.best else new
        order = np.lexsort(both[::-1])  # by query, then falling score, then id
        q = both[0][order]
        starts = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1])
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        self.best[s] = tuple(c[order[nth < self.k]] for c in both)
        last = order[nth == self.k - 1]
        kth[both[0][last]] = np.maximum(kth[both[0][last]], -both[1][last])

    def told(self) -> Iterator[pa.RecordBatch]:
        for s, (q, minus, ids, rows) in self.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[q]), pa.array(np.full(len(q), s, np.int32)), pa.array(ids), pa.array(rows), pa.array(-minus)], names=["query", "slot", "id", "row", "score"])


def search(queries: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(query, slot, nth from 1, id, row, score): for each slot of each query (row, label, v, slots) the first k rows of its own
    label (or of all others) with a score from lo to hi, by falling score, then id; exact.

    Scans widen until every ring that is left can't hold a better row than the k-th: the first covers about FIRST_SCAN rows
    of each query's likeliest rings, each further one GROWTH times as many. Between scans, the k best so far are a table.
    """
    n_queries, n = queries.count(), int(index.rings[:, 4].sum())
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row")
    begin, end, best = 0, FIRST_SCAN, None
    while best is None or begin < n:
        asking = queries
        if best is not None:
            full = best.where(F.col("nth") == k).groupBy(F.col("query").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))
            tighter = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.coalesce(F.try_element_at("full", s["slot"]), s["kth"]).alias("kth")))
            asking = queries.join(full, "row", "left").select("row", "label", "v", tighter.alias("slots"))
        found = _scanned(_visits(asking, index, begin, end), index, n_queries, k, same)
        if best is not None:
            found = found.unionByName(best.drop("nth"))
        best = stage(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), "keys-best")
        begin, end = end, end * GROWTH
    return best


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row whose key is
    divisible by `every`) and each of its first `positives` other rows of the same label, the first `negatives` rows of other
    labels whose score is from `low` to `high` per cent of the positive's. A score is the inner product of floor(scale * x);
    higher ones come first, ties by smaller key. Exact; see search().

    Rows with a null label, a null vector or a null or non-finite component take no part. Labels are whole numbers. Shorter
    vectors count as if zeros followed; scaled components are cut to 2^31 on both sides, and scores are exact below 2^53.
    Repeated rows are rows of their own, and so are anchors of one key; null keys come last and are no anchors. A positive of
    negative score has no window and so no negatives. An empty table gives no rows; other columns are ignored.
    """
    fit = rows.where(F.col(label).isNotNull() & finite(F.col(vector)))
    named = fit.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    base = stage(named.withColumn("row", F.monotonically_increasing_id()), "keys-rows")
    index = build_index(base, scale)
    anchors = base.where((F.col("id") % every == 0) & (F.col("id") != NO_ID))
    slot = lambda nth, lo, hi: F.struct(nth.alias("slot"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(float("-inf")).alias("kth"))
    all_scores = F.array(slot(F.lit(0), F.lit(float("-inf")), F.lit(float("inf"))))
    found = search(anchors.select("row", "label", "v", all_scores.alias("slots")), index, positives, True)
    near = stage(found.select("query", F.col("nth").alias("slot"), F.col("id").alias("positive"), F.col("score").cast("long").alias("positive_score")), "keys-positives")
    window = slot(F.col("slot"), F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"positive_score * {high} div 100"))
    asked = near.where("positive_score >= 0").groupBy(F.col("query").alias("row")).agg(F.collect_list(window).alias("slots"))
    against = stage(anchors.join(asked, "row").select("row", "label", "v", "slots"), "keys-anchors")
    far = search(against, index, negatives, False)
    told = far.join(near, ["query", "slot"]).join(anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor")), "query")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return told.select(F.col("anchor").alias("anchor_id"), known("positive").alias("positive_id"), F.col("nth").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))
