"""Association of events with a predictor: binomial regression per event, permutation nulls, adjusted p values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import adjusted, spread, staged
from .exclusion import PACKED, Group, groups_of, listed_pairs

METRICS = ("CoxSnell", "Nagelkerke")
LOW = 1e-8
#: An R2 this near to zero is zero: it is what rounding leaves of it.
TIE = 1e-12
STEPS, CLOSE = 100, 1e-6
#: Draws that are fitted at a time, and rows of a null table have at most so many.
BLOCK = 32
#: Cells above which an event is fitted by sums over tasks, and how many fits of such events move together.
SPLIT, LOT = 100_000, 8448
#: Cells that a task brings together by event at a time.
GATHERED = 1 << 20
#: Bytes of permutations that a task keeps; more are made again for each lot of events.
KEPT = 1 << 28
#: Levels up to which a predictor's cells are added up by level, how many sums of each (see _fit_sums()), and the ratio up to
#: which these tell a Newton step to the last digits.
LEVELS, SUMS, ROUGH = 8, 5, 1e-3
#: Counts of groups that are added up together, and cells at a time.
LISTED, STRIP = 1 << 24, 1024


def _chance(eta: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(eta))
    return np.clip(np.where(eta >= 0, 1 / (1 + e), e / (1 + e)), LOW, 1 - LOW)


def _weighted(y: np.ndarray, n: np.ndarray, z: np.ndarray, eta: np.ndarray, k: np.ndarray | float = 1.0) -> tuple[np.ndarray, ...]:
    """What the five sums of a Newton step add up, for k cells of n each that have y together."""
    p = _chance(eta)
    one = n * p * (1 - p)
    w = k * one
    work = w * eta + (y - k * n * p) * (one / (one + LOW))
    return w, w * z, w * z * z, work, z * work


def _own_terms(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Half of the deviance's part that no fit changes, by cell."""
    term = lambda a: np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / n), 0.0)
    return term(y) + term(n - y)


def _gain_terms(y: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, k: np.ndarray | float = 1.0) -> np.ndarray:
    """The deviance of chances p less that of q, by cell or by k cells of n."""
    return 2 * (y * np.log(q / p) + (k * n - y) * np.log((1 - q) / (1 - p)))


def _null_deviance(own: np.ndarray, sum_y: np.ndarray, sum_n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """From sums over an event; what rounding leaves of zero is zero."""
    found = 2 * (own - sum_y * np.log(q) - (sum_n - sum_y) * np.log(1 - q))
    return np.where(found > 1e-13 * (np.abs(own) + sum_n), found, 0.0)


def _signed_root(gain, null, sizes, slope, failed, metric: str) -> np.ndarray:
    """The root of pseudo-R2 with the slope's sign; NaN for fits that failed and where R2 is below zero."""
    r2 = 1 - np.exp(gain / sizes)
    if metric == "Nagelkerke":
        most = 1 - np.exp(-null / sizes)
        r2 = np.where(most == 0, np.nan, r2 / most)
    r2 = np.where(np.abs(r2) < TIE, 0.0, r2)
    return np.where(failed | ~(r2 >= 0), np.nan, np.sqrt(np.abs(r2)) * np.where(slope >= 0, 1.0, -1.0))


class _Newton:
    """Coefficients of many fits at once, moved by their sums until they stand still."""

    def __init__(self, valid: np.ndarray):
        self.b0, self.b1 = np.zeros(valid.shape), np.zeros(valid.shape)
        self.going, self.failed = valid.copy(), ~valid

    def move(self, s0, s1, s2, t0, t1) -> None:
        det = s0 * s2 - s1 * s1
        c0, c1 = (s2 * t0 - s1 * t1) / det, (s0 * t1 - s1 * t0) / det
        bad = self.going & (~np.isfinite(det) | (det == 0) | ~np.isfinite(c0) | ~np.isfinite(c1))
        self.failed |= bad
        self.going &= ~bad
        step = np.maximum(np.abs(c0 - self.b0), np.abs(c1 - self.b1))
        self.b0, self.b1 = np.where(self.going, c0, self.b0), np.where(self.going, c1, self.b1)
        self.going &= step >= CLOSE


def fit_events(starts: np.ndarray, y: np.ndarray, n: np.ndarray, z: np.ndarray, metric: str, k: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Signed root of pseudo-R2 of a binomial regression of y out of n on z, for many events at once.

    Events are stretches that begin at `starts` of the vectors y and n and of the last axis of z (draws by cells). All
    events and draws take Newton steps together, at most STEPS; one that has converged keeps its last step. NaN where there
    are fewer than two cells, one of the counts has no sum, the equations are singular, or R2 is negative. With k, a place
    stands for k cells of n each with y together (both draws by places), and `own` has each event's sum of _own_terms().
    """
    places = np.diff(np.append(starts, y.shape[-1]))
    total = lambda v: np.add.reduceat(v, starts, axis=-1)
    spread = lambda v: np.repeat(v, places, axis=-1)
    with np.errstate(all="ignore"):
        own = total(_own_terms(y, n)) if own is None else own
        sizes, k = (places, 1.0) if k is None else (total(k), k)
        sum_y, sum_n = total(y), total(k * n)
        fit = _Newton(np.broadcast_to((sizes >= 2) & (sum_y > 0) & (sum_n - sum_y > 0), (z.shape[0], len(starts))))
        for _ in range(STEPS):
            if not fit.going.any():
                break
            fit.move(*map(total, _weighted(y, n, z, spread(fit.b0) + spread(fit.b1) * z, k)))
        q = np.clip(sum_y / sum_n, LOW, 1 - LOW)
        gain = total(_gain_terms(y, n, _chance(spread(fit.b0) + spread(fit.b1) * z), spread(q), k))
        return _signed_root(gain, _null_deviance(own, sum_y, sum_n, q), sizes, fit.b1, fit.failed, metric)


def permutations(n_cells: int, n: int, seed: int | None) -> np.ndarray:
    """One permutation of the cells per draw, shared by all events."""
    return np.concatenate([np.empty((0, n_cells), np.int32), *(orders for _, orders in order_blocks(n_cells, n, seed))])


def order_blocks(n_cells: int, draws: int | np.ndarray, seed: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(first draw from 1, permutations of the cells) in blocks of at most BLOCK draws, of which one is held at a time. A seed
    gives the same draws, however they are cut."""
    rng = np.random.default_rng(seed)
    for at in range(0, draws if isinstance(draws, int) else len(draws), BLOCK):
        if isinstance(draws, int):
            yield at + 1, np.array([rng.permutation(n_cells) for _ in range(min(BLOCK, draws - at))], np.int32).reshape(-1, n_cells)
        else:
            yield at + 1, draws[at : at + BLOCK]


BLOCKS = "event_idx long, first int, observed double, n_valid int, mean double, m2 double, exceed long, null array<double>"
_KINDS = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
_NAMES = ["event_idx", "first", "observed", "n_valid", "mean", "m2", "exceed", "null"]


def _told(events: list[int], observed: np.ndarray, first: int, draws: np.ndarray, keep: bool) -> pa.RecordBatch:
    """A row per event for a block of draws (draws by events): how many are valid, their mean, squares about it, and how many
    reach the observed value."""
    known = ~np.isnan(draws)
    n = known.sum(0)
    with np.errstate(all="ignore"):
        mean = np.where(n > 0, np.nansum(draws, 0) / np.maximum(n, 1), 0.0)
        m2 = np.nansum((draws - mean) ** 2, 0)
        exceed = (np.abs(draws) >= np.abs(observed)).sum(0)
    clean = lambda v: [None if np.isnan(x) else float(x) for x in v]
    null = [clean(draws[:, i]) for i in range(len(events))] if keep else [None] * len(events)
    columns = [events, [first] * len(events), clean(observed), n, mean, m2, exceed, null]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


class _Event:
    """An event's cells, for draws of its predictor. Cells that agree in n and in the predictor's level are told by how many
    they are and what they add up to, which is all that a fit needs of them; so its steps don't grow with the cells, unless
    nearly each cell has a level of its own."""

    def __init__(self, idx: int, c: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray):
        """Rows of a cell add up; cells without counts are left out."""
        order = np.argsort(c, kind="stable")
        c = c[order].astype(np.int64)
        first = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
        a, b = (np.add.reduceat(v[order].astype(float), first) for v in (a, b))
        some = ~(a + b <= 0)
        self.idx, self.c, self.a, self.n, self.z = idx, c[first][some], a[some], (a + b)[some], z.astype(float)
        self.own = _own_terms(self.a, self.n).sum()
        self.codes, self.levels = pd.factorize(self.z, use_na_sentinel=False)
        self.n_codes, self.ns = pd.factorize(self.n)
        self.few = 2 * len(self.levels) * len(self.ns) <= len(self.c)
        self.width = len(self.levels) * len(self.ns) if self.few else len(self.c)
        if self.few:
            self.n_codes *= len(self.levels)

    def table(self, orders: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(y, n, z, k), draws by places; None is the one order that leaves all where they are."""
        at = [self.c] if orders is None else [o[self.c] for o in orders]
        wide = lambda v: np.broadcast_to(v, (len(at), self.width))
        if not self.few:
            return wide(self.a), self.n, np.array([self.z[x] for x in at]), wide(1.0)
        y, k = np.empty((len(at), self.width)), np.empty((len(at), self.width))
        for d, x in enumerate(at):
            place = self.n_codes + self.codes[x]
            k[d], y[d] = np.bincount(place, minlength=self.width), np.bincount(place, self.a, self.width)
        return y, np.repeat(self.ns, len(self.levels)), wide(np.tile(self.levels, len(self.ns))), k


def _blocks_of(n_cells: int, draws: int | np.ndarray, seed: int | None):
    """A function that gives order_blocks(), kept from one call to the next where they are small enough."""
    kept: list = []

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        if isinstance(draws, int) and draws * n_cells * 4 > KEPT:
            return order_blocks(n_cells, draws, seed)
        if not kept:
            kept.extend(order_blocks(n_cells, draws, seed))
        return iter(kept)

    return blocks


def _fit_tables(tables: list[tuple[np.ndarray, ...]], own: list[float], metric: str) -> np.ndarray:
    y, n, z, k = (np.concatenate([t[i] for t in tables], axis=-1) for i in range(4))
    starts = np.concatenate([[0], np.cumsum([len(t[1]) for t in tables])[:-1]])
    return fit_events(starts, y, n, z, metric, k, np.array(own))


def _bytes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of values of eight bytes, which begin at starts, as bytes."""
    offsets = np.append(starts, len(values)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of _bytes(), and where each stretch begins in them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // 8
    return np.frombuffer(data, kind, int(at[-1])) if data is not None else np.empty(0, kind), at


def _rows(cells: DataFrame, z: DataFrame, *more: str) -> DataFrame:
    """(event_idx, *more, c, a, b, z), all but keys as bytes: cells of an event, and the row of its predictor, without cells,
    follow each other in one task. Tasks bring cells together, GATHERED at a time, before they are shuffled; so rows are few,
    none grows with an event's cells, and no row of a predictor, which is long though it is taken for short, is sent to all
    tasks."""
    if "cell_idx" in z.columns:
        z = z.groupBy("event_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "z"))), lambda x: x.z).alias("z"))
    names = ["event_idx", *more]
    keys = [F.col(k).cast("long").alias(k) for k in names]
    kinds = ", ".join(f"{k} long" for k in names) + ", c binary, a binary, b binary, z binary"

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            *own, c, a, b = (np.concatenate([np.asarray(x.columns[i]) for x in held]) for i in range(len(names) + 3))
            order = np.lexsort(own[::-1])
            own = [k[order] for k in own]
            starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in own], axis=0)])
            return pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in own), *(_bytes(v[order], starts) for v in (c, a, b)), pa.nulls(len(starts), pa.binary())], names=[*names, "c", "a", "b", "z"])

        held, weight = [], 0
        for batch in found:
            if batch.num_rows:
                held.append(batch)
                weight += batch.num_rows
            if weight >= GATHERED:
                yield solve(held)
                held, weight = [], 0
        if held:
            yield solve(held)

    def told(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            none = pa.array([b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none, none, none, pa.array([np.asarray(x.values, float).tobytes() for x in batch.columns[-1]], pa.binary())], names=[*names, "c", "a", "b", "z"])

    own = cells.select(*keys, F.col("cell_idx").cast("long").alias("c"), F.col("m1").cast("double").alias("a"), F.col("m2").cast("double").alias("b")).mapInArrow(gather, kinds)
    rows = own.unionByName(z.select(*keys, F.col("z").cast("array<double>").alias("z")).mapInArrow(told, kinds))
    return spread(rows, *names).sortWithinPartitions(*names)


def _events(found: Iterator[pa.RecordBatch]) -> Iterator[_Event]:
    """The events of _rows() that have cells and a predictor."""
    now, own, z = None, [], None

    def made() -> Iterator[_Event]:
        cells = [np.concatenate(v) for v in zip(*own)]
        if z is not None and cells and len(cells[0]):
            event = _Event(now[0], *cells, z)
            if len(event.c):
                yield event

    for batch in found:
        if not batch.num_rows:
            continue
        *keys, c, a, b, predictors = batch.columns
        keys = [np.asarray(k) for k in keys]
        (c, at), (a, _), (b, _) = _values(c, np.int64), _values(a, np.float64), _values(b, np.float64)
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        known = np.flatnonzero(np.asarray(predictors.is_valid()))
        for i, j in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist()):
            key = tuple(int(k[i]) for k in keys)
            if key != now:
                yield from made()
                now, own, z = key, [], None
            p, q = np.searchsorted(known, [i, j])
            if q > p:
                z = np.frombuffer(predictors[int(known[p])].as_py())
            own.append((c[at[i] : at[j]], a[at[i] : at[j]], b[at[i] : at[j]]))
    yield from made()


def _gathered(cells: DataFrame, z: DataFrame, metric: str, n_cells: int, draws: int | np.ndarray, seed: int, chunk: int, keep: bool) -> DataFrame:
    """Blocks of events whose cells fit into a row: an event's cells are gathered and joined with its predictor, and events
    are fitted together in numpy, as many at a time as `chunk` numbers hold, a block of draws after the other."""
    width = 1 + min(draws if isinstance(draws, int) else len(draws), BLOCK)

    def fit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks_of(n_cells, draws, seed)

        def solve(held: list[_Event]) -> Iterator[pa.RecordBatch]:
            ids, own = [h.idx for h in held], [h.own for h in held]
            observed = _fit_tables([h.table(None) for h in held], own, metric)[0]
            for first, orders in blocks():
                yield _told(ids, observed, first, _fit_tables([h.table(orders) for h in held], own, metric), keep)

        held, weight = [], 0
        for event in _events(found):
            held.append(event)
            weight += max(event.width * width, len(event.c), len(event.z))
            if weight >= chunk:
                yield from solve(held)
                held, weight = [], 0
        if held:
            yield from solve(held)

    return _rows(cells, z).mapInArrow(fit, BLOCKS)


CODED = "event_idx long, levels binary, codes binary"


def _in_arrays(z: DataFrame) -> DataFrame:
    """z with arrays, which it may have as bytes."""
    if "cell_idx" in z.columns or z.schema["z"].dataType.typeName() != "binary":
        return z

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for e, x in zip(*batch.columns):
                values = np.frombuffer(x.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([e.as_py()]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["event_idx", "z"])

    return z.select(F.col("event_idx").cast("long").alias("event_idx"), "z").mapInArrow(make, "event_idx long, z array<double>")


def _codes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The levels of z in order of appearance, and a code for each place; no codes where they are over LEVELS."""
    codes, levels = np.full(len(z), 255, np.uint8), []
    while len(left := np.flatnonzero(codes == 255)[:1]):
        if len(levels) == LEVELS:
            return np.array(levels), None
        value = z[left[0]]
        codes[np.isnan(z) if np.isnan(value) else z == value] = len(levels)
        levels.append(value)
    return np.array(levels), codes


def _coded(z: DataFrame, n_cells: int) -> DataFrame:
    """CODED predictors: their levels, and a code for each cell, in bits or bytes; no codes where levels are over LEVELS or
    the predictor isn't of n_cells."""
    if "cell_idx" in z.columns:
        z = z.groupBy("event_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "z"))), lambda x: x.z).alias("z"))
    as_bytes = z.schema["z"].dataType.typeName() == "binary"

    def code(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            levels, codes = [], []
            for x in batch.column(1):
                own, c = _codes(np.frombuffer(x.as_buffer()) if as_bytes else np.asarray(x.values, float))
                few = c is not None and len(c) == n_cells > 0
                levels.append(own.tobytes() if few else b"")
                codes.append(None if not few else np.packbits(c).tobytes() if len(own) <= 2 else c.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.binary()), pa.array(codes, pa.binary())], names=["event_idx", "levels", "codes"])

    return z.select(F.col("event_idx").cast("long").alias("event_idx"), F.col("z").cast("binary" if as_bytes else "array<double>").alias("z")).mapInArrow(code, CODED)


def _decoded(codes: bytes, n_levels: int, n_cells: int) -> np.ndarray:
    found = np.frombuffer(codes, np.uint8)
    return np.unpackbits(found, count=n_cells) if n_levels <= 2 else found


def _powers(y: np.ndarray | None, n: np.ndarray) -> np.ndarray:
    """y / n**j for j below SUMS, by cells; without y, n / n**j."""
    out = np.empty((SUMS, len(n)))
    out[0] = n if y is None else y
    for j in range(1, SUMS):
        out[j] = out[j - 1] / n
    return out


def _by_level(weights: np.ndarray, at: np.ndarray, codes: np.ndarray, n_levels: int) -> np.ndarray:
    """(sums, levels, draws): weights (sums by cells) added up by level; codes are cells by draws, and `at` tells the rows of
    these that the weights are for."""
    out = np.zeros((len(weights), n_levels, codes.shape[1]))
    whole = bool((weights[0] == np.trunc(weights[0])).all()) and np.abs(weights[0]).sum() < 2**53  # the first level's are what is left
    for i in range(0, len(at), STRIP):
        rows, w = codes[at[i : i + STRIP]], weights[:, i : i + STRIP]
        for k in range(int(whole), n_levels):
            out[:, k] += w @ (rows if whole and n_levels == 2 else rows == k).astype(float)
    if whole:
        out[:, 0] = weights.sum(1)[:, None] - out[:, 1:].sum(1)
    return out


SUMMED = "event_idx long, first int, levels binary, sums binary, cells long, own double, least double"


def _wide(blocks: Iterator[tuple[int, np.ndarray]], n_cells: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of draws that are made together: as many as KEPT holds."""
    held: list[tuple[int, np.ndarray]] = []
    for block in blocks:
        if held and 4 * n_cells * (len(block[1]) + sum(len(o) for _, o in held)) > KEPT:
            yield held
            held = []
        held.append(block)
    if held:
        yield held


def _level_sums(groups: list[Group], blocks: Iterator[tuple[int, np.ndarray]], n_cells: int) -> Iterator[pa.RecordBatch]:
    """Rows of SUMMED: for each event of groups and block of draws (the first draw is as observed) sums of _powers() by level,
    of counts and of totals. Draws of a predictor are made once for the events that share it, and a group's totals are added
    up once for those of its members."""
    kinds: dict[bytes, list[tuple[Group, int]]] = {}
    for g in groups:
        for event, has in g.members.items():
            if len(g.cells) > len(g.counts(event)[2]):
                kinds.setdefault(has["codes"], []).append((g, event))
    for wide in _wide(blocks, n_cells):
        for kind, events in kinds.items():
            n_levels = len(events[0][0].members[events[0][1]]["levels"]) // 8
            plain = _decoded(kind, n_levels, n_cells)
            codes = np.empty((n_cells, 1 + sum(len(o) for _, o in wide)), np.uint8)
            codes[:, 0] = plain
            for d, order in enumerate((o for _, orders in wide for o in orders), 1):
                codes[:, d] = plain[order]
            rows, last = [], None
            for g, event in events:
                at = g.cells  # below zero they count from the end, as they do where cells are listed
                if g is not last:
                    last, powers = g, _powers(None, g.n)
                    shared, least = _by_level(powers, at, codes, n_levels), float(g.n.min())
                there, y, missing = g.counts(event)
                n = shared - _by_level(powers[:, missing], at[missing], codes, n_levels) if len(missing) else shared
                sums = np.stack([_by_level(_powers(y, g.n[there]), at[there], codes, n_levels), n])
                own, done = float(_own_terms(y, g.n[there]).sum()), 1
                for first, orders in wide:
                    some = np.r_[0, done : done + len(orders)]
                    rows.append((event, first, g.members[event]["levels"], sums[..., some].tobytes(), len(at) - len(missing), own, least))
                    done += len(orders)
                if len(rows) >= 256:
                    yield _summed_rows(rows)
                    rows = []
            if rows:
                yield _summed_rows(rows)


def _summed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SUMMED.split(", ")])


def _fit_sums(sums: np.ndarray, levels: np.ndarray, cells: np.ndarray, own: np.ndarray, least: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """fit_events() from sums (events, counts or totals, powers, levels, draws): (events, draws), and which events have a step
    that sums don't tell.

    In a Newton step all cells of a level have one chance p. Only one / (one + LOW) differs between them, which is
    1 / (1 + x / n) with x = LOW / (p * (1 - p)): a series in x / n, whose terms are the sums. It is cut after SUMS of them,
    so that with x / n up to ROUGH what is left out is below the last digit.
    """
    y, n = sums[:, 0], sums[:, 1]
    z = levels[:, :, None]
    with np.errstate(all="ignore"):
        sum_y, sum_n, sizes = y[:, 0].sum(1), n[:, 0].sum(1), cells[:, None]
        met = n[:, 0] > 0
        fit = _Newton((sizes >= 2) & (sum_y > 0) & (sum_n - sum_y > 0) & (met.sum(1) > 1))
        rough = np.zeros(len(sums), bool)
        for _ in range(STEPS):
            if not fit.going.any():
                break
            eta = fit.b0[:, None] + fit.b1[:, None] * z
            p = _chance(eta)
            one = p * (1 - p)
            x = LOW / one
            rough |= (met & fit.going[:, None] & (x > ROUGH * least[:, None, None])).any((1, 2))
            rest = y[:, SUMS - 1] - p * n[:, SUMS - 1]
            for j in range(SUMS - 2, -1, -1):
                rest = (y[:, j] - p * n[:, j]) - x * rest
            w = n[:, 0] * one
            work = w * eta + rest
            fit.move(*(v.sum(1) for v in (w, w * z, w * z * z, work, z * work)))
        q = np.clip(sum_y / sum_n, LOW, 1 - LOW)
        p = _chance(fit.b0[:, None] + fit.b1[:, None] * z)
        gain = _gain_terms(y[:, 0], n[:, 0], p, q[:, None])
        return _signed_root(gain.sum(1), _null_deviance(own[:, None], sum_y, sum_n, q), sizes, fit.b1, fit.failed, metric), rough


def _grouped(pairs: DataFrame, z: DataFrame, metric: str, n_cells: int, draws: int | np.ndarray, seed: int, chunk: int, keep: bool, split: int | None) -> DataFrame:
    """Blocks of events whose pairs are gathered by group (PACKED): sums by level of the predictor are all that fits of few
    levels need. Events of many levels, and those whose sums don't tell a step, are listed and fitted by cells."""
    coded = staged(_coded(z, n_cells))
    listed = {r["event_idx"] for r in coded.where("codes is null").select("event_idx").collect()}  # of many levels
    ids = F.col("n").isNull()
    members = pairs.where(ids).select("group_id", "part", "event_idx").join(coded.where("codes is not null").hint("merge"), "event_idx")
    none = F.lit(None).cast("binary")
    rows = members.select("group_id", "part", "event_idx", *[F.lit(None).cast(k).alias(c) for c, k in zip(PACKED[3:], ("long", "binary", "binary"))], "levels", "codes")
    rows = spread(rows.unionByName(pairs.where(~ids).select(*PACKED, none.alias("levels"), none.alias("codes"))), "group_id", "part").sortWithinPartitions("group_id", "part")

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks_of(n_cells, draws, seed)
        held: list[Group] = []
        weight = 0
        for g in groups_of(found):
            if g.members and len(g.cells):
                held.append(g)
                weight += len(g.cells) * SUMS + sum(len(own[0]) for own in g.own.values())
            if weight >= LISTED:
                yield from _level_sums(held, blocks(), n_cells)
                held, weight = [], 0
        if held:
            yield from _level_sums(held, blocks(), n_cells)

    def fit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[list]) -> Iterator[pa.RecordBatch]:
            shapes: dict[tuple[int, int], list[list]] = {}
            for h in held:
                shapes.setdefault((len(h[2]), len(h[3])), []).append(h)
            for some in shapes.values():
                event, first, levels, sums, cells, own, least = zip(*some)
                levels = np.array([np.frombuffer(x) for x in levels])
                value, rough = _fit_sums(np.array(sums).reshape(len(some), 2, SUMS, levels.shape[1], -1), levels, np.array(cells), np.array(own), np.array(least), metric)
                for at in sorted(set(first)):
                    i = np.flatnonzero(np.array(first) == at)
                    told = _told([event[j] for j in i], value[i, 0], at, value[i, 1:].T, keep)
                    yield pa.RecordBatch.from_arrays([*told.columns, pa.array(rough[i])], names=[*_NAMES, "rough"])

        held: list[list] = []
        weight = 0
        for batch in found:
            for event, first, levels, sums, cells, own, least in zip(*(c.to_pylist() for c in batch.columns)):
                sums = np.frombuffer(sums)
                if held and (event, first) == tuple(held[-1][:2]):  # another part of the cells
                    last = held[-1]
                    held[-1] = [event, first, levels, last[3] + sums, last[4] + cells, last[5] + own, min(last[6], least)]
                    continue
                if weight >= chunk:
                    yield from solve(held)
                    held, weight = [], 0
                held.append([event, first, levels, sums, cells, own, least])
                weight += len(sums)
        if held:
            yield from solve(held)

    found = spread(rows.mapInArrow(add, SUMMED), "event_idx", "first").sortWithinPartitions("event_idx", "first")
    blocks = staged(found.mapInArrow(fit, BLOCKS + ", rough boolean"))
    listed |= {r["event_idx"] for r in blocks.where("rough").select("event_idx").distinct().collect()}
    if not listed:
        return blocks.drop("rough")
    again = sorted(listed)
    cells = listed_pairs(pairs, again)
    return _apart(blocks, again)[1].drop("rough").unionByName(null_blocks(cells, _apart(z, again)[0], metric, n_cells, draws, seed, keep, split))


PATTERN = ["event_idx", "first", "draw", "n", "z", "k", "y", "own"]


def _patterns(pairs: DataFrame, z: DataFrame | None) -> DataFrame:
    """Rows of PATTERN without draws: the cells of an event that agree in n and in the predictor, which pairs have as z or z
    has. One aggregation, after which an event has as many rows as there are such kinds of cells."""
    if z is not None and "cell_idx" in z.columns:
        pairs = pairs.join(z.select("event_idx", "cell_idx", "z"), ["event_idx", "cell_idx"])
    elif z is not None:
        pairs = pairs.join(z.select("event_idx", F.col("z").alias("_z")).hint("merge"), "event_idx").withColumn("z", F.element_at("_z", (F.col("cell_idx") + 1).cast("int")))
    rows = pairs.select("event_idx", F.col("z").cast("double").alias("z"), F.col("m1").cast("double").alias("y"), (F.col("m1") + F.col("m2")).cast("double").alias("n"))
    term = lambda x: F.when(x > 0, x * F.ln(x / F.col("n"))).otherwise(0.0)
    found = rows.groupBy("event_idx", "z", "n").agg(F.count("*").cast("double").alias("k"), F.sum("y").alias("y"), F.sum(term(F.col("y")) + term(F.col("n") - F.col("y"))).alias("own"))
    return found.withColumn("first", F.lit(1)).withColumn("draw", F.lit(0).cast("long")).select(*PATTERN)


def _tabled(cells: DataFrame, z: DataFrame, n_cells: int, draws: int | np.ndarray, seed: int, part: int) -> DataFrame:
    """Rows of PATTERN for draws (draw 0 of each block is as observed) of events that have more than `part` cells, so many of
    which are tabled at a time, and the tables are added up."""
    parts = -(-n_cells // max(part, 1))
    cut = cells.withColumn("part", F.pmod(F.xxhash64("cell_idx"), F.lit(parts)))
    if "cell_idx" in z.columns:
        z = z.groupBy("event_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "z"))), lambda x: x.z).alias("z"))
    z = z.select("event_idx", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "z")

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks_of(n_cells, draws, seed)
        for event in _events(found):
            # what cells say themselves has no draw: it goes with the first place of each draw
            for first, orders in blocks():
                for at, found_in in ((0, event.table(None)), (1, event.table(orders))):
                    y, n, zs, k = found_in
                    d, i = np.nonzero(k)
                    own = np.where(np.r_[True, d[1:] != d[:-1]], event.own, 0.0)
                    columns = [np.full(len(d), event.idx), np.full(len(d), first, np.int32), at + d, n[i], zs[d, i], k[d, i], y[d, i], own]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=PATTERN)

    rows = _rows(cut, z, "part").mapInArrow(make, "event_idx long, first int, draw long, n double, z double, k double, y double, own double")
    return rows.groupBy("event_idx", "first", "draw", "n", "z").agg(*[F.sum(c).alias(c) for c in ("k", "y", "own")]).select(*PATTERN)


def _fitted(patterns: DataFrame, metric: str, keep: bool, chunk: int) -> DataFrame:
    """Blocks from rows of PATTERN: those of an event and block follow each other in one task, batch by batch."""

    def fit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            new = (rows[["event_idx", "first", "draw"]].diff() != 0).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            y, n, z, k, own = (rows[c].to_numpy(float) for c in ("y", "n", "z", "k", "own"))
            value = fit_events(starts, y[None], n, z[None], metric, k[None], np.add.reduceat(own, starts))[0]
            heads = rows.iloc[starts]
            at = np.append(np.flatnonzero(heads["draw"].to_numpy() == 0), len(starts))
            events, firsts = heads["event_idx"].to_numpy(), heads["first"].to_numpy()
            plain = np.diff(at) == 1  # of no draws: all at once
            if plain.any():
                i = at[:-1][plain]
                yield _told(events[i].tolist(), value[i], 1, np.empty((0, len(i))), keep)
            for i, j in zip(at[:-1][~plain], at[1:][~plain]):
                yield _told([int(events[i])], value[i : i + 1], int(firsts[i]), value[i + 1 : j][:, None], keep)

        held: list[pd.DataFrame] = []
        weight = 0
        for batch in found:
            held.append(batch.to_pandas())
            weight += batch.num_rows
            if weight >= chunk:
                rows = pd.concat(held, ignore_index=True)
                last = (rows["event_idx"] == rows["event_idx"].iloc[-1]) & (rows["first"] == rows["first"].iloc[-1])
                if not last.all():
                    yield from solve(rows[~last].reset_index(drop=True))
                held, weight = [rows[last].reset_index(drop=True)], 0
        if held and sum(map(len, held)):
            yield from solve(pd.concat(held, ignore_index=True))

    ordered = patterns.repartition("event_idx", "first").sortWithinPartitions("event_idx", "first", "draw", "n", "z")
    return ordered.mapInArrow(fit, BLOCKS)


def _summed(rows: DataFrame, shape: tuple[int, int], terms, n_sums: int) -> np.ndarray:
    """Sums over rows (event, draw, ...) by event and draw: each task gives a row per event and draw that it has met, of which
    there are at most LOT, and so many come to the driver. `terms` gives the numbers of a batch's rows."""

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_sums, shape[0] * shape[1]))
        for batch in found:
            at = np.asarray(batch.column(0)) * shape[1] + np.asarray(batch.column(1))
            for s, v in zip(sums, terms(at, *(np.asarray(batch.column(i)) for i in range(2, batch.num_columns)))):
                s += np.bincount(at, v, minlength=len(s))
        met = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(s[met]) for s in sums)], names=["at", *(f"s{i}" for i in range(n_sums))])

    names = [f"s{i}" for i in range(n_sums)]
    found = rows.mapInArrow(add, "at long, " + ", ".join(f"{s} double" for s in names)).groupBy("at").agg(*[F.sum(s).alias(s) for s in names])
    out = np.zeros((n_sums, shape[0] * shape[1]))
    for r in found.collect():
        out[:, r["at"]] = [r[s] for s in names]
    return out.reshape(n_sums, *shape)


def _split_fits(rows: DataFrame, events: int, draws: int, metric: str) -> np.ndarray:
    """fit_events() over staged rows (event, draw, y, n, z, k, own), with an event's rows in as many tasks as hold them:
    (draws, events). A Newton step is one pass, whose sums come back; the coefficients go out with the next."""
    shape = (events, draws)
    with np.errstate(all="ignore"):
        sum_y, sum_n, sizes, own = _summed(rows, shape, lambda at, y, n, z, k, own: (y, k * n, k, own), 4)
        fit = _Newton((sizes >= 2) & (sum_y > 0) & (sum_n - sum_y > 0))
        for _ in range(STEPS):
            if not fit.going.any():
                break
            b0, b1 = fit.b0.ravel(), fit.b1.ravel()
            fit.move(*_summed(rows, shape, lambda at, y, n, z, k, own: _weighted(y, n, z, b0[at] + b1[at] * z, k), 5))
        b0, b1, q = fit.b0.ravel(), fit.b1.ravel(), np.clip(sum_y / sum_n, LOW, 1 - LOW)
        chances = q.ravel()
        gain = _summed(rows, shape, lambda at, y, n, z, k, own: (_gain_terms(y, n, _chance(b0[at] + b1[at] * z), chances[at], k),), 1)[0]
        return _signed_root(gain, _null_deviance(own, sum_y, sum_n, q), sizes, fit.b1, fit.failed, metric).T


def _summed_up(patterns: DataFrame, metric: str, large: list[int], keep: bool) -> DataFrame:
    """Blocks without draws of events that have many rows of PATTERN, by sums over tasks."""
    spark, out = patterns.sparkSession, []
    for at in range(0, len(large), LOT):
        lot = large[at : at + LOT]
        nth = spark.createDataFrame([(e, i) for i, e in enumerate(lot)], "event_idx long, event long")
        rows = staged(patterns.join(F.broadcast(nth), "event_idx").select("event", "draw", "y", "n", "z", "k", "own"))
        observed = _split_fits(rows, len(lot), 1, metric)[0]
        out.append(staged(spark.createDataFrame([tuple(r.values()) for r in _told(lot, observed, 1, np.empty((0, len(lot))), keep).to_pylist()], BLOCKS)))  # a row per event of the lot
    return reduce(DataFrame.unionByName, out)


def _split(cells: DataFrame, z: DataFrame, metric: str, n_cells: int, draws: int | np.ndarray, seed: int, large: list[int], keep: bool) -> DataFrame:
    """Blocks of events whose cells don't fit into a row. The predictor is in long form; a draw moves it by a join on cells."""
    spark = cells.sparkSession
    cells = cells.groupBy("event_idx", "cell_idx").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2")).where("m1 + m2 > 0")
    if "cell_idx" not in z.columns:
        z = z.select("event_idx", F.posexplode("z").alias("cell_idx", "z"))

    n_draws = draws if isinstance(draws, int) else len(draws)

    def moves(first: int, n: int) -> DataFrame:
        """(draw, cell_idx, source): the cell whose predictor a cell gets; draw 0 leaves all where they are."""

        def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                if batch.num_rows:
                    orders = next((o for at, o in order_blocks(n_cells, draws, seed) if at == first), np.empty((0, n_cells), np.int64))
                    for d, order in enumerate([np.arange(n_cells), *orders]):
                        for at in range(0, n_cells, 1 << 16):
                            part = order[at : at + (1 << 16)].astype(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d, np.int64)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["draw", "cell_idx", "source"])

        return spark.range(0, 1, 1, 1).mapInArrow(make, "draw long, cell_idx long, source long")

    out: list[DataFrame] = []
    step = LOT // (1 + min(n_draws, BLOCK))
    for at in range(0, len(large), step):
        lot = large[at : at + step]
        nth = spark.createDataFrame([(e, i) for i, e in enumerate(lot)], "event_idx long, event long")
        own = staged(cells.join(F.broadcast(nth), "event_idx").select("event_idx", "event", "cell_idx", F.col("m1").cast("double").alias("y"), (F.col("m1") + F.col("m2")).cast("double").alias("n")))
        predictor = staged(z.join(F.broadcast(nth), "event_idx").select("event", F.col("cell_idx").cast("long").alias("source"), F.col("z").cast("double").alias("z")))
        observed = None
        for first in range(1, max(n_draws, 1) + 1, BLOCK):
            n = min(BLOCK, n_draws + 1 - first)
            moved = own.join(moves(first, n), "cell_idx") if n else own.withColumn("draw", F.lit(0).cast("long")).withColumn("source", F.col("cell_idx"))
            term = lambda x: F.when(x > 0, x * F.ln(x / F.col("n"))).otherwise(0.0)
            rows = staged(moved.join(predictor, ["event", "source"]).select("event", "draw", "y", "n", "z", F.lit(1.0).alias("k"), (term(F.col("y")) + term(F.col("n") - F.col("y"))).alias("own")))
            found = _split_fits(rows, len(lot), n + 1, metric)
            observed = found[0] if observed is None else observed
            told = staged(spark.createDataFrame([tuple(r.values()) for r in _told(lot, observed, first, found[1:], keep).to_pylist()], BLOCKS))  # a row per event of the lot
            out.append(told)
    return reduce(DataFrame.unionByName, out)


def _apart(df: DataFrame, events: list[int]) -> tuple[DataFrame, DataFrame]:
    """The rows of these events, and the others."""
    few = [events[i : i + 10_000] for i in range(0, len(events), 10_000)]
    within = reduce(Column.__or__, [F.col("event_idx").isin(x) for x in few])
    return df.where(within), df.where(~within)


def null_blocks(pairs: DataFrame, z: DataFrame | None, metric: str = "CoxSnell", n_cells: int = 0, draws: int | np.ndarray = 0, seed: int = 0, keep: bool = True, split: int | None = SPLIT, chunk: int = 2_000_000) -> DataFrame:
    """(event_idx, first, observed, n_valid, mean, m2, exceed, null) for events with cells in pairs (event_idx, cell_idx, m1,
    m2): a row for each block of at most BLOCK draws, from draw `first` on, with their summary and, with `keep`, their values.

    z: (event_idx, z array<double>, or these numbers as bytes), the predictor of the event in every cell, or (event_idx,
    cell_idx, z) with a row for each; an event that it lacks is left out. Without draws it may be None, and pairs have the predictor as column z; there
    is one block of none then, from one aggregation by kinds of cells. With draws, events of over `split` cells are tabled
    in parts, or fitted by sums over tasks if their predictor has many levels (never, if None), others are fitted in one
    task each; all give the same. With draws an event and cell may have several rows, which add up. Draws are made of n_cells, their number and a seed on the tasks, or are given as
    permutations. Pairs may be gathered (see paired_counts()): then they aren't listed, but for events that _grouped() leaves.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}, not {metric!r}")
    n_draws = draws if isinstance(draws, int) else len(draws)
    if set(PACKED) <= set(pairs.columns):
        if n_draws:
            return _grouped(pairs, z, metric, n_cells, draws, seed, chunk, keep, split)
        pairs = listed_pairs(pairs)
    z = z if z is None else _in_arrays(z)
    many = lambda counted: [] if split is None else sorted(r["event_idx"] for r in counted.where(F.col("count") > split).collect())  # over `split` rows each
    if not n_draws:
        patterns = staged(_patterns(pairs.where("m1 + m2 > 0"), z))
        large = many(patterns.groupBy("event_idx").count())
        if not large:
            return _fitted(patterns, metric, keep, chunk)
        hot, cold = _apart(patterns, large)
        return _fitted(cold, metric, keep, chunk).unionByName(_summed_up(hot, metric, large, keep))
    cells = pairs.where("m1 + m2 is not null and (m1 <> 0 or m2 <> 0)").select("event_idx", "cell_idx", "m1", "m2")
    if split is None or n_cells <= split:  # no event has more cells than there are
        return _gathered(cells, z, metric, n_cells, draws, seed, chunk, keep)
    cells = staged(cells)  # read several times
    large = many(cells.groupBy("event_idx").count().join(z.select("event_idx").distinct(), "event_idx", "left_semi"))
    if not large:
        return _gathered(cells, z, metric, n_cells, draws, seed, chunk, keep)
    (hot, cold), (z_hot, z_cold) = _apart(cells, large), _apart(z, large)
    out = [_gathered(cold, z_cold, metric, n_cells, draws, seed, chunk, keep)]
    levels = z_hot.groupBy("event_idx").agg(F.countDistinct("z").alias("levels")) if "cell_idx" in z.columns else z_hot.select("event_idx", F.size(F.array_distinct("z")).alias("levels"))
    sizes = hot.groupBy("event_idx").agg(F.approx_count_distinct(F.col("m1") + F.col("m2")).alias("sizes"))
    few = sorted(r["event_idx"] for r in sizes.join(levels.hint("merge"), "event_idx").where(F.col("levels") * F.col("sizes") * 2 <= split).select("event_idx").collect())
    if few:
        out.append(_fitted(_tabled(_apart(hot, few)[0], _apart(z_hot, few)[0], n_cells, draws, seed, split), metric, keep, chunk))
    if rest := sorted(set(large) - set(few)):
        out.append(_split(_apart(hot, rest)[0], _apart(z_hot, rest)[0], metric, n_cells, draws, seed, rest, keep))
    return reduce(DataFrame.unionByName, out)


def event_correlations(pairs: DataFrame, z: DataFrame | None, metric: str = "CoxSnell", draws: np.ndarray | None = None, split: int | None = SPLIT) -> DataFrame:
    """(event_idx, observed, null array<double>) for a few given permutations of the cells; see null_blocks()."""
    given = 0 if draws is None else np.asarray(draws)
    blocks = null_blocks(pairs, z, metric, 0 if draws is None else given.shape[1], given, split=split)
    by_first = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "null"))), lambda b: b["null"]))
    return blocks.select("event_idx", "observed", "null") if draws is None else blocks.groupBy("event_idx").agg(F.max("observed").alias("observed"), by_first.alias("null"))


def summarized(draws: DataFrame) -> DataFrame:
    """Adds n_valid, mean, m2 and exceed to rows (event_idx, observed, null array<double>). Null draws don't count."""
    known = F.filter("null", lambda x: x.isNotNull())
    add = lambda f: F.aggregate("_known", F.lit(0.0), lambda t, x: t + f(x))
    counted = draws.withColumn("_known", known).withColumn("n_valid", F.size("_known")).withColumn("mean", F.coalesce(add(lambda x: x) / F.nullif("n_valid", F.lit(0)), F.lit(0.0)))
    squares = counted.withColumn("m2", add(lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    return squares.withColumn("exceed", F.size(F.filter("_known", lambda x: F.abs(x) >= F.abs(F.col("observed"))))).drop("_known")


def null_summary(draws: DataFrame) -> DataFrame:
    """(event_idx, observed, n_valid, null_mean, null_sd of the sample, p_value two-sided with one added) from the blocks of
    null_blocks(), or from rows (event_idx, observed, null array<double>): an event's rows are merged by their numbers, means
    and squares, so that a row per task and event is all that is shuffled, however many the draws. Without valid draws the
    mean and p are null, with one the deviation is."""
    blocks = draws if "m2" in draws.columns else summarized(draws)
    n, mean = F.col("n_valid"), F.col("mean")
    base = F.coalesce("observed", F.lit(0.0))  # means are taken about it, lest squares cancel
    merged = blocks.groupBy("event_idx").agg(F.max("observed").alias("observed"), F.sum(n).cast("int").alias("n_valid"), F.sum(n * (mean - base)).alias("_moved"), F.sum(F.col("m2") + n * (mean - base) * (mean - base)).alias("_squares"), F.sum("exceed").alias("_exceed"))
    some = F.nullif("n_valid", F.lit(0))
    variance = (F.col("_squares") - F.col("_moved") * F.col("_moved") / some) / F.nullif(F.col("n_valid") - 1, F.lit(0))
    return merged.select(
        "event_idx", "observed", "n_valid",
        (base + F.col("_moved") / some).alias("null_mean"),
        F.when(F.col("n_valid") > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).alias("null_sd"),
        F.when(F.col("observed").isNotNull() & (F.col("n_valid") > 0), (F.col("_exceed") + 1) / (F.col("n_valid") + 1)).alias("p_value"),
    )


@dataclass(frozen=True)
class AssociationResult:
    """Tables of an association: (event_idx, observed) of all events, statistics (retained events), the null draws in long
    form, and the call's settings."""

    observed: DataFrame
    statistics: DataFrame
    null_distribution: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


def retained(summary: DataFrame) -> DataFrame:
    """Events with an observed value and a null mean."""
    return summary.where("observed is not null and null_mean is not null")


def null_long_table(draws: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """(permutation from 1, event_idx, value) of retained events, from blocks with values or rows of arrays."""
    blocks = draws if "first" in draws.columns else draws.withColumn("first", F.lit(1))
    kept = blocks.join(retained(null_summary(draws) if summary is None else summary).select("event_idx"), "event_idx", "left_semi")
    return kept.select("event_idx", "first", F.posexplode("null").alias("_k", "value")).select((F.col("first") + F.col("_k")).alias("permutation"), "event_idx", "value")


def association(pairs: DataFrame, z: DataFrame, n_cells: int, metric: str = "CoxSnell", n_permutations: int = 100, seed: int | None = None, keep_null: bool = True, split: int | None = SPLIT) -> AssociationResult:
    """Regression of every event on its predictor with a permutation null; see the functions above. The statistics have
    q_value, the p value adjusted over retained events; without permutations they are empty. Without keep_null the draws are
    summed up and not kept."""
    if n_permutations < 0:
        raise ValueError(f"n_permutations is {n_permutations}, below 0")
    drawn = int(np.random.SeedSequence().entropy % 2**63) if seed is None else seed
    found = staged(null_blocks(pairs, z, metric, n_cells, n_permutations, drawn, keep_null, split))  # fitted once for all tables
    summary = staged(null_summary(found))
    statistics = adjusted(retained(summary), "p_value", "q_value")
    return AssociationResult(summary.select("event_idx", "observed"), statistics, null_long_table(found, summary), {"metric": metric, "n_permutations": n_permutations, "seed": seed})
