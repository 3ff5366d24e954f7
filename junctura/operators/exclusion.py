"""Exclusion counts: what a group counts in a cell besides the member itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import excluded, spread, staged_numbers

#: Members of a group that stand in one row.
MEMBERS = 1000
#: Counts that a task brings together by event at a time, and members times cells of a group that one task may hold.
GATHERED, HELD = 1 << 21, 1 << 26
#: Columns of gathered pairs: a row per member, without n, and rows of n counts of a member as bytes (cells, values).
PACKED = ["group_id", "part", "event_idx", "n", "c", "v"]


def _spread(sums: DataFrame) -> DataFrame:
    """(event_idx, cell_idx, m1, m2) from rows (cell_idx, total, own, members): the members that have counts, and the others
    with none."""
    ids = F.transform("own", lambda x: x.event_idx)
    added = F.transform(F.array_distinct(ids), lambda e: F.struct(e.alias("event_idx"), F.aggregate(F.filter("own", lambda x: x.event_idx == e), F.lit(0.0), lambda t, x: t + x.value).alias("value")))
    own = F.when(F.size(F.array_distinct(ids)) == F.size("own"), F.col("own")).otherwise(added)  # repeated counts add up
    none = F.transform(F.array_except("members", ids), lambda e: F.struct(e.alias("event_idx"), F.lit(0.0).alias("value")))
    flat = sums.select("cell_idx", "total", F.explode(F.concat(own, none)).alias("x")).select(F.col("x.event_idx").alias("event_idx"), "cell_idx", "total", F.col("x.value").alias("m1"))
    return flat.select("event_idx", "cell_idx", "m1", F.coalesce(excluded("total", "m1"), F.lit(0.0)).alias("m2")).where("m1 <> 0 or m2 <> 0")


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of values as bytes, in four bytes each where these tell the values."""
    if values.dtype.kind == "f":
        small = bool((values == np.trunc(values)).all()) and bool((np.abs(values) < 1 << 31).all())
    else:
        small = -(1 << 31) <= values.min() and values.max() < 1 << 31
    values = np.ascontiguousarray(values.astype(np.int32) if small else values)
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _gathered(numbered: DataFrame, counts: DataFrame, n_cells: int) -> DataFrame:
    """PACKED rows: a group's members, and its counts, in as many parts by cells as it takes for a task to hold one."""
    most = numbered.groupBy("group_id").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-n_cells * most // HELD))
    members = numbered.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("event_idx").cast("long").alias("event_idx"))

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            if any(x.columns[1].null_count for x in held):
                raise ValueError("cell_idx must not be null")
            e, c, v = (np.concatenate([np.asarray(x.columns[i]) for x in held]) for i in range(3))
            part = (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts if parts > 1 else np.zeros(1, np.int64)
            low = int(e.min())
            key = (e - low) * parts + part
            order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")  # few keys are sorted by digits
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.append(starts, len(order)))
            return pa.RecordBatch.from_arrays([pa.array(key[starts] // parts + low), pa.array(key[starts] % parts), pa.array(n), _packed(c[order], starts), _packed(v[order].astype(float), starts)], names=["event_idx", *PACKED[1:2], *PACKED[3:]])

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

    rows = counts.select(F.col("event_idx").cast("long").alias("event_idx"), F.col("cell_idx").cast("long").alias("cell_idx"), "value").mapInArrow(gather, "event_idx long, part long, n long, c binary, v binary")
    none = [F.lit(None).cast(k).alias(c) for c, k in zip(PACKED[3:], ("long", "binary", "binary"))]
    return members.select(*PACKED[:3], *none).unionByName(staged_numbers(rows).join(numbered, "event_idx").select(*PACKED))


class Group(NamedTuple):
    """A group's cells in a part, with their totals, and what its members count."""

    members: dict[int, dict]  # what each member's row has more
    cells: np.ndarray  # that have a total above zero, in order
    n: np.ndarray  # their totals
    own: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # places in cells with counts, these, and places without a valid count

    def counts(self, event: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return self.own.get(event, (none, np.empty(0), none))


def _group(members: dict[int, dict], held: dict[int, list[tuple]]) -> Group:
    if not held:
        return Group(members, np.empty(0, np.int64), np.empty(0), {})
    mine = {e: (np.concatenate([c for c, _ in x]), np.concatenate([v for _, v in x]).astype(float)) for e, x in held.items()}
    low, high = min(int(c.min()) for c, _ in mine.values()), max(int(c.max()) for c, _ in mine.values())
    width = high - low + 1
    total = np.zeros(width)
    for c, v in mine.values():
        total += np.bincount(c - low, np.where(np.isnan(v), 0.0, v), width)
    kept = np.flatnonzero(total > 0)
    own = {}
    for e, (c, v) in mine.items():
        bad = np.isnan(v)
        found = np.bincount(c - low, v if not bad.any() else np.where(bad, 0.0, v), width)
        missing = np.zeros(width, bool)
        missing[c[bad] - low] = True
        found[missing] = 0
        found, missing = found[kept], np.flatnonzero(missing[kept]) if bad.any() else np.empty(0, np.int64)
        there = np.flatnonzero(found)
        own[e] = there, found[there], missing
    return Group(members, kept + low, total[kept], own)


def groups_of(found: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """The groups of PACKED rows whose parts follow each other; more columns are the members'."""
    now, members, held = None, {}, {}
    for batch in found:
        more = [n for n in batch.schema.names if n not in PACKED]
        group, part, event, n = (batch.column(x).to_pylist() for x in PACKED[:4])
        data = []
        for x, wide in zip(PACKED[4:], (np.int64, float)):
            column = batch.column(x)
            _, offsets, values = column.buffers()
            data.append((np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).tolist(), values, wide))
        for i, key in enumerate(zip(group, part)):
            if key != now:
                if now is not None:
                    yield _group(members, held)
                now, members, held = key, {}, {}
            if n[i] is None:
                members[event[i]] = {x: batch.column(x)[i].as_py() for x in more}
            else:
                held.setdefault(event[i], []).append(tuple(np.frombuffer(v, np.int32 if at[i + 1] - at[i] == 4 * n[i] else wide, n[i], at[i]).copy() for at, v, wide in data))
    if now is not None:
        yield _group(members, held)


def listed_pairs(gathered: DataFrame, events: list[int] | None = None) -> DataFrame:
    """(event_idx, cell_idx, m1, m2) of gathered pairs, of all events or of these."""
    wanted = None if events is None else set(events)

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(found):
            for event in g.members:
                if not len(g.cells) or wanted is not None and event not in wanted:
                    continue
                there, y, missing = g.counts(event)
                m1 = np.zeros(len(g.cells))
                m1[there] = y
                left = np.delete(np.arange(len(g.cells)), missing)
                for i in range(0, len(left), 1 << 16):
                    x = left[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), event)), pa.array(g.cells[x]), pa.array(m1[x]), pa.array(g.n[x] - m1[x])], names=["event_idx", "cell_idx", "m1", "m2"])

    return spread(gathered, "group_id", "part").sortWithinPartitions("group_id", "part").mapInArrow(make, "event_idx long, cell_idx long, m1 double, m2 double")


def paired_counts(events: DataFrame, m1: DataFrame, block: int = MEMBERS, gathered: int | None = None) -> DataFrame:
    """(event_idx, cell_idx, m1, m2) for each event of a group and each cell in which the group has counts.

    Counts are gathered by group and cell, as a sum and a list of the members that have some, and joined with the list of all
    members: the result, which is larger, is made in place and never shuffled. A group of over `block` members is cut into
    blocks by hash, each with lists of its own, and gets its sum by a join; so no row grows with a group. A pair with neither
    count is left out. Negative ids of groups are an error.

    With `gathered`, the number of cells, pairs aren't listed: the rows are PACKED, from which groups_of() makes the cells of
    a group, their totals, and each member's counts, and listed_pairs() the pairs of positive totals. They have a number for
    each count that there is, and none for pairs whose member has no counts. Counts are staged.
    """
    group = F.when(F.col("group_id") >= 0, F.col("group_id")).otherwise(F.raise_error(F.lit("group_id must not be negative")))
    numbered = events.select("event_idx", group.alias("group_id"))
    counts = m1.select("event_idx", "cell_idx", F.col("value").cast("double").alias("value"))
    if gathered is not None:
        return _gathered(numbered, counts, gathered)
    own = F.collect_list(F.struct("event_idx", "value")).alias("own")

    def small(members: DataFrame) -> DataFrame:
        lists = members.groupBy("group_id").agg(F.collect_list("event_idx").alias("members"))
        return counts.join(members, "event_idx").groupBy("group_id", "cell_idx").agg(F.sum("value").alias("total"), own).where("total <> 0").join(lists, "group_id")

    sizes = numbered.groupBy("group_id").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > block)
    if not large.limit(1).count():
        return _spread(small(numbered))
    cut = numbered.join(large, "group_id").withColumn("block", F.pmod(F.xxhash64("event_idx"), F.ceil(F.col("size") / block))).drop("size")
    lists = cut.groupBy("group_id", "block").agg(F.collect_list("event_idx").alias("members"))
    placed = counts.join(cut, "event_idx")
    totals = placed.groupBy("group_id", "cell_idx").agg(F.sum("value").alias("total")).where("total <> 0")
    mine = placed.groupBy("group_id", "cell_idx", "block").agg(own)
    wide = totals.join(lists, "group_id").join(mine, ["group_id", "cell_idx", "block"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<event_idx:bigint,value:double>>")))
    return _spread(small(numbered.join(large, "group_id", "left_anti"))).unionByName(_spread(wide))


def exclusion_counts(events: DataFrame, m1: DataFrame) -> DataFrame:
    """(event_idx, cell_idx, value): the exclusion counts that aren't zero. Groups of one member have none."""
    return paired_counts(events, m1).where("m2 <> 0").select("event_idx", "cell_idx", F.col("m2").alias("value"))


def pair_layers(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """Inclusion and exclusion counts side by side; a missing one is zero."""
    a = m1.select("event_idx", "cell_idx", F.col("value").alias("m1"))
    b = m2.select("event_idx", "cell_idx", F.col("value").alias("m2"))
    return a.join(b, ["event_idx", "cell_idx"], "full_outer").select("event_idx", "cell_idx", F.coalesce("m1", F.lit(0.0)).alias("m1"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
