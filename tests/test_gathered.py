"""Pairs that are gathered by group instead of listed, and fits by sums over levels of the predictor."""

import numpy as np
import pytest

from junctura.functions import staged_numbers
from junctura.operators import association as A
from junctura.operators import exclusion as X
from junctura.plans import proxy
from junctura.plans.queries import QUERIES
from test_operators import one_event
from test_round_three import tables


def test_statistics_list_no_pairs(spark, tmp_path, monkeypatch):
    """The query's time grew with pairs of events and cells, most of which have no counts of the event."""
    folder, _ = tables(tmp_path / "t", ["b1", "b2"], [3, 8, 13], n=6000, cells=300, lines=3)

    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(X, "_spread", listed)
    seen, plain = [], A.listed_pairs
    monkeypatch.setattr(A, "listed_pairs", lambda pairs, events=None: seen.extend(events) or plain(pairs, events))
    got = QUERIES["association_statistics"](spark, folder).collect()
    assert len(got) > 10 and all(r.observed is not None and r.n_valid == 100 for r in got) and not seen


@pytest.fixture(scope="module")
def groups(spark):
    """Two groups of four events in 500 cells: counts, of which some are repeated, one event is rare and one has an invalid count."""
    rng, cells = np.random.default_rng(12), 500
    m = rng.integers(0, 9, (8, cells)) * (rng.random((8, cells)) < 0.3) + 0.0
    m[3] = 0
    m[3, 7] = 1  # one count alone
    m[:, 490:] = 0  # cells without counts
    rows = [(e, c, float(v)) for e in range(8) for c in range(cells) if m[e, c] for v in ([m[e, c]] if c % 5 else [m[e, c] - 0.5, 0.5])]
    m[5, 20] = np.nan
    rows = [r for r in rows if r[:2] != (5, 20)] + [(5, 20, None)]
    events = spark.createDataFrame([(e, e // 4) for e in range(8)], "event_idx long, group_id long")
    return events, spark.createDataFrame(rows, "event_idx long, cell_idx long, value double").repartition(5), m


@pytest.mark.parametrize("metric", A.METRICS)
@pytest.mark.parametrize("held", [None, 600])
def test_gathered_pairs_equal_listed_ones(spark, groups, metric, held, monkeypatch):
    events, m1, m = groups
    cells = m.shape[1]
    if held:
        monkeypatch.setattr(X, "HELD", held)  # cells are cut into parts
    rng = np.random.default_rng(7)
    z = rng.integers(0, 2, (8, cells)) + 0.0
    z[1], z[2], z[6], z[7] = 1 - z[0], rng.integers(0, 3, cells) - 0.5, rng.normal(size=cells), 1.0
    arrays = spark.createDataFrame([(e, row.tolist()) for e, row in enumerate(z)], "event_idx long, z array<double>")
    in_bytes = spark.createDataFrame([(e, bytearray(row.tobytes())) for e, row in enumerate(z)], "event_idx long, z binary")
    asked, plain = set(), A.listed_pairs
    monkeypatch.setattr(A, "listed_pairs", lambda pairs, events=None: asked.update(events or ()) or plain(pairs, events))
    gathered = X.paired_counts(events, m1, gathered=cells)
    assert {r.part for r in gathered.select("part").distinct().collect()} == ({0} if held is None else set(range(4)))
    listed = {(r.event_idx, r.first): r for r in A.null_blocks(X.paired_counts(events, m1), arrays, metric, cells, 40, 9).collect()}
    draws = A.permutations(cells, 40, 9)
    for frame in (arrays, in_bytes):
        found = A.null_blocks(gathered, frame, metric, cells, 40, 9)
        got = {(r.event_idx, r.first): r for r in found.collect()}
        assert sorted(got) == sorted(listed) and found.columns == A._NAMES
        for (e, first), r in got.items():
            other = listed[e, first]
            if e == 7:  # one level: no fit
                assert r.observed is None and set(r.null) == {None}
                continue
            assert r.n_valid == other.n_valid and r.observed == pytest.approx(other.observed, abs=1e-9) and r.null == pytest.approx(other.null, abs=1e-9)
            own, total = m[e], np.nansum(m[e // 4 * 4 : e // 4 * 4 + 4], axis=0)
            there = ~np.isnan(own)
            value = one_event(z[e][draws[first - 1]][there], own[there], (total - own)[there], metric)
            assert r.null[0] == pytest.approx(value, abs=1e-6) if e != 3 else True
    assert asked == {3, 6}  # what sums can't tell: chances near to none, and many levels
    no_draws = {r.event_idx: r.observed for r in A.null_blocks(gathered, arrays.where("event_idx < 3"), metric, cells).collect()}
    assert all(no_draws[e] == pytest.approx(listed[e, 1].observed, abs=1e-9) for e in range(3))


def test_listed_pairs_are_the_gathered_ones(spark, groups):
    events, m1, _ = groups
    of = lambda df: sorted((r.event_idx, r.cell_idx, r.m1, r.m2) for r in df.where("m1 is not null and m1 + m2 > 0").collect())
    gathered = X.paired_counts(events, m1, gathered=500)
    assert of(X.listed_pairs(gathered)) == of(X.paired_counts(events, m1))
    assert {r.event_idx for r in X.listed_pairs(gathered, [2, 5]).collect()} == {2, 5}


def test_many_line_items_give_the_same_counts(spark, tmp_path, monkeypatch):
    folder, _ = tables(tmp_path / "t", ["b1", "b2"], [3, 8, 13], n=2000)
    few = [df.collect() for df in proxy.events_and_counts(spark, folder)]
    monkeypatch.setattr(proxy, "LINES", 300)
    plans = []
    plain = proxy.staged
    monkeypatch.setattr(proxy, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    many = [df.collect() for df in proxy.events_and_counts(spark, folder)]
    assert [sorted(map(repr, x)) for x in many] == [sorted(map(repr, x)) for x in few]
    assert any("ShuffledHashJoin" in p for p in plans)


def test_batches_of_numbers_are_not_weighed(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert staged_numbers(spark.range(5)).count() == 5 and spark.conf.get(name) == before
