"""Events whose cells are spread over tasks, and null draws in blocks."""

import numpy as np
import pytest

from junctura.operators import association as A
from test_operators import one_event


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.fixture(scope="module")
def mixed(spark):
    """Three small events and one with every cell."""
    rng = np.random.default_rng(8)
    cells = 400
    m = rng.integers(0, 6, (2, 4, cells)) * (rng.random((2, 4, cells)) < 0.08)
    m[:, 3] = rng.integers(0, 9, (2, cells))
    rows = [(e, c, float(m[0, e, c]), float(m[1, e, c])) for e in range(4) for c in range(cells) if m[:, e, c].any()]
    return frame(spark, rows, "event_idx long, cell_idx long, m1 double, m2 double"), m.astype(float), rng.normal(size=(4, cells))


@pytest.mark.parametrize("metric", A.METRICS)
@pytest.mark.parametrize("long_form", [False, True])
def test_split_events_equal_gathered_ones(spark, mixed, metric, long_form):
    pairs, m, z = mixed
    zf = frame(spark, [(e, c, float(x)) for e, row in enumerate(z) for c, x in enumerate(row)], "event_idx long, cell_idx long, z double") if long_form else frame(spark, [(e, row.tolist()) for e, row in enumerate(z)], "event_idx long, z array<double>")
    found = {}
    for split in (None, 200, 0):  # none, the large one, and all are spread over tasks
        rows = A.null_blocks(pairs, zf, metric, 400, 40, 9, split=split).collect()
        assert sorted((r.event_idx, r.first) for r in rows) == [(e, b) for e in range(4) for b in (1, 33)]
        found[split] = {(r.event_idx, r.first): [r.observed, *r.null] for r in rows}
    draws = A.permutations(400, 40, 9)
    for key, values in found[None].items():
        e, first = key
        assert values[0] == pytest.approx(one_event(z[e], m[0, e], m[1, e], metric), abs=1e-9)
        assert values[1] == pytest.approx(one_event(z[e][draws[first - 1]], m[0, e], m[1, e], metric), abs=1e-9)
        for split in (200, 0):
            assert found[split][key] == pytest.approx(values, abs=1e-9)


def test_event_with_a_million_cells(spark):
    """Task memory is bounded by batches, not by an event; the same value as a fit of the whole event in numpy."""
    n = 1_000_000
    cells = spark.range(0, n, 1, 8).selectExpr("0L as event_idx", "id as cell_idx", "double(id * 7 % 5) as m1", "double(id * 11 % 6) as m2")
    z = spark.range(0, n, 1, 8).selectExpr("0L as event_idx", "id as cell_idx", "double(id % 1000) / 500 - 1 + double(id * 7 % 5) / 10 as z")
    got = A.event_correlations(cells, z).first().observed
    i = np.arange(n)
    a, b = i * 7 % 5.0, i * 11 % 6.0
    use = a + b > 0
    expect = A.fit_events(np.array([0]), a[use], (a + b)[use], (i % 1000 / 500 - 1 + i * 7 % 5 / 10)[use][None], "CoxSnell")[0, 0]
    assert got == pytest.approx(expect, abs=1e-9) and got > 0


def test_many_draws_in_little_memory(spark, mixed):
    """The null's summary is merged over blocks, so rows stay short however many the draws; values equal those of all draws."""
    pairs, _, z = mixed
    pairs = pairs.where("event_idx < 2 and cell_idx < 60")
    zf = frame(spark, [(e, row[:60].tolist()) for e, row in enumerate(z[:2])], "event_idx long, z array<double>")
    n = 3000
    found = A.association(pairs, zf, 60, n_permutations=n, seed=3)
    draws = {}
    for r in found.null_distribution.collect():
        draws.setdefault(r.event_idx, {})[r.permutation] = r.value
    for r in found.statistics.collect():
        values = [draws[r.event_idx][k + 1] for k in range(n)]
        known = np.array([v for v in values if v is not None])
        assert r.n_valid == len(known) and r.null_mean == pytest.approx(known.mean(), abs=1e-12) and r.null_sd == pytest.approx(known.std(ddof=1), abs=1e-12)
        assert r.p_value == pytest.approx(((np.abs(known) >= abs(r.observed)).sum() + 1) / (len(known) + 1))
    short = A.association(pairs, zf, 60, n_permutations=n, seed=3, keep_null=False)
    same = lambda x: sorted((r.event_idx, r.n_valid, round(r.p_value, 12)) for r in x.statistics.collect())
    assert same(short) == same(found)
    blocks = A.null_blocks(pairs, zf, "CoxSnell", 60, 100, 3)
    assert max(len(r.null) for r in blocks.collect()) == A.BLOCK
    first, orders = next(iter(A.order_blocks(60, 10**9, 3)))
    assert first == 1 and orders.shape == (A.BLOCK, 60)
    again = np.random.default_rng(3)
    assert (A.permutations(60, 70, 3) == np.array([again.permutation(60) for _ in range(70)])).all()


def test_summary_without_valid_draws(spark):
    rows = frame(spark, [(0, 0.5, [None, None]), (1, 0.5, [0.25]), (2, None, [0.1, 0.3]), (3, 0.1, [])], "event_idx long, observed double, null array<double>")
    got = {r.event_idx: tuple(r)[2:] for r in A.null_summary(rows).collect()}
    assert got[0] == (0, None, None, None) and got[1] == (1, 0.25, None, 0.5) and got[3] == (0, None, None, None)
    assert got[2][0] == 2 and got[2][1] == pytest.approx(0.2) and got[2][3] is None
    assert {r.event_idx for r in A.null_long_table(rows).collect()} == {1}
