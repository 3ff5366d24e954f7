import numpy as np
import pytest

from junctura.functions import adjusted, with_index
from junctura.operators import association as A
from junctura.operators import deviance as D
from junctura.operators import variance as V
from junctura.operators.exclusion import exclusion_counts, paired_counts


def one_event(z, m1, m2, metric):
    """A plain loop of the same regression, for comparison."""
    n = m1 + m2
    use = n > 0
    z, m1, n = z[use], m1[use], n[use]
    if len(n) < 2 or m1.sum() <= 0 or (n - m1).sum() <= 0:
        return np.nan
    x, b = np.stack([np.ones_like(z), z], 1), np.zeros(2)
    chance = lambda e: np.clip(1 / (1 + np.exp(-e)), 1e-8, 1 - 1e-8)
    for _ in range(100):
        eta = x @ b
        p = chance(eta)
        w = n * p * (1 - p)
        new = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * (eta + (m1 - n * p) / (w + 1e-8))))
        done = np.abs(new - b).max() < 1e-6
        b = new
        if done:
            break
    ll = lambda p: 2 * sum(a * np.log(a / (k * q)) for a, k, q in zip(np.r_[m1, n - m1], np.r_[n, n], np.r_[p, 1 - p]) if a > 0)
    full, null = ll(chance(x @ b)), ll(np.full(len(n), m1.sum() / n.sum()))
    r2 = 1 - np.exp((full - null) / len(n))
    if metric == "Nagelkerke":
        r2 /= 1 - np.exp(-null / len(n))
    return np.sqrt(r2) * (1 if b[1] >= 0 else -1) if r2 >= 0 else np.nan


@pytest.fixture(scope="module")
def paired(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 12, (2, 12, 40)) * (rng.random((2, 12, 40)) < 0.5)
    rows = [(e, c, float(m[0, e, c]), float(m[1, e, c])) for e in range(12) for c in range(40) if m[:, e, c].any()]
    return spark.createDataFrame(rows, "event_idx long, cell_idx long, m1 double, m2 double"), m.astype(float), rng.normal(size=(12, 40))


@pytest.mark.parametrize("metric", A.METRICS)
def test_regression_and_null(spark, paired, metric):
    pairs, m, z = paired
    zf = spark.createDataFrame([(e, z[e].tolist()) for e in range(12)], "event_idx long, z array<double>")
    draws = A.permutations(40, 5, 11)
    rng = np.random.default_rng(11)
    assert (draws == np.array([rng.permutation(40) for _ in range(5)])).all()
    got = {r.event_idx: r for r in A.event_correlations(pairs, zf, metric, draws).collect()}
    for e in range(12):
        assert got[e].observed == pytest.approx(one_event(z[e], m[0, e], m[1, e], metric), abs=1e-8)
        for k in range(5):
            assert got[e].null[k] == pytest.approx(one_event(z[e][draws[k]], m[0, e], m[1, e], metric), abs=1e-8)
    turned = {r.event_idx: r.observed for r in A.event_correlations(pairs.selectExpr("event_idx", "cell_idx", "m2 as m1", "m1 as m2"), zf, metric).collect()}
    assert all(turned[e] == pytest.approx(-got[e].observed, abs=1e-10) for e in range(12))
    with pytest.raises(ValueError):
        A.event_correlations(pairs, zf, "other")


def test_association_tables(spark, paired):
    pairs, _, z = paired
    zf = spark.createDataFrame([(e, z[e].tolist()) for e in range(12)], "event_idx long, z array<double>")
    found = A.association(pairs, zf, 40, n_permutations=7, seed=1)
    stats = {r.event_idx: r for r in found.statistics.collect()}
    assert len(stats) == 12 and found.null_distribution.count() == 84
    order = sorted(stats.values(), key=lambda r: r.p_value)
    q = [r.p_value * 12 / (i + 1) for i, r in enumerate(order)]
    for i, r in enumerate(order):
        assert r.q_value == pytest.approx(min(1, min(q[i:])))
    assert A.association(pairs, zf, 40, n_permutations=0).statistics.count() == 0


def test_degenerate_events(spark):
    rows = [(0, 0, 1.0, 2.0), (1, 0, 1.0, 0.0), (1, 1, 2.0, 0.0), (2, 0, 1.0, 1.0), (2, 1, 3.0, 1.0)]
    pairs = spark.createDataFrame(rows, "event_idx long, cell_idx long, m1 double, m2 double")
    z = spark.createDataFrame([(e, [0.0, 1.0]) for e in range(3)], "event_idx long, z array<double>")
    got = {r.event_idx: r.observed for r in A.event_correlations(pairs, z).collect()}
    assert got[0] is None and got[1] is None and got[2] > 0


def test_deviance_and_top(spark, paired):
    pairs, m, _ = paired
    placed = pairs.selectExpr("*", "case when cell_idx < 20 then 'a' else 'b' end as library")
    expect = {}
    for e in range(12):
        total = 0
        for cells in (slice(0, 20), slice(20, 40)):
            y, n = m[0, e, cells], m[0, e, cells] + m[1, e, cells]
            p = y.sum() / n.sum()
            total += sum(2 * ((a * np.log(a / (k * p)) if a else 0) + ((k - a) * np.log((k - a) / (k * (1 - p))) if k > a else 0)) for a, k in zip(y, n) if k)
        expect[e] = total
    got = {r.event_idx: r.deviance for r in D.event_deviance(placed, 10).collect()}
    assert all(got[e] == pytest.approx(expect[e]) for e in expect)
    events = spark.range(12).withColumnRenamed("id", "event_idx")
    top = [r.event_idx for r in D.highly_variable_events(events, placed, 10, 3).where("highly_variable").collect()]
    assert set(top) == set(sorted(expect, key=lambda e: (-expect[e], e))[:3])
    with pytest.raises(ValueError, match="n_top"):
        D.highly_variable_events(events, placed, 10, 0)
    with pytest.raises(ValueError, match="min_row_sum"):
        D.highly_variable_events(events, placed, 1e9)
    assert D.library_deviance(spark.createDataFrame([(0, 0, "a", 3.0, 0.0)], "event_idx long, cell_idx long, library string, m1 double, m2 double")).first().deviance == 0


def test_variance(spark):
    x = np.array([[0, 1, 2, 0, 3], [5, 5, 5, 5, 5]], float)
    rows = [(g, c, float(x[g, c])) for g in range(2) for c in range(5) if x[g, c]]
    counts = spark.createDataFrame(rows, "feature_idx long, cell_idx long, value double")
    got = {r.feature_idx: r for r in V.mean_variance(counts, 5).collect()}
    assert got[0].mean == pytest.approx(1.2) and got[0].variance == pytest.approx(x[0].var())
    moments = spark.createDataFrame([(0, 1.2, 2.0), (1, 5.0, 1.0), (2, 0.0, 1.0)], "feature_idx long, mean double, sd double")
    normed = {r.feature_idx: r.variance_standardized for r in V.standardized_variance(counts, moments, 5).collect()}
    assert normed[0] == pytest.approx((((x[0] - 1.2) / 2) ** 2).sum() / 4) and normed[1] == 0 and normed[2] == 0


def test_trend(spark):
    t = np.linspace(-2, 2, 200)
    y = 1 + 2 * t - 0.5 * t * t
    assert np.abs(V.smooth(t, y) - y).max() < 1e-8
    rng = np.random.default_rng(0)
    mix = rng.permutation(200)
    noisy = np.sin(t) + rng.normal(scale=0.05, size=200)
    assert np.allclose(V.smooth(t[mix], noisy[mix]), V.smooth(t, noisy)[mix])
    assert np.abs(V.smooth(t, noisy) - V.local_quadratic(t, noisy, t, 0.3)[0]).max() < 0.05
    lam = np.exp(rng.normal(1, 1, 60))
    x = rng.poisson(lam[:, None], (60, 80)).astype(float)
    x[3] = 0
    counts = spark.createDataFrame([(g, c, float(x[g, c])) for g in range(60) for c in range(80) if x[g, c]], "feature_idx long, cell_idx long, value double")
    genes = spark.range(60).withColumnRenamed("id", "feature_idx")
    found = V.highly_variable_genes(counts, genes, 80, 10).collect()
    assert len(found) == 60 and sum(r.highly_variable for r in found) == 10 and all(r.variances_norm is not None for r in found)
    assert not next(r for r in found if r.feature_idx == 3).highly_variable
    with pytest.raises(ValueError):
        V.highly_variable_genes(counts, genes, 80, 0)


def test_exclusion(spark):
    events = spark.createDataFrame([(0, 7), (1, 7), (2, 900)], "event_idx long, group_id long")
    m1 = spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0), (1, 1, 4.0), (2, 0, 5.0)], "event_idx long, cell_idx long, value double")
    got = {(r.event_idx, r.cell_idx): r.value for r in exclusion_counts(events, m1).collect()}
    assert got == {(0, 0): 3, (1, 0): 2, (0, 1): 4}
    with pytest.raises(Exception, match="negative"):
        exclusion_counts(events.selectExpr("event_idx", "group_id - 8 as group_id"), m1).collect()


def test_order_and_adjustment(spark):
    rows = spark.range(1000).selectExpr("id", "cast((id * 7919) % 1000 as double) / 1000 as p").repartition(7)
    placed = with_index(rows, ["p"], "place").collect()
    assert all(r.place == round(r.p * 1000) for r in placed)
    few = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, None), (3, 0.03)], "id long, p double")
    got = {r.id: r.q for r in adjusted(few, "p", "q").collect()}
    assert got[0] == pytest.approx(0.03) and got[1] == pytest.approx(0.04) and got[3] == pytest.approx(0.04) and got[2] is None


def test_large_groups(spark):
    """A group of many members is cut into blocks: the same rows, and no row that grows with the group."""
    rng = np.random.default_rng(6)
    sizes = [300, 2, 40, 1]
    group = np.repeat(np.arange(4), sizes)
    events = spark.createDataFrame([(e, int(g)) for e, g in enumerate(group)], "event_idx long, group_id long").repartition(3)
    own = {(int(e), int(c)): float(v) for e, c, v in zip(rng.integers(0, len(group), 400), rng.integers(0, 5, 400), rng.integers(1, 9, 400))}
    rows = [(e, c, v) for (e, c), v in own.items()] + [(0, 0, 2.0), (0, 0, 3.0)]  # repeated counts add up
    m1 = spark.createDataFrame(rows, "event_idx long, cell_idx long, value double").repartition(3)
    own[0, 0] = own.get((0, 0), 0) + 5.0
    expect = {}
    for c in range(5):
        for g in range(4):
            members = np.flatnonzero(group == g)
            total = sum(own.get((int(e), c), 0) for e in members)
            for e in members.tolist():
                if total and (own.get((e, c), 0) or total - own.get((e, c), 0)):
                    expect[e, c] = (own.get((e, c), 0.0), total - own.get((e, c), 0.0))
    for block in (1000, 16):
        got = paired_counts(events, m1, block)
        held = got.collect()
        assert len(held) == len(expect) and {(r.event_idx, r.cell_idx): (r.m1, r.m2) for r in held} == expect


@pytest.mark.parametrize("n", [3, 40, 700])
def test_trend_without_the_driver(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 2)  # with ties
    y = np.sin(x) + rng.normal(scale=0.1, size=n)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "feature_idx long, x double, y double").repartition(5)
    got = {r.feature_idx: r.fitted for r in V.trend(points).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(V.smooth(x, y), abs=1e-8)


def test_histogram_gives_the_same(spark):
    rng = np.random.default_rng(2)
    counts = spark.createDataFrame([(int(g), c, float(v)) for g in range(20) for c, v in enumerate(rng.poisson(2, 50)) if v], "feature_idx long, cell_idx long, value double")
    held = V.value_histogram(counts)
    moments = V.mean_variance(counts, 50)
    assert {r.feature_idx: pytest.approx(tuple(r)) for r in moments.collect()} == {r.feature_idx: tuple(r) for r in V.mean_variance(held, 50).collect()}
    sd = moments.selectExpr("feature_idx", "mean", "1.5 as sd")
    assert {r[0]: pytest.approx(r[1]) for r in V.standardized_variance(counts, sd, 50).collect()} == {r[0]: r[1] for r in V.standardized_variance(held, sd, 50).collect()}


def test_numbering_is_written_once(spark):
    """One table in order of the key; places and prefix sums need no window over all rows."""
    rows = spark.range(500).selectExpr("(id * 37) % 500 as k", "id % 3 as w").repartition(6)
    got = with_index(rows, ["k"], "place", {"before": "w"}).orderBy("k").collect()
    assert [r.place for r in got] == list(range(500))
    sums = np.concatenate([[0], np.cumsum([r.w for r in got])[:-1]])
    assert [r.before for r in got] == sums.tolist()
    plan = with_index(rows, ["k"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Window [row_number" not in plan
