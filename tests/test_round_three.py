"""Shapes of tables that the smallest scale doesn't have."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from junctura.operators import association as A
from junctura.plans import written  # noqa: F401  (registers its queries)
from junctura.plans.queries import QUERIES, SQL
from test_operators import one_event


def tables(folder, brands, sizes, n=300, cells=6, lines=5, strands=True):
    """Tables of random line items over all brands and sizes, in folder and as views of a connection; without
    `strands`, a brand has one strand only."""
    rng, parts = np.random.default_rng(5), len(brands) * len(sizes)
    part = rng.integers(1, parts + 1, n)
    strand = rng.choice(["F", "O"], n) if strands else np.where(part <= len(sizes), "F", "O")
    folder.mkdir()
    pq.write_table(pa.table({"p_partkey": np.arange(1, parts + 1), "p_brand": [b for b in brands for _ in sizes], "p_type": ["t"] * parts, "p_size": pa.array([s for _ in brands for s in sizes], pa.int32())}), folder / "part.parquet")
    pq.write_table(pa.table({"l_orderkey": np.arange(n), "l_partkey": part, "l_suppkey": rng.integers(1, cells + 1, n), "l_linenumber": pa.array(rng.integers(1, lines, n), pa.int32()), "l_quantity": rng.integers(1, 9, n).astype(float), "l_returnflag": rng.choice(["A", "N", "R"], n), "l_linestatus": strand}), folder / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": np.arange(1, cells + 1), "s_name": [f"s{i}" for i in range(cells)], "s_nationkey": pa.array(np.arange(cells), pa.int32()), "s_acctbal": np.full(cells, 7000.0)}), folder / "supplier.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


def same(spark, folder, con, name):
    rows = lambda found: sorted(map(repr, found))
    got = QUERIES[name](spark, folder)
    expect = con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert expect and rows(map(tuple, got.collect())) == rows(expect)
    return expect


def test_names_that_only_a_separator_tells_apart(spark, tmp_path):
    # b1 and start 23, b12 and start 3: both are "b123" in the names of validation_counts
    folder, con = tables(tmp_path / "t", ["b1", "b12"], [15, 16, 115, 116], strands=False)
    assert dict(same(spark, folder, con, "validation_counts"))["names"] > 0


@pytest.mark.parametrize("metric", A.METRICS)
def test_draws_of_a_predictor_with_few_levels(spark, metric):
    """No long row of a predictor goes to all tasks, and cells that agree are fitted as one, in one task or in parts."""
    rng, cells = np.random.default_rng(4), 400
    m = rng.integers(0, 4, (2, 3, cells)) * (rng.random((2, 3, cells)) < 0.6)
    z = rng.integers(0, 2, (3, cells)) + 0.0
    rows = [(e, c, float(m[0, e, c]), float(m[1, e, c])) for e in range(3) for c in range(cells) if m[:, e, c].any()]
    pairs = spark.createDataFrame(rows, "event_idx long, cell_idx long, m1 double, m2 double")
    zf = spark.createDataFrame([(e, row.tolist()) for e, row in enumerate(z)], "event_idx long, z array<double>")
    draws = A.permutations(cells, 40, 9)
    for split in (None, 100):
        found = A.null_blocks(pairs, zf, metric, cells, 40, 9, split=split)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.event_idx, r.first): r for r in found.collect()}
        assert sorted(got) == [(e, b) for e in range(3) for b in (1, 33)]
        for (e, first), r in got.items():
            assert r.observed == pytest.approx(one_event(z[e], m[0, e], m[1, e], metric), abs=1e-8)
            assert r.null == pytest.approx([one_event(z[e][d], m[0, e], m[1, e], metric) for d in draws[first - 1 : first + 31]], abs=1e-8)


def test_pairs_with_their_predictor(spark):
    """Without draws no predictor is held as a row: cells that agree come to one row per kind before they are fitted."""
    pairs = spark.range(0, 40_000, 1, 4).selectExpr("id % 2 as event_idx", "id as cell_idx", "double(id * 7 % 5) as m1", "double(id * 11 % 6) as m2", "double(id div 3 % 2) as z")
    pdf = pairs.toPandas()
    for split in (None, 0):
        got = {r.event_idx: r.observed for r in A.event_correlations(pairs, None, split=split).collect()}
        for e, own in pdf.groupby("event_idx"):
            assert got[e] == pytest.approx(one_event(own["z"].to_numpy(), own["m1"].to_numpy(), own["m2"].to_numpy(), "CoxSnell"), abs=1e-8)
    assert A._patterns(pairs.where("m1 + m2 > 0"), None).count() <= 2 * 2 * 10


def test_long_files_are_sorted_by_ranges(spark, tmp_path, monkeypatch):
    """No task sorts more than LINES lines, and those of a file still come in order, repeated places together."""
    monkeypatch.setattr(written, "LINES", 1000, raising=False)
    rows = spark.range(0, 30_000, 1, 6).selectExpr("id * 7919 % 30000 div 3 as place", "concat('v', id * 7919 % 30000 div 3) as value")
    most = []
    plain = type(rows).sortWithinPartitions

    def watched(df, *columns):
        out = plain(df, *columns)
        most.extend(len(p) for p in out.rdd.glom().collect())
        return out

    monkeypatch.setattr(type(rows), "sortWithinPartitions", watched)
    written.write_file(rows, f"{tmp_path}/file")
    assert (tmp_path / "file").read_text().split() == [f"v{i // 3}" for i in range(30_000)]
    assert max(most) < 3000 and not (tmp_path / "file.parts").exists()
    written.write_matrix(rows.selectExpr("place as row", "0L as col", "1L as value"), (10_000, 1), f"{tmp_path}/matrix")
    lines = (tmp_path / "matrix").read_text().split("\n")
    assert lines[0].startswith("%%MatrixMarket") and lines[2] == "10000 1 30000" and len(lines) == 30_004


def test_deviance_without_pairs(spark):
    """Sums by library come from the counts that there are, and equal those of all pairs."""
    from junctura.operators import deviance as D
    from junctura.operators.exclusion import paired_counts

    rng = np.random.default_rng(6)
    events = spark.createDataFrame([(e, e // 4) for e in range(14)], "event_idx long, group_id long")
    counts = [(int(e), int(c), float(v)) for e, c, v in zip(rng.integers(0, 14, 300), rng.integers(0, 40, 300), rng.integers(1, 9, 300))]  # some repeated
    m1 = spark.createDataFrame(counts, "event_idx long, cell_idx long, value double")
    libraries = spark.createDataFrame([(c, f"s{c % 3}") for c in range(38)], "cell_idx long, library string")
    expect = D.library_sums(paired_counts(events, m1).join(libraries, "cell_idx")).collect()
    sums = D.grouped_sums(events, m1, libraries)
    got = {(r.event_idx, r.library): (r.y, r.n, r.own) for r in sums.collect()}
    assert len(expect) == len(got) and all(got[r.event_idx, r.library] == pytest.approx((r.y, r.n, r.own), abs=1e-9) for r in expect)


def test_draws_from_counts_that_stand_apart(spark, monkeypatch):
    """Inclusion and exclusion counts needn't be joined, and cells not be listed by event, before events are drawn."""
    rng, cells = np.random.default_rng(8), 300
    m = rng.integers(0, 4, (2, 5, cells)) * (rng.random((2, 5, cells)) < 0.5)
    z = rng.integers(0, 3, (5, cells)) + 0.0
    rows = [(e, c, *(float(m[k, e, c]) if i == k else 0.0 for i in (0, 1))) for k in (0, 1) for e in range(5) for c in range(cells) if m[k, e, c]]
    counts = spark.createDataFrame(rows, "event_idx long, cell_idx long, m1 double, m2 double").repartition(3)
    zf = spark.createDataFrame([(e, row.tolist()) for e, row in enumerate(z)], "event_idx long, z array<double>")
    monkeypatch.setattr(A, "GATHERED", 250, raising=False)
    draws = A.permutations(cells, 3, 9)
    for split in (None, cells, 100):
        found = A.null_blocks(counts, zf, "CoxSnell", cells, 3, 9, split=split)
        if split != 100:
            assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.event_idx: r for r in found.collect()}
        for e in range(5):
            assert got[e].observed == pytest.approx(one_event(z[e], m[0, e], m[1, e], "CoxSnell"), abs=1e-8)
            assert got[e].null == pytest.approx([one_event(z[e][d], m[0, e], m[1, e], "CoxSnell") for d in draws], abs=1e-8)


def test_predictors_are_made_by_many_tasks(spark):
    from junctura.functions import spread

    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 4
