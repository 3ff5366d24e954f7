"""Sets that are saved and loaded, reports of broken rules, and files that are cut off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.analysis import pseudo_correlation, result
from junctura.container import CountSet, event_pairs, make_exclusion, validation_report
from junctura.operators.deviance import library_sums
from junctura.sources import mtx
from junctura.sources.readers import read_genes, read_velocity
from test_analysis import counts, frame  # noqa: F401  (a fixture)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_results_are_saved(spark, counts, tmp_path):  # noqa: F811
    held, _, z = counts
    found = pseudo_correlation(held, frame(spark, z), n_permutations=40, seed=2, key_added="a/b c")
    found.save(str(tmp_path / "set"))
    loaded = CountSet.load(spark, str(tmp_path / "set"))
    want, got = result(found, "a/b c"), result(loaded, "a/b c")
    assert got.metadata == want.metadata
    for table in ("observed", "statistics", "null_distribution"):
        a, b = getattr(want, table), getattr(got, table)
        assert sorted(a.columns) == sorted(b.columns) and rows(a.select(sorted(a.columns))) == rows(b.select(sorted(a.columns))), table
    assert rows(loaded.var.select(sorted(loaded.var.columns))) == rows(found.var.select(sorted(loaded.var.columns)))
    assert loaded.meta["m2_valid"]


def test_a_set_is_saved_over_itself(spark, counts, tmp_path):  # noqa: F811
    path = str(tmp_path / "set")
    counts[0].save(path)
    some = CountSet.load(spark, path)
    fewer = some.select_cells(some.obs.where("cell_idx < 10"))
    fewer.save(path)
    again = CountSet.load(spark, path)
    assert again.obs.count() == 10 and some.obs.count() == 30  # what was loaded before can still be read


def test_a_failed_save_leaves_the_old_set(spark, counts, tmp_path):  # noqa: F811
    path = str(tmp_path / "set")
    counts[0].save(path)
    broken = counts[0].with_layer("M2", counts[0].layers["M1"].withColumn("value", F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        broken.save(path)
    assert rows(CountSet.load(spark, path).layers["M2"]) == rows(counts[0].layers["M2"])


def test_buckets_save_a_shuffle(spark, counts, tmp_path):  # noqa: F811
    counts[0].save(str(tmp_path / "set"), buckets=3)
    loaded = CountSet.load(spark, str(tmp_path / "set"))
    assert rows(loaded.layers["M1"]) == rows(counts[0].layers["M1"])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = library_sums(event_pairs(loaded, "sample_id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "partial_sum" in x]
    assert len(lines) == 2 and "Exchange" in lines[0]  # the sums are exchanged, and nothing before them


def test_report(spark, counts):  # noqa: F811
    held = counts[0]
    assert {r.rule: r.n for r in validation_report(held).collect()} == dict.fromkeys(["names", "kinds", "group_count", "values", "repeated", "features", "cells"], 0)
    var = held.var.withColumn("name", F.lit("same")).withColumn("group_kind", F.when(F.col("feature_idx") == 0, "X").otherwise("S")).withColumn("group_count", F.lit(3))
    bad = spark.createDataFrame([(0, 0, None), (1, 1, float("nan")), (1, 2, -1.0), (99, 0, 1.0), (0, 77, 1.0), (0, 77, 1.0)], "feature_idx long, cell_idx long, value double")
    got = {r.rule: r.n for r in validation_report(CountSet(held.obs, var, {"M1": bad})).collect()}
    assert got == {"names": 4, "kinds": 1, "group_count": 4, "values": 3, "repeated": 1, "features": 1, "cells": 2}


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def matrix(n_rows, entries, declared=None):
    return f"%%MatrixMarket matrix coordinate integer general\n{n_rows} 2 {len(entries) if declared is None else declared}\n" + "".join(f"{r} {c} {v}\n" for r, c, v in entries)


def velocity_sample(folder, stacked, cut):
    raw = folder / "Solo.out/Velocyto/raw"
    put(raw / "barcodes.tsv", "AC\nGT\n")
    put(raw / "features.tsv", "g1\ta\tGene Expression\ng2\tb\tGene Expression\n")
    entries = [(1, 1, 3), (2, 2, 5)]
    if stacked:
        put(raw / "matrix.mtx", matrix(6, [(1, 1, 3), (4, 2, 5)], 3 if cut else None))
    else:
        for i, layer in enumerate(("spliced", "unspliced", "ambiguous")):
            put(raw / f"{layer}.mtx", matrix(2, entries, 3 if cut and i == 2 else None))
    return str(folder)


@pytest.mark.parametrize("stacked", [False, True])
def test_velocity_files_that_are_cut_off(spark, tmp_path, stacked):
    whole = velocity_sample(tmp_path / "whole", stacked, False)
    found = read_velocity(spark, [whole], ["s"], use_internal_whitelist=False)
    assert rows(found.layers["spliced"].select("value")) == ([(3.0,)] if stacked else [(3.0,), (5.0,)])
    with pytest.raises(ValueError, match="cut off"):
        read_velocity(spark, [velocity_sample(tmp_path / "cut", stacked, True)], ["s"], use_internal_whitelist=False)


def test_positions_without_lines(spark, tmp_path):
    raw = tmp_path / "s/Solo.out/Gene/raw"
    put(raw / "barcodes.tsv", "AC\nGT\n")
    put(raw / "features.tsv", "g1\ta\tGene Expression\ng2\tb\tGene Expression\n")
    put(raw / "matrix.mtx", matrix(2, [(1, 1, 3)]))
    put(tmp_path / "s/positions.csv", "\n")
    with pytest.warns(UserWarning, match="no cells"):
        assert read_genes(spark, [str(tmp_path / "s")], ["s"], tissue_positions=str(tmp_path / "s/positions.csv")).obs.count() == 0


def test_matrix_is_scanned_once(spark, tmp_path):
    put(tmp_path / "m.mtx", matrix(3, [(1, 1, 3), (1, 1, 4), (3, 2, 1)]))
    head = mtx.header(spark, str(tmp_path / "m.mtx"))
    assert (head.rows, head.cols, head.entries, head.symmetric) == (3, 2, 3, False)
    found = mtx.checked_entries(spark, str(tmp_path / "m.mtx"), head, "here")
    assert rows(found) == [(0, 0, 3.0), (0, 0, 4.0), (2, 1, 1.0)]
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("context", "")
    with pytest.raises(ValueError, match="cut off"):
        mtx.checked_entries(spark, str(tmp_path / "m.mtx"), mtx.Header(3, 2, 4, False), "here")
    for e in np.arange(3):
        put(tmp_path / f"e{e}.mtx", "%%MatrixMarket matrix coordinate integer general\n% none\n")
    with pytest.raises(ValueError, match="no dimension line"):
        mtx.header(spark, str(tmp_path / "e0.mtx"))


def test_tables_are_exported(spark, counts, tmp_path):  # noqa: F811
    """Result tables have plain columns: written as CSV and read again, they are the same."""
    held, _, z = counts
    found = result(pseudo_correlation(held, frame(spark, z), n_permutations=5, seed=2))
    for table in (found.statistics, found.null_distribution, found.observed):
        path = str(tmp_path / "-".join(sorted(table.columns))[:40])
        table.write.option("header", True).csv(path)
        again = spark.read.option("header", True).schema(table.schema).csv(path)
        assert rows(again) == rows(table)
