import json

import numpy as np
import pytest

from junctura.analysis import highly_variable_events, highly_variable_genes, pseudo_correlation, result
from junctura.container import CountSet, make_exclusion
from test_operators import one_event

CELLS = 30


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(1, 9, (4, CELLS)) * (rng.random((4, CELLS)) < 0.7)
    var = spark.createDataFrame([(e, "1", 10, 20 + e, "+", f"r{e}", "S", 2, e // 2, f"e{e}") for e in range(4)], "feature_idx long, chr string, start long, end long, strand string, row_name string, group_kind string, group_count int, group_id long, name string")
    obs = spark.createDataFrame([(c, f"c{c}", "ab"[c % 2]) for c in range(CELLS)], "cell_idx long, cell string, sample_id string")
    m1 = spark.createDataFrame([(e, c, float(m[e, c])) for e in range(4) for c in range(CELLS) if m[e, c]], "feature_idx long, cell_idx long, value double")
    return make_exclusion(CountSet(obs, var, {"M1": m1, "X": m1})), m.astype(float), rng.normal(size=(4, CELLS))


def frame(spark, z):
    return spark.createDataFrame([(e, row.tolist()) for e, row in enumerate(z)], "feature_idx long, z array<double>")


def test_pseudo_correlation_of_a_set(spark, counts):
    held, m, z = counts
    found = pseudo_correlation(held, frame(spark, z), n_permutations=9, seed=2)
    got = {r.feature_idx: r for r in found.var.collect()}
    for e in range(4):
        assert got[e].pseudo_correlation == pytest.approx(one_event(z[e], m[e], m[e ^ 1], "CoxSnell"), abs=1e-8)
        assert got[e].pseudo_correlation_n_valid <= 9 and 0 < got[e].pseudo_correlation_p_value <= got[e].pseudo_correlation_q_value <= 1
    tables = result(found)
    assert tables.null_distribution.count() == 36 and tables.metadata["n_permutations"] == 9 and {r.name for r in tables.statistics.collect()} == {"e0", "e1", "e2", "e3"}
    again = pseudo_correlation(found, frame(spark, z), n_permutations=0)
    assert result(again).null_distribution.count() == 0 and again.var.where("pseudo_correlation_p_value is not null").count() == 0
    assert again.var.where("pseudo_correlation is not null").count() == 4 and not held.results
    some = pseudo_correlation(held.select_cells(held.obs.where("cell_idx >= 10")), frame(spark, z[:, 10:]), n_permutations=0)
    assert {r.feature_idx: r.pseudo_correlation for r in some.var.collect()}[1] == pytest.approx(one_event(z[1, 10:], m[1, 10:], m[0, 10:], "CoxSnell"), abs=1e-8)
    with pytest.raises(KeyError):
        result(found.select_features(found.var))


@pytest.mark.parametrize("wrong", [{"metric": "R2"}, {"n_permutations": -1}, {"n_permutations": True}, {"n_permutations": 1.5}, {"seed": "x"}, {"key_added": ""}])
def test_arguments(spark, counts, wrong):
    with pytest.raises(ValueError):
        pseudo_correlation(counts[0], frame(spark, counts[2]), **wrong)


def test_shapes_and_states(spark, counts):
    held, _, z = counts
    for bad in (z[:, 1:], np.hstack([z, z[:, :1]]), z[1:]):
        with pytest.raises(ValueError):
            pseudo_correlation(held, frame(spark, bad))
    with pytest.raises(RuntimeError):
        pseudo_correlation(held.select_features(held.var), frame(spark, z))
    with pytest.raises(KeyError):
        highly_variable_events(held, sample_key="nothing")
    for call in (lambda: highly_variable_events(held, n_top=0), lambda: highly_variable_genes(held, span=0), lambda: highly_variable_genes(held, n_top=0)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        highly_variable_genes(held, layer="nothing")


def test_variable_events_and_genes(spark, counts):
    held = counts[0]
    events = highly_variable_events(held, min_row_sum=5, n_top=2)
    assert events.var.where("highly_variable").count() == 2 and events.var.where("sum_deviance > 0").count() == 4
    genes = highly_variable_genes(highly_variable_genes(held), n_top=1)
    assert genes.var.where("highly_variable").count() == 1 and {"means", "variances", "variances_norm"} <= set(genes.var.columns)


def test_older_settings(spark, counts, tmp_path):
    path = str(tmp_path / "set")
    counts[0].save(path)
    spark.createDataFrame([(json.dumps({"older": {"m2_valid": True}, "layers": ["M1"]}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    with pytest.warns(FutureWarning):
        assert CountSet.load(spark, path, "older").meta["m2_valid"]
