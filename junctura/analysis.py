"""Analyses of sets of counts: they check their arguments and give a new set."""

from __future__ import annotations

from dataclasses import replace
from numbers import Integral

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .container import CountSet, event_pairs, event_rows, validate_events, validate_pair
from .functions import staged, with_index
from .operators import association as A
from .operators import deviance, variance


def _whole(name: str, value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, Integral) or value < least:
        raise ValueError(f"{name} is a whole number of {least} or more, not {value!r}")
    return int(value)


def _key(key_added) -> str:
    if not isinstance(key_added, str) or not key_added:
        raise ValueError("key_added is a name")
    return key_added


def pseudo_correlation(counts: CountSet, z: DataFrame, *, metric: str = "CoxSnell", n_permutations: int = 100, seed: int | None = None, key_added: str = "pseudo_correlation") -> CountSet:
    """Association of every event with its predictor; z: (feature_idx, z array<double>), a value for each cell in order of
    cell_idx. `var` gets the observed value under key_added, with its null's number, mean and deviation, and p and q values;
    result() gives the tables. What an earlier call left under the key goes."""
    if metric not in A.METRICS:
        raise ValueError(f"metric is one of {A.METRICS}, not {metric!r}")
    n_permutations, key = _whole("n_permutations", n_permutations, 0), _key(key_added)
    if seed is not None:
        seed = _whole("seed", seed, 0)
    validate_pair(counts)
    validate_events(counts)
    n_cells, n_events = counts.obs.count(), counts.var.count()
    z = staged(z.withColumn("size", F.size("z")))  # made once; what follows reads the sizes alone
    seen = z.select("feature_idx", "size").join(counts.var.select("feature_idx"), "feature_idx").agg(F.count("*").alias("n"), F.countDistinct("feature_idx").alias("events"), F.min("size").alias("least"), F.max("size").alias("most")).first()
    if (seen["n"], seen["events"]) != (n_events, n_events) or n_events and (seen["least"], seen["most"]) != (n_cells, n_cells):
        raise ValueError(f"z needs one row of {n_cells} numbers for each of {n_events} events; has {seen['n']} rows of {seen['least']} to {seen['most']}")
    order = staged(with_index(counts.obs.select("cell_idx"), ["cell_idx"], "place"))
    pairs = (event_rows(counts) if n_permutations else event_pairs(counts)).join(order, "cell_idx").select("event_idx", F.col("place").alias("cell_idx"), "m1", "m2")
    found = A.association(pairs, z.select(F.col("feature_idx").alias("event_idx"), "z"), n_cells, metric, n_permutations, seed)
    columns = {"observed": key, "n_valid": f"{key}_n_valid", "null_mean": f"{key}_null_mean", "null_sd": f"{key}_null_sd", "p_value": f"{key}_p_value", "q_value": f"{key}_q_value"}
    kept = counts.var.drop(*columns.values())
    observed = found.observed.select(F.col("event_idx").alias("feature_idx"), F.col("observed").alias(key))
    tested = found.statistics.select(F.col("event_idx").alias("feature_idx"), *[F.col(c).alias(n) for c, n in columns.items() if c != "observed"])
    var = kept.join(observed, "feature_idx", "left").join(tested, "feature_idx", "left")
    return replace(counts, var=staged(var), results=counts.results | {key: found})


def result(counts: CountSet, key: str = "pseudo_correlation") -> A.AssociationResult:
    """The tables of an association, with names of events; KeyError where there is none of this key."""
    if key not in counts.results:
        raise KeyError(f"no association is stored as {key!r}; there are {sorted(counts.results)}")
    names = counts.var.select(F.col("feature_idx").alias("event_idx"), "name")
    held = counts.results[key]
    return replace(held, statistics=held.statistics.join(names, "event_idx"), null_distribution=held.null_distribution.join(names, "event_idx"), metadata=held.metadata | {"key": key})


def highly_variable_events(counts: CountSet, *, sample_key: str = "sample_id", min_row_sum: float = 50.0, n_top: int | None = None, key_added: str = "highly_variable") -> CountSet:
    """`var` gets sum_deviance over the libraries of obs[sample_key], and which events have the highest."""
    if sample_key not in counts.obs.columns:
        raise KeyError(f"obs has no column {sample_key!r}")
    key = _key(key_added)
    if n_top is not None:
        n_top = _whole("n_top", n_top, 1)
    events = counts.var.drop("sum_deviance", key).withColumnRenamed("feature_idx", "event_idx")
    marked = deviance.highly_variable_events(events, event_pairs(counts, sample_key), min_row_sum, n_top, key)
    return replace(counts, var=staged(marked.withColumnRenamed("event_idx", "feature_idx")))


def highly_variable_genes(counts: CountSet, *, layer: str = "X", span: float = 0.3, n_top: int | None = None, key_added: str = "highly_variable") -> CountSet:
    """`var` gets means, variances and variances_norm of the layer, and which genes have the highest of these."""
    if layer not in counts.layers:
        raise KeyError(f"there is no layer {layer!r}")
    if not span > 0:
        raise ValueError(f"span is above 0, not {span!r}")
    key = _key(key_added)
    if n_top is not None:
        n_top = _whole("n_top", n_top, 1)
    genes = counts.var.drop("means", "variances", "variances_norm", key)
    return replace(counts, var=staged(variance.highly_variable_genes(counts.layers[layer], genes, counts.obs.count(), n_top, span, key)))
