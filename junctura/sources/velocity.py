"""The three layers of a velocity matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import LAYERS


def join_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """The rows of all layers, with the name of theirs."""
    return reduce(DataFrame.unionByName, [rows.withColumn("layer", F.lit(name)) for name, rows in layers.items()])


def unstack(stacked: DataFrame, n_features: int) -> DataFrame:
    """(layer, feature_idx, ...) from rows whose `row` counts through three blocks of n_features."""
    block = F.expr(f"row div {n_features}").cast("int")
    return stacked.withColumn("layer", F.get(F.array(*map(F.lit, LAYERS)), block)).withColumn("feature_idx", F.expr(f"row % {n_features}")).drop("row")
