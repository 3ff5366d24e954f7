"""A set of counts: cells, features, layers in long form, and settings."""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The key of the settings.
NAMESPACE = "junctura"
EVENT_COLUMNS = ("chr", "start", "end", "strand", "row_name", "group_kind", "group_count", "group_id")


@dataclass
class Settings:
    """Kept for callers that set them; Spark decides the parallelism."""

    verbosity: int = 1
    n_jobs: int = 1

    def __repr__(self) -> str:
        return f"Settings(verbosity={self.verbosity}, n_jobs={self.n_jobs})"


settings = Settings()


@dataclass(frozen=True)
class CountSet:
    """obs: a row per cell_idx; var: a row per feature_idx; layers: (feature_idx, cell_idx, value double), absent is zero;
    meta: plain values. Nothing is changed in place: what changes a set gives a new one."""

    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)
    #: Tables of associations by key, which belong to these features and cells.
    results: dict[str, Any] = field(default_factory=dict)

    def with_layer(self, name: str, rows: DataFrame, **meta: Any) -> CountSet:
        return replace(self, layers=self.layers | {name: rows}, meta=self.meta | meta)

    def select_cells(self, cells: DataFrame) -> CountSet:
        """Cells of the given cell_idx. Exclusion counts stay valid: they are made cell by cell."""
        keep = cells.select("cell_idx").distinct()
        return replace(self, obs=self.obs.join(keep, "cell_idx", "left_semi"), layers={n: x.join(keep, "cell_idx", "left_semi") for n, x in self.layers.items()}, results={})

    def select_features(self, features: DataFrame) -> CountSet:
        """Features of the given feature_idx. Exclusion counts aren't valid any more: groups have changed."""
        keep = features.select("feature_idx").distinct()
        return replace(self, var=self.var.join(keep, "feature_idx", "left_semi"), layers={n: x.join(keep, "feature_idx", "left_semi") for n, x in self.layers.items()}, meta=self.meta | {"m2_valid": False}, results={})

    def save(self, path: str, buckets: int | None = None) -> None:
        """A snapshot: obs, var, layers and the tables of results go to a new folder under path, and `meta`, which names it, is put
        in place last and at once. Readers see the old set or the new one, whatever fails; a set that was loaded from path can
        be saved there. With `buckets`, layers are bucketed by feature and cell, so that joining them and adding up by feature
        and cell needs no shuffle after load(); rows are brought together first, so that a bucket is one file."""
        spark, data = self.obs.sparkSession, f"data-{uuid.uuid4().hex}"
        self.obs.write.parquet(f"{path}/{data}/obs")
        self.var.write.parquet(f"{path}/{data}/var")
        for name, rows in self.layers.items():
            if buckets:
                rows.repartition(buckets, "feature_idx", "cell_idx").write.bucketBy(buckets, "feature_idx", "cell_idx").sortBy("feature_idx", "cell_idx").option("path", f"{path}/{data}/layers/{name}").saveAsTable(f"layer_{uuid.uuid4().hex}")
            else:
                rows.write.parquet(f"{path}/{data}/layers/{name}")
        for i, held in enumerate(self.results.values()):
            for table in RESULT_TABLES:
                getattr(held, table).write.parquet(f"{path}/{data}/results/{i}/{table}")
        told = {NAMESPACE: self.meta, "layers": {n: rows._jdf.schema().toDDL() if buckets else None for n, rows in self.layers.items()}, "buckets": buckets, "results": {key: held.metadata for key, held in self.results.items()}, "data": data}
        put_text(spark, json.dumps(told), f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str, older: str | None = None) -> CountSet:
        """The last snapshot. `older` is a key under which an earlier program left its settings; settings that don't name a
        snapshot go with the tables beside them, or with the latest snapshot."""
        from .operators.association import AssociationResult

        held = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
        base = f"{path}/{held['data']}" if "data" in held else _beside(spark, path)

        def layer(name: str) -> DataFrame:
            if not held.get("buckets"):
                return spark.read.parquet(f"{base}/layers/{name}")
            table = f"layer_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {table} ({held['layers'][name]}) USING parquet CLUSTERED BY (feature_idx, cell_idx) SORTED BY (feature_idx, cell_idx) INTO {int(held['buckets'])} BUCKETS LOCATION '{base}/layers/{name}'")
            return spark.table(table)

        results = {key: AssociationResult(*[spark.read.parquet(f"{base}/results/{i}/{t}") for t in RESULT_TABLES], metadata) for i, (key, metadata) in enumerate(held.get("results", {}).items())}
        return CountSet(spark.read.parquet(f"{base}/obs"), spark.read.parquet(f"{base}/var"), {n: layer(n) for n in held["layers"]}, namespace(held, older), results)


RESULT_TABLES = ("observed", "statistics", "null_distribution")


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """A file of this text in place of what is at path, by one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-{uuid.uuid4().hex}"))
    fs = to.getFileSystem(conf)
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to) and fs.getFileStatus(to).isDirectory():  # as earlier versions wrote it
        fs.delete(to, True)
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(to), over)


def _beside(spark: SparkSession, path: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(folder)}
    return path if "obs" in found else f"{path}/{max((n for n in found if n.startswith('data-')), key=found.get)}"


def namespace(held: dict[str, Any], older: str | None = None) -> dict[str, Any]:
    """The settings, moved from an older key with a warning where only that is there."""
    if NAMESPACE not in held and older is not None and older in held:
        warnings.warn(f"settings under {older!r} are read as {NAMESPACE!r}", FutureWarning, stacklevel=3)
        held[NAMESPACE] = held.pop(older)
    return held.setdefault(NAMESPACE, {})


def _check_layer(counts: CountSet, name: str) -> None:
    if name not in counts.layers:
        raise KeyError(f"layers[{name!r}] is missing")
    kinds = dict((f.name, f.dataType) for f in counts.layers[name].schema)
    if not {"feature_idx", "cell_idx", "value"} <= set(kinds) or not isinstance(kinds["value"], DoubleType):
        raise TypeError(f"layers[{name!r}] must have feature_idx, cell_idx and a double value")


def validate_inclusion(counts: CountSet) -> None:
    _check_layer(counts, "M1")


def validate_pair(counts: CountSet, require_valid: bool = True) -> None:
    for name in ("M1", "M2"):
        _check_layer(counts, name)
    if require_valid and not counts.meta.get("m2_valid", False):
        raise RuntimeError("M2 is not valid for these features; make it again")


def validate_events(counts: CountSet) -> None:
    """The columns of events, unique names, and kinds S and E only: one aggregation."""
    if missing := [c for c in EVENT_COLUMNS if c not in counts.var.columns]:
        raise KeyError(f"var misses columns {missing}")
    seen = counts.var.agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum(F.when(F.col("group_kind").isin("S", "E"), 0).otherwise(1)).alias("odd")).first()
    if seen["n"] != seen["names"]:
        raise ValueError("var names are not unique")
    if seen["odd"]:
        raise ValueError("events of a group_kind other than S and E")


def validation_report(counts: CountSet) -> DataFrame:
    """(rule, n): how many rows break each rule of a set of events, in place of the first error that the validate functions
    raise. names: events of a name that another has; kinds: of a kind other than S and E; group_count: whose group has another
    number of members; values: counts that are null, negative or no number; repeated: counts beyond the first of an event and
    cell; features, cells: counts of events and cells that the set lacks."""
    var, m1 = counts.var, counts.layers["M1"]
    named = var.groupBy("name").agg(F.count("*").alias("k")).agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n"))
    kinds = var.agg(F.sum(F.when(F.col("group_kind").isin("S", "E"), 0).otherwise(1)).alias("n"))
    sizes = var.groupBy("group_id").agg(F.count("*").alias("k"))
    members = var.join(sizes, "group_id").agg(F.sum(F.when(F.col("group_count") == F.col("k"), 0).otherwise(1)).alias("n"))
    values = m1.agg(F.sum(F.when((F.col("value") >= 0) & ~F.isnan("value"), 0).otherwise(1)).alias("n"))
    repeated = m1.groupBy("feature_idx", "cell_idx").agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("n"))
    lost = lambda other, key: m1.groupBy(key).agg(F.count("*").alias("k")).join(other.select(key), key, "left_anti").agg(F.sum("k").alias("n"))
    rules = {"names": named, "kinds": kinds, "group_count": members, "values": values, "repeated": repeated, "features": lost(var, "feature_idx"), "cells": lost(counts.obs, "cell_idx")}
    return reduce(DataFrame.unionByName, [found.select(F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for rule, found in rules.items()])


def make_exclusion(counts: CountSet) -> CountSet:
    """The set with layer M2."""
    from .operators.exclusion import exclusion_counts

    validate_inclusion(counts)
    validate_events(counts)
    events = counts.var.withColumnRenamed("feature_idx", "event_idx")
    m2 = exclusion_counts(events, counts.layers["M1"].withColumnRenamed("feature_idx", "event_idx")).withColumnRenamed("event_idx", "feature_idx")
    return counts.with_layer("M2", m2, m2_valid=True)


def common_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells (cell_idx) that two modalities have in common, once each."""
    return a.select("cell_idx").intersect(b.select("cell_idx"))


def event_pairs(counts: CountSet, sample_key: str | None = None) -> DataFrame:
    """(event_idx, cell_idx, m1, m2) of a valid set, with the cells' library where a key is given."""
    from .operators.exclusion import pair_layers

    validate_pair(counts)
    pairs = pair_layers(*(counts.layers[n].withColumnRenamed("feature_idx", "event_idx") for n in ("M1", "M2")))
    return pairs if sample_key is None else pairs.join(counts.obs.select("cell_idx", F.col(sample_key).alias("library")), "cell_idx")


def event_rows(counts: CountSet) -> DataFrame:
    """event_pairs() before their counts are brought together: a row (event_idx, cell_idx, m1, m2) per inclusion count, with m2
    zero, and one per exclusion count, with m1 zero. Nothing is shuffled."""
    validate_pair(counts)
    of = lambda n: counts.layers[n].select(F.col("feature_idx").alias("event_idx"), "cell_idx", *[(F.coalesce("value", F.lit(0.0)) if m == n else F.lit(0.0)).alias(m.lower()) for m in ("M1", "M2")])
    return of("M1").unionByName(of("M2"))
