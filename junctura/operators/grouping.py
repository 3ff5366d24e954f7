"""Junctions of several samples, and the events they make where they compete for a splice site."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_name, measured, row_name, splice_key, with_index

KEY = ["chr", "start", "end", "strand"]
KINDS = {"start_end": ("S", "E"), "start": ("S",), "end": ("E",)}


def union_junctions(junctions: DataFrame) -> DataFrame:
    """One row per (chr, start, end, strand) of all samples' rows: the greatest is_annot and unique_mapped, the first
    intron_motif, and `seen`, the first place in order. Rows have `ord`, their place over all samples."""
    return junctions.groupBy(*KEY).agg(
        F.max("is_annot").alias("is_annot"), F.max("unique_mapped").alias("unique_mapped"),
        F.min_by("intron_motif", "ord").alias("intron_motif"), F.min("ord").alias("seen"),
    )


def splice_events(junctions: DataFrame, kind: str = "start_end") -> DataFrame:
    """An S event for each junction that shares (chr, start, strand) with another, an E event for each that shares
    (chr, end, strand). `junction_idx` orders junctions; all S events come before all E events. Adds group_kind,
    group_count, group_key, row_name and name. Unordered: see number_events()."""
    if kind not in KINDS:
        raise ValueError(f"ljv_kind is one of {', '.join(KINDS)}, not {kind!r}")
    sites = {"S": "start", "E": "end"}
    counted = junctions
    for k in KINDS[kind]:
        counted = counted.withColumn(f"_{k}", F.count("*").over(Window.partitionBy("chr", sites[k], "strand")))
    ways = F.array(*[F.struct(F.lit(k).alias("group_kind"), F.col(f"_{k}").cast("int").alias("group_count"), splice_key(F.lit(k), "chr", sites[k], "strand").alias("group_key"), F.lit(i).alias("kind_order")) for i, k in enumerate(KINDS[kind])])
    grown = counted.withColumn("_way", F.explode(F.filter(ways, lambda w: w.group_count > 1)))
    flat = grown.select(*junctions.columns, "_way.*").withColumn("row_name", row_name("chr", "start", "end"))
    return flat.withColumn("name", event_name("row_name", "group_kind"))


def number_events(events: DataFrame) -> DataFrame:
    """Adds event_idx (S events in order of junction, then E events) and group_id (dense, by first appearance): a group's
    id is the number of groups whose first event comes before its own."""
    order = ["kind_order", "junction_idx"]
    by_group = Window.partitionBy("group_key")
    opened = events.withColumn("_opens", (F.row_number().over(by_group.orderBy(*order)) == 1).cast("int"))
    placed = with_index(opened, order, "event_idx", {"_groups": "_opens"})
    return placed.withColumn("group_id", F.max(F.when(F.col("_opens") == 1, F.col("_groups"))).over(by_group)).drop("_opens", "_groups")


def events_in_samples(m1: DataFrame, samples: DataFrame, least: int) -> DataFrame:
    """(event_idx, n_samples) of events that have counts in `least` samples or more, from (cell_idx, sample_id)."""
    there = m1.where("value <> 0").join(samples.select("cell_idx", "sample_id"), "cell_idx")
    return there.groupBy("event_idx").agg(F.countDistinct("sample_id").alias("n_samples")).where(F.col("n_samples") >= least)


def filter_min_counts(events: DataFrame, m1: DataFrame, min_counts: int) -> DataFrame:
    """Events whose counts over all cells add up to min_counts or more, without those whose group then has one member;
    group_count is counted again. Events without counts have 0. A bound of 0 or less leaves all as they are."""
    if min_counts <= 0:
        return events
    totals = m1.groupBy("event_idx").agg(F.sum("value").alias("_total"))
    kept = events.join(totals, "event_idx", "left").where(F.coalesce("_total", F.lit(0.0)) >= min_counts).drop("_total")
    return kept.withColumn("group_count", F.count("*").over(Window.partitionBy("group_key")).cast("int")).where("group_count > 1")


def checked_min_counts(events: DataFrame, m1: DataFrame, min_counts: int) -> DataFrame:
    """filter_min_counts() with events numbered anew (the former number is `_old`), and with the reader's warnings and errors,
    whose numbers are taken while the tables are written."""
    totals = m1.groupBy("event_idx").agg(F.sum("value").alias("_total"))
    passes = F.coalesce("_total", F.lit(0.0)) >= min_counts
    scored, seen = measured(events.join(totals, "event_idx", "left").withColumn("_passes", passes).drop("_total"), n=F.count(F.lit(1)), passed=F.sum(F.when(F.col("_passes"), 1).otherwise(0)))
    if not seen["passed"]:
        raise ValueError(f"none of {seen['n']} events has min_counts={min_counts}")
    kept = scored.where("_passes").drop("_passes").withColumn("group_count", F.count("*").over(Window.partitionBy("group_key")).cast("int")).where("group_count > 1")
    fresh, after = measured(number_events(kept.withColumnRenamed("event_idx", "_old").drop("group_id")), n=F.count(F.lit(1)))
    if seen["passed"] > after["n"]:
        warnings.warn(f"{seen['passed'] - after['n']} events have min_counts={min_counts} but are dropped, as no other of their group has", stacklevel=3)
    if not after["n"]:
        raise ValueError(f"with min_counts={min_counts} no group has two events left")
    return fresh
