"""Connected components of a graph that is as large as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: the edges are stars around least nodes."""
    twice = edges.groupBy("u").count().where("count > 1").select(F.col("u").alias("x"))
    chained = edges.select(F.col("v").alias("x")).join(edges.select(F.col("u").alias("x")), "x", "left_semi")
    return not twice.unionByName(chained).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v), where a component is its least node.

    Large-star and small-star steps alternate until the edges are stars, which takes a number of rounds that is about the
    logarithm of the longest path. Each round is a staged table; the driver sees only whether there are open edges.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        now = stage(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
