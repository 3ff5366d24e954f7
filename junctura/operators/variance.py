"""Variable genes by standardized variance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import staged, with_index
from .deviance import mark_top

#: A corner's cell has at most span * CELL of the points.
CELL = 0.2


def value_histogram(counts: DataFrame) -> DataFrame:
    """(feature_idx, value, n): how often a gene has a value in the counts. Means, variances and clipped sums come from it, so
    counts are read once, and a gene with many cells is added up in the tasks that read it."""
    return counts.groupBy("feature_idx", "value").agg(F.count("*").alias("n"))


def _weighted(counts: DataFrame) -> DataFrame:
    return counts if "n" in counts.columns else counts.withColumn("n", F.lit(1))


def mean_variance(counts: DataFrame, n_cells: int) -> DataFrame:
    """(feature_idx, n_stored, mean, variance) over all cells, zeros included: sum / n and sum of squares / n - mean^2. From
    counts, or from their histogram."""
    x, n = F.col("value"), F.col("n")
    sums = _weighted(counts).groupBy("feature_idx").agg(F.sum(n).cast("long").alias("n_stored"), (F.sum(x * n) / n_cells).alias("mean"), (F.sum(x * x * n) / n_cells).alias("_square"))
    return sums.select("feature_idx", "n_stored", "mean", (F.col("_square") - F.col("mean") * F.col("mean")).alias("variance"))


def standardized_variance(counts: DataFrame, moments: DataFrame, n_cells: int) -> DataFrame:
    """(feature_idx, variance_standardized) with moments (feature_idx, mean, sd): the sum over all cells of the squared
    z scores, clamped at the root of n, over n - 1. Cells without a row count as zeros. Every row of moments gets a value.
    From counts, or from their histogram."""
    if n_cells <= 1:
        return moments.select("feature_idx", F.lit(0.0).alias("variance_standardized"))
    top = float(np.sqrt(n_cells))
    clamped = lambda z: F.pow(F.least(F.greatest(z, F.lit(-top)), F.lit(top)), F.lit(2.0))
    stored = _weighted(counts).join(moments.select("feature_idx", "mean", "sd"), "feature_idx").groupBy("feature_idx").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * clamped((F.col("value") - F.col("mean")) / F.col("sd"))).alias("_z"))
    zero = clamped(-F.col("mean") / F.col("sd"))
    both = moments.join(stored, "feature_idx", "left")
    total = F.coalesce("_z", F.lit(0.0)) + (F.lit(n_cells) - F.coalesce("_n", F.lit(0))) * zero
    return both.select("feature_idx", (total / (n_cells - 1)).alias("variance_standardized"))


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope at each of `at` of the quadratic fitted to the nearest span * n points under tricube weights."""
    n = len(x)
    q = min(n, max(3, int(np.floor(n * span + 1e-9))))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    values, slopes = np.empty(len(at)), np.empty(len(at))
    for i, v in enumerate(at):
        lo = int(np.clip(np.searchsorted(xs, v) - q, 0, n - q))
        while lo + q < n and xs[lo + q] - v < v - xs[lo]:
            lo += 1
        d = xs[lo : lo + q] - v
        reach = max(np.abs(d).max() * 1.001, 1e-300)
        w = np.sqrt(np.clip(1 - (np.abs(d) / reach) ** 3, 0, None) ** 3)
        fit = np.linalg.lstsq(np.stack([w, w * d / reach, w * (d / reach) ** 2], axis=1), w * ys[lo : lo + q], rcond=1e-10)[0]
        values[i], slopes[i] = fit[0], fit[1] / reach
    return values, slopes


def smooth(x: np.ndarray, y: np.ndarray, span: float = 0.3, cell: float = CELL) -> np.ndarray:
    """Local quadratic regression of points in memory, evaluated at the corners of cells of at most n * span * cell points and joined by cubic
    pieces with the fitted slopes. Input: one point per gene."""
    n = len(x)
    if n < 4:
        return y.copy()
    lo, hi = float(x.min()), float(x.max())
    margin = 0.1 * (hi - lo) + 1e-10
    xs, most, corners = np.sort(x), max(1, int(np.floor(n * span * cell))), {lo - margin, hi + margin}
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a > most:
            m = (a + b) // 2
            cut = (xs[m - 1] + xs[m]) / 2
            if xs[a] < cut < xs[b - 1] and cut not in corners:
                corners.add(float(cut))
                todo += [(a, m), (m, b)]
    at = np.array(sorted(corners))
    value, slope = local_quadratic(x, y, at, span)
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
    h = at[k + 1] - at[k]
    t = (x - at[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * value[k] + t * (1 - t) ** 2 * h * slope[k] + t**2 * (3 - 2 * t) * value[k + 1] + t**2 * (t - 1) * h * slope[k + 1]


def _corners(placed: DataFrame, n: int, most: int) -> list[float]:
    """The corners of smooth() between the least and the greatest x: medians of stretches of ranks, halved until they have at
    most `most` points. The ranks are known beforehand, so one filter brings their few x."""
    todo, cuts = [(0, n)], []
    while todo:
        a, b = todo.pop()
        if b - a > most:
            m = (a + b) // 2
            cuts.append((a, b, m))
            todo += [(a, m), (m, b)]
    ranks = sorted({0, n - 1} | {r for a, b, m in cuts for r in (a, b - 1, m - 1, m)})
    xs = {r["rank"]: r["x"] for r in placed.where(F.col("rank").isin(ranks)).select("rank", "x").collect()}  # a few for each corner
    lo, hi = xs[0], xs[n - 1]
    margin = 0.1 * (hi - lo) + 1e-10
    found, open_ = {lo - margin, hi + margin}, {(0, n)}
    for a, b, m in cuts:  # in the order of smooth(): a stretch that isn't halved has no halves
        cut = (xs[m - 1] + xs[m]) / 2
        if (a, b) in open_ and xs[a] < cut < xs[b - 1] and cut not in found:
            found.add(float(cut))
            open_ |= {(a, m), (m, b)}
    return sorted(found)


def _per_corner(values: list, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def trend(points: DataFrame, span: float = 0.3) -> DataFrame:
    """(feature_idx, fitted): smooth() of points (feature_idx, x, y), a row per gene, without bringing them together.

    Points are numbered in order of x. The nearest span * n points of a corner are neighbours in that order; where they begin
    is the least place at which the next point after them isn't nearer than the first, found for all corners in one pass
    over the points joined with those q places on. A second aggregation gives each corner's moments under tricube weights;
    the driver solves a system of three equations for each corner (about 2 / (span * CELL) of them, whatever the number of
    genes), and the cubic pieces between corners are columns.
    """
    placed = with_index(points.select("feature_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), ["x", "feature_idx"], "rank")
    n = placed.count()
    if n < 4:
        return placed.select("feature_idx", F.col("y").alias("fitted"))
    q = min(n, max(3, int(np.floor(n * span + 1e-9))))
    at = _corners(placed, n, max(1, int(np.floor(n * span * CELL))))
    begins = placed.where(F.col("rank") <= n - q).select("rank", "x")
    ahead = lambda k, name: placed.select((F.col("rank") - k).alias("rank"), F.col("x").alias(name))
    met = begins.join(ahead(q, "next"), "rank", "left").join(ahead(q - 1, "last"), "rank")
    stops = lambda v: F.col("next").isNull() | (F.col("next") - F.lit(v) >= F.lit(v) - F.col("x"))
    first = met.agg(*[F.min(F.when(stops(v), F.struct("rank", "x", "last"))).alias(f"c{i}") for i, v in enumerate(at)]).first()
    lows = [r["rank"] for r in first]
    reach = [max(max(abs(r["x"] - v), abs(r["last"] - v)) * 1.001, 1e-300) for r, v in zip(first, at)]
    corner = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda i: (F.col("rank") >= F.get(_per_corner(lows, "long"), i)) & (F.col("rank") < F.get(_per_corner(lows, "long"), i) + q)), lambda i: i)).alias("corner")
    near = placed.select("x", "y", "rank", corner).withColumn("d", (F.col("x") - F.get(_per_corner(at), F.col("corner"))) / F.get(_per_corner(reach), F.col("corner")))
    weight = F.pow(F.greatest(F.lit(0.0), 1 - F.pow(F.abs("d"), F.lit(3.0))), F.lit(3.0))
    weighed = near.withColumn("w", weight)
    powers = [F.sum(F.col("w") * F.pow("d", F.lit(float(k)))).alias(f"s{k}") for k in range(5)] + [F.sum(F.col("w") * F.col("y") * F.pow("d", F.lit(float(k)))).alias(f"t{k}") for k in range(3)]
    sums = {r["corner"]: r for r in weighed.groupBy("corner").agg(*powers).collect()}  # a row per corner
    value, slope = [], []
    for i, r in enumerate(reach):
        s, t = ([sums[i][f"{c}{k}"] for k in range(m)] for c, m in (("s", 5), ("t", 3)))
        fit = np.linalg.lstsq(np.array([s[0:3], s[1:4], s[2:5]]), np.array(t), rcond=1e-14)[0]
        value.append(float(fit[0]))
        slope.append(float(fit[1] / r))
    k = F.least(F.greatest(F.size(F.filter(_per_corner(at), lambda c: c <= F.col("x"))) - 1, F.lit(0)), F.lit(len(at) - 2))
    of = lambda values, step=0: F.get(_per_corner(values), F.col("k") + step)
    h = of(at, 1) - of(at)
    pieces = placed.withColumn("k", k).withColumn("h", h).withColumn("t", (F.col("x") - of(at)) / F.col("h"))
    t, h = F.col("t"), F.col("h")
    fitted = (1 + 2 * t) * (1 - t) * (1 - t) * of(value) + t * (1 - t) * (1 - t) * h * of(slope) + t * t * (3 - 2 * t) * of(value, 1) + t * t * (t - 1) * h * of(slope, 1)
    return pieces.select("feature_idx", fitted.alias("fitted"))


def highly_variable_genes(counts: DataFrame, genes: DataFrame, n_cells: int, n_top: int | None = None, span: float = 0.3, key_added: str = "highly_variable") -> DataFrame:
    """The genes with means, variances, variances_norm and whether they are highly variable.

    counts: (feature_idx, cell_idx, value), read once; genes: one row per feature_idx. The trend of log variance over log mean
    is fitted to genes with positive mean and variance; other genes have a deviation of 1 and are never selected.
    """
    if n_top is not None and n_top <= 0:
        raise ValueError(f"n_top is {n_top}; at least 1 is needed")
    found = staged(value_histogram(counts))
    moments = genes.select("feature_idx").join(mean_variance(found, n_cells), "feature_idx", "left").select("feature_idx", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("variance", F.lit(0.0)).alias("variance"))
    points = moments.where("mean > 0 and variance > 0").select("feature_idx", F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    deviation = F.sqrt(F.pow(F.lit(10.0), "fitted"))
    sd = trend(points, span).select("feature_idx", F.when(deviation > 0, deviation).otherwise(1.0).alias("sd"))
    with_sd = staged(moments.join(sd, "feature_idx", "left").withColumn("good", F.col("sd").isNotNull()).withColumn("sd", F.coalesce("sd", F.lit(1.0))))
    normed = with_sd.join(standardized_variance(found, with_sd, n_cells), "feature_idx")
    ranked = normed.withColumn("_score", F.when(F.col("good"), F.col("variance_standardized")))
    marked = mark_top(ranked, "_score", "feature_idx", n_top, key_added)
    return genes.join(marked.select("feature_idx", F.col("mean").alias("means"), F.col("variance").alias("variances"), F.col("variance_standardized").alias("variances_norm"), key_added), "feature_idx")
