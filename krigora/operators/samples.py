"""Distances between two samples: from ranks where the line allows it, from the covariance joins elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from krigora.functions.kernels import distance
from krigora.operators import covariance as C
from krigora.sources.points import coordinates
from krigora.sources.store import written

#: Most (line, range) rows that are broadcast; with more the joins shuffle.
BROADCAST_RANGES = 100_000
#: Points that a task projects on all lines.
TASK_POINTS = 50_000


def _small(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_RANGES else side


def running_gaps(a: DataFrame, b: DataFrame, lines: int = 1) -> DataFrame:
    """line, gap, width for samples (line, at): the difference of the two distribution functions right of each distinct value,
    and the distance to the next value of the line.

    Each of the ``lines`` lines is cut at approximate quantiles; sums over whole ranges come first, so that no task sorts a
    line. Null and NaN values are left out.
    """
    ones = [d.select("line", "at", F.lit(k).alias("a"), F.lit(1 - k).alias("b")) for d, k in ((a, 1), (b, 0))]
    return _gaps(ones[0].unionByName(ones[1]), lines)


def _gaps(rows: DataFrame, lines: int) -> DataFrame:
    """``running_gaps`` of values with how often each sample has them: (line, at, a, b)."""
    spark = rows.sparkSession
    parts = min(1000, max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = rows.where("at IS NOT NULL AND NOT isnan(at)")
    cuts = both.groupBy("line").agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 10 * parts).alias("cuts"))
    steps = both.groupBy("line", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = steps.join(_small(cuts, lines), "line").withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("at")))).drop("cuts")
    sums = placed.groupBy("line", "part").agg(F.sum("a").alias("part_a"), F.sum("b").alias("part_b"), F.min("at").alias("first"))
    along, whole = W.partitionBy("line").orderBy("part"), W.partitionBy("line")
    before = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(
        "line", "part", before("part_a").alias("a0"), before("part_b").alias("b0"), F.lead("first").over(along).alias("next_first"),
        F.sum("part_a").over(whole).alias("all_a"), F.sum("part_b").over(whole).alias("all_b"),
    )
    inside = W.partitionBy("line", "part").orderBy("at")
    upto = lambda c: (F.col(f"{c}0") + F.sum(c).over(inside)) / F.col(f"all_{c}")
    width = F.coalesce(F.lead("at").over(inside), F.col("next_first")) - F.col("at")
    return placed.join(_small(starts, lines * parts), ["line", "part"]).select("line", (upto("a") - upto("b")).alias("gap"), width.alias("width"))


def energy_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """2 E|A-B| - E|A-A'| - E|B-B'| of two samples on the line: twice the integral of the squared gap, so no pairs are formed."""
    gaps = running_gaps(*(d.select(F.lit(0).alias("line"), F.col(value).cast("double").alias("at")) for d in (a, b)))
    return gaps.agg(F.coalesce(F.sum(2.0 * F.col("gap") * F.col("gap") * F.col("width")), F.lit(0.0)).alias("energy_distance"))


def directions(n: int, dims: int, seed: int = 42) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=(n, dims))
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)


def sliced_wasserstein(a: DataFrame, b: DataFrame, along: Sequence[Sequence[float]]) -> DataFrame:
    """Mean over the directions ``along`` of the 1-Wasserstein distance of the projected samples (x)."""
    dims = len(along[0])

    # Equal points are counted first; what is left is dealt to tasks of bounded size before every point becomes a row per line.
    both = a.select("x", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("x", F.lit(0).alias("a"), F.lit(1).alias("b")))
    places = written(both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "sample-places")
    tasks = max(1, -(-places.count() // TASK_POINTS))
    x = coordinates("x", dims)
    dots = F.array(*[sum((x[k] * float(u[k]) for k in range(1, dims)), x[0] * float(u[0])) for u in along])
    rows = places.repartition(tasks).select("a", "b", F.posexplode(dots).alias("line", "at"))
    by_line = _gaps(rows, len(along)).groupBy("line").agg(F.coalesce(F.sum(F.abs("gap") * F.col("width")), F.lit(0.0)).alias("w1"))
    return by_line.agg(F.avg("w1").alias("sliced_wasserstein"))


def _pair_sums(a: DataFrame, b: DataFrame, value: Callable[[Column], Column], dims: int) -> tuple[tuple[int, int], tuple[float, float, float]]:
    """Sizes of both samples and the sums of ``value``(distance) over the pairs a < a', b < b' and all (a, b)."""
    one = [1.0] * dims
    kernel = lambda x, y: value(distance(x, y, one))
    sums = [C.weighted_sum(*d, kernel, dims).first()[0] for d in ((a, None), (b, None), (a, b))]
    return (a.count(), b.count()), tuple(sums)


def energy_distance_points(a: DataFrame, b: DataFrame, dims: int) -> float:
    """2 E|A-B| - E|A-A'| - E|B-B'| for points (pt_id, x) in ``dims`` dimensions."""
    (n, m), (aa, bb, ab) = _pair_sums(a, b, lambda d: d, dims)
    return 2 * ab / (n * m) - 2 * aa / n**2 - 2 * bb / m**2


def median_gamma(a: DataFrame, b: DataFrame, dims: int) -> float:
    """Kernel width by the median rule over all points: half the inverse of the median squared distance (an approximate median)."""
    points = a.select("x").unionByName(b.select("x")).withColumn("pt_id", F.monotonically_increasing_id())
    half = C.half_covariance(points, lambda x, y: distance(x, y, [1.0] * dims), dims)
    median = half.agg(F.percentile_approx(F.col("v") * F.col("v"), 0.5, 10_000)).first()[0]
    return 1 / (2 * median) if median else 1.0


def mmd_rbf(a: DataFrame, b: DataFrame, dims: int, gamma: float | None = None) -> float:
    """Unbiased squared maximum mean discrepancy of points (pt_id, x) under exp(-gamma d^2); each sample needs two points."""
    gamma = median_gamma(a, b, dims) if gamma is None else gamma
    (n, m), (aa, bb, ab) = _pair_sums(a, b, lambda d: F.exp(-gamma * d * d), dims)
    if min(n, m) < 2:
        raise ValueError("each sample needs two points")
    return 2 * aa / (n * (n - 1)) + 2 * bb / (m * (m - 1)) - 2 * ab / (n * m)
