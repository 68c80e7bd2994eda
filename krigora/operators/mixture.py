"""Mixtures over stations: per-station moments and Gaussian mixtures, global weights by EM, distances of densities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from krigora.functions.kernels import normal_density
from krigora.sources.store import discard, written


def station_moments(samples: DataFrame, station: str, value: str) -> DataFrame:
    return samples.where(F.col(value).isNotNull()).groupBy(F.col(station).alias("station")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def first_components(moments: DataFrame, k: int) -> DataFrame:
    """(station, k, mean, variance): k components spread from one deviation below a station's mean to one above."""
    offset = [0.0] if k == 1 else [-1 + 2 * j / (k - 1) for j in range(k)]
    each = moments.withColumn("k", F.explode(F.array(*[F.lit(j) for j in range(k)])))
    at = F.element_at(F.array(*[F.lit(o) for o in offset]), F.col("k") + 1)
    return each.select("station", "k", (F.col("mean") + at * F.sqrt("variance")).alias("mean"), "variance")


def em_weights(samples: DataFrame, components: DataFrame, weights: Sequence[float], floor: float = 1e-9) -> list[float]:
    """One EM step for weights shared by all stations: samples (station, value) against their station's components.

    The join is on the station, whose component rows are few; the responsibilities are summed by Spark.
    """
    k = len(weights)
    wide = components.groupBy("station").agg(*[f(F.when(F.col("k") == j, F.col(c))).alias(f"{c}{j}") for j in range(k) for c, f in (("mean", F.max), ("variance", F.max))])
    dens = [F.lit(float(w)) * normal_density(F.col("value"), F.col(f"mean{j}"), F.col(f"variance{j}")) for j, w in enumerate(weights)]
    total = sum(dens[1:], dens[0]) + F.lit(1e-300)
    got = samples.join(wide, "station").agg(*[F.avg(d / total).alias(f"w{j}") for j, d in enumerate(dens)]).first()
    new = np.maximum([got[f"w{j}"] or 0.0 for j in range(k)], floor)
    return (new / new.sum()).tolist()


def fit_weights(samples: DataFrame, components: DataFrame, k: int, rounds: int = 20, tol: float = 1e-5) -> list[float]:
    w = [1 / k] * k
    for _ in range(rounds):
        new = em_weights(samples, components, w)
        if sum(abs(a - b) for a, b in zip(w, new, strict=True)) < tol:
            return new
        w = new
    return w


def station_mixtures(samples: DataFrame, station: str, value: str, weights: Sequence[float], rounds: int = 100, tol: float = 1e-4) -> DataFrame:
    """(station, k, weight, mean, variance): a mixture with fixed weights per station by EM, components by their mean.

    All stations go through a round together: samples meet their station's few components and Spark sums responsibilities and
    moments by station, so no task holds a station's values. Starts one deviation around each station's mean; ends when no mean
    moves by ``tol`` or after ``rounds``.
    """
    n = len(weights)
    rows = samples.where(F.col(value).isNotNull()).select(F.col(station).alias("station"), F.col(value).cast("double").alias("value"))
    first = first_components(station_moments(rows, "station", "value"), n).withColumn("variance", F.greatest("variance", F.lit(1e-9)))
    state = written(first.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("k", "mean", "variance"))).alias("c")), "station-mixtures")
    for _ in range(rounds):
        joined = rows.join(state.withColumnRenamed("station", "owner"), F.col("station") == F.col("owner"))
        mean, var = ([F.get(F.col(f"c.{name}"), j) for j in range(n)] for name in ("mean", "variance"))
        logs = [F.lit(float(np.log(w))) - 0.5 * (F.log(v) + (F.col("value") - m) * (F.col("value") - m) / v) for w, m, v in zip(weights, mean, var, strict=True)]
        parts = joined.select("station", "value", *[x.alias(f"l{j}") for j, x in enumerate(logs)])
        top = F.greatest(*[F.col(f"l{j}") for j in range(n)]) if n > 1 else F.col("l0")
        each = [F.exp(F.col(f"l{j}") - top) for j in range(n)]
        total, y = sum(each[1:], each[0]), F.col("value")
        sums = parts.groupBy("station").agg(*[f.alias(f"{name}{j}") for j, e in enumerate(each) for name, f in (("n", F.sum(e / total)), ("s", F.sum(e / total * y)), ("q", F.sum(e / total * y * y)))])
        new = []
        for j in range(n):
            size = F.col(f"n{j}") + 1e-12
            m = F.col(f"s{j}") / size
            spread = (F.col(f"q{j}") - 2 * m * F.col(f"s{j}") + m * m * F.col(f"n{j}")) / size
            new.append(F.struct(F.lit(j).alias("k"), m.alias("mean"), F.greatest(spread, F.lit(1e-9)).alias("variance")))
        older, state = state, written(sums.select("station", F.array(*new).alias("c")), "station-mixtures")
        both = state.join(older.select(F.col("station").alias("owner"), F.col("c").alias("old")), F.col("station") == F.col("owner"))
        moved = both.agg(F.max(F.array_max(F.zip_with("c", "old", lambda p, q: F.abs(p["mean"] - q["mean"]))))).first()[0]
        discard(older)
        if moved is None or moved < tol:
            break
    ranked = F.sort_array(F.transform("c", lambda c, j: F.struct(c["mean"], F.get(F.array(*[F.lit(float(w)) for w in weights]), c["k"]).alias("weight"), c["variance"])))
    return state.select("station", F.posexplode(ranked).alias("k", "c")).select("station", "k", "c.weight", "c.mean", "c.variance")


def mixture_moments(components: DataFrame, key: str = "station") -> DataFrame:
    """Mean and variance of the mixture of (key, weight, mean, variance) rows, by the law of total variance."""
    m = F.sum(F.col("weight") * F.col("mean"))
    return components.groupBy(key).agg(m.alias("mean"), (F.sum(F.col("weight") * (F.col("variance") + F.col("mean") * F.col("mean"))) - m * m).alias("variance"))


def density_distances(p: DataFrame, q: DataFrame, width: float, key: str = "station") -> DataFrame:
    """Per station, between its density in ``p`` and the common one in ``q`` (bin, density): KL, Bhattacharyya, Wasserstein-1.

    ``q`` has one row per bin, a number given by the grid, so it is broadcast.
    """
    both = p.join(F.broadcast(q.select("bin", F.col("density").alias("other"))), "bin")
    gap = F.sum((F.col("density") - F.col("other")) * width).over(W.partitionBy(key).orderBy("bin"))
    return both.withColumn("gap", gap).groupBy(key).agg(
        F.sum(F.col("density") * (F.log("density") - F.log("other")) * width).alias("kl"), (-F.log(F.sum(F.sqrt(F.col("density") * F.col("other")) * width))).alias("bhattacharyya"), F.sum(F.abs("gap") * width).alias("wasserstein")
    )


def gaussian_w2_squared(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Squared 2-Wasserstein distance of two normal distributions."""
    d, s = m1 - m2, F.sqrt(v1) - F.sqrt(v2)
    return d * d + s * s
