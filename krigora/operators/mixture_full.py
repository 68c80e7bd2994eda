"""Mixtures of points with full covariances: EM over tables, matrix-root distances, alignment, densities, sampling.

A covariance is an array of its rows one after the other. What hangs on points (responsibilities, sums of outer products) is Spark's;
the few components of a station get their inverse and determinant by NumPy in tasks between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krigora.sources.store import discard, written

from .mixture_points import best_order

_COMPONENTS = "k int, weight double, mean array<double>, covariance array<double>"


def full(variance: np.ndarray) -> np.ndarray:
    """Covariances as (components, d, d) from variances (components, d), one number each (components,) or full ones as they are."""
    v = np.asarray(variance, float)
    if v.ndim == 3:
        return v
    return np.stack([np.diag(np.atleast_1d(r)) for r in v])


def positive(s: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The symmetric part with eigenvalues of at least ``floor``."""
    w, u = np.linalg.eigh((s + s.T) / 2)
    return (u * np.maximum(w, floor)) @ u.T


def root(s: np.ndarray) -> np.ndarray:
    """The symmetric square root of a covariance; tiny negative eigenvalues count as zero."""
    w, u = np.linalg.eigh((s + s.T) / 2)
    return (u * np.sqrt(np.maximum(w, 0.0))) @ u.T


def w2_squared(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> float:
    """Squared 2-Wasserstein distance of two normal distributions: |m1 - m2|^2 + tr(s1 + s2 - 2 (s2^1/2 s1 s2^1/2)^1/2)."""
    r = root(s2)
    cross = np.linalg.eigvalsh(r @ s1 @ r)
    return float(max(0.0, ((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(cross, 0)).sum()))


def cost(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Squared distances of every component of one mixture to every one of another."""
    return np.array([[w2_squared(a, s, b, t) for b, t in zip(m2, s2, strict=True)] for a, s in zip(m1, s1, strict=True)])


def moments(samples: DataFrame, dims: int) -> DataFrame:
    """(station, n, mean, covariance) of points (station, x)."""
    x = [F.get("x", t) for t in range(dims)]
    square = [F.covar_pop(x[min(t, u)], x[max(t, u)]) for t in range(dims) for u in range(dims)]
    return usable(samples, dims).groupBy("station").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*square).alias("covariance"))


def usable(samples: DataFrame, dims: int) -> DataFrame:
    return samples.where(F.col("x").isNotNull() & (F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).select("station", "x")


def first_components(stations: DataFrame, k: int, dims: int, floor: float = 1e-6) -> DataFrame:
    """(station, k, weight, mean, covariance): components along the deviations from one below to one above, with the station's
    covariance and ``floor`` more on its diagonal."""
    offset = [0.0] if k == 1 else [-1 + 2 * j / (k - 1) for j in range(k)]
    spread = F.transform("covariance", lambda v, i: v + F.when(i % (dims + 1) == 0, floor).otherwise(0.0))
    deviation = F.array(*[F.sqrt(F.get("s", t * (dims + 1))) for t in range(dims)])
    each = stations.withColumn("s", spread).withColumn("k", F.explode(F.array(*[F.lit(j) for j in range(k)])))
    at = F.get(F.array(*[F.lit(o) for o in offset]), F.col("k"))
    return each.select("station", "k", F.lit(1 / k).alias("weight"), F.zip_with("mean", deviation, lambda m, d: m + at * d).alias("mean"), F.col("s").alias("covariance"))


def ready(components: DataFrame, dims: int) -> DataFrame:
    """(station, c): a station's components in order, each with its precision and the log of its weight over its normaliser."""
    typed = components.schema["station"].simpleString().split(":", 1)[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = [positive(np.reshape(c, (dims, dims))) for c in p["covariance"]]
            level = [np.log(max(w, 1e-300)) - 0.5 * (np.linalg.slogdet(c)[1] + dims * np.log(2 * np.pi)) for w, c in zip(p["weight"], s, strict=True)]
            yield p.assign(precision=[np.linalg.inv(c).ravel() for c in s], level=level)

    got = components.select("station", "k", "weight", "mean", "covariance").mapInPandas(run, f"station {typed}, {_COMPONENTS}, precision array<double>, level double")
    return got.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("k", "weight", "mean", "precision", "level"))).alias("c"))


def log_term(c: Column, x: Column, dims: int) -> Column:
    """Log of a component's weight times its density at ``x``."""
    gap = [F.get(x, t) - F.get(c["mean"], t) for t in range(dims)]
    square = F.lit(0.0)
    for t in range(dims):
        for u in range(t, dims):
            square = square + (1.0 if t == u else 2.0) * F.get(c["precision"], t * dims + u) * gap[t] * gap[u]
    return c["level"] - 0.5 * square


def responsibilities(samples: DataFrame, components: DataFrame, k: int, dims: int) -> DataFrame:
    """(station, x, r0.., log_density): shares of a station's components in each of its points."""
    state = ready(components, dims).withColumnRenamed("station", "owner")
    joined = usable(samples, dims).join(state, F.col("station") == F.col("owner"))
    logs = joined.select("station", "x", *[log_term(F.get("c", j), F.col("x"), dims).alias(f"l{j}") for j in range(k)])
    top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
    each = [F.exp(F.col(f"l{j}") - top) for j in range(k)]
    total = sum(each[1:], each[0])
    return logs.select("station", "x", *[(e / total).alias(f"r{j}") for j, e in enumerate(each)], (top + F.log(total)).alias("log_density"))


def em_step(samples: DataFrame, components: DataFrame, k: int, dims: int, floor: float = 1e-6) -> DataFrame:
    """Components after one round: weights, means and covariances from partial sums of shares, points and outer products."""
    shares = responsibilities(samples, components, k, dims)
    x, sums = [F.get("x", t) for t in range(dims)], [F.count("*").alias("all")]
    for j in range(k):
        r = F.col(f"r{j}")
        sums += [F.sum(r).alias(f"n{j}"), *[F.sum(r * x[t]).alias(f"s{j}_{t}") for t in range(dims)], *[F.sum(r * x[t] * x[u]).alias(f"q{j}_{t}_{u}") for t in range(dims) for u in range(t, dims)]]
    new = []
    for j in range(k):
        size = F.col(f"n{j}") + 1e-12
        mean = [F.col(f"s{j}_{t}") / size for t in range(dims)]
        spread = [F.col(f"q{j}_{min(t, u)}_{max(t, u)}") / size - mean[t] * mean[u] + (floor if t == u else 0.0) for t in range(dims) for u in range(dims)]
        new.append(F.struct(F.lit(j).alias("k"), F.greatest(F.col(f"n{j}") / F.col("all"), F.lit(1e-9)).alias("weight"), F.array(*mean).alias("mean"), F.array(*spread).alias("covariance")))
    return shares.groupBy("station").agg(*sums).select("station", F.explode(F.array(*new)).alias("c")).select("station", "c.*")


def station_mixtures(samples: DataFrame, k: int, dims: int, rounds: int = 300, tol: float = 1e-4, floor: float = 1e-6) -> DataFrame:
    """(station, k, weight, mean, covariance): a mixture with full covariances for every station of ``samples`` (station, x), by EM.

    All stations go through a round together, so no task holds a station's points. Ends when no mean moves by ``tol``. Points
    that are null, of another length or hold nulls or NaN are left out; an empty table gives no rows.
    """
    rows = written(usable(samples, dims), "mixture-points")  # read in every round
    state = written(first_components(moments(rows, dims), k, dims, floor), "full-mixtures")
    for _ in range(rounds):
        older, state = state, written(em_step(rows, state, k, dims, floor), "full-mixtures")
        old = older.select(F.col("station").alias("owner"), F.col("k").alias("place"), F.col("mean").alias("old"))
        both = state.join(old, (F.col("station") == F.col("owner")) & (F.col("k") == F.col("place")))
        moved = both.agg(F.max(F.array_max(F.zip_with("mean", "old", lambda a, b: F.abs(a - b))))).first()[0]
        discard(older)
        if moved is None or moved < tol:
            break
    ranked = state.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("mean", "weight", "covariance"))).alias("c"))
    return ranked.select("station", F.posexplode("c").alias("k", "c")).select("station", "k", "c.weight", "c.mean", "c.covariance")


def log_likelihood(samples: DataFrame, components: DataFrame, k: int, dims: int) -> DataFrame:
    """(station, n, log_likelihood) of points under their station's mixture."""
    return responsibilities(samples, components, k, dims).groupBy("station").agg(F.count("*").alias("n"), F.sum("log_density").alias("log_likelihood"))


def pair_distances(pairs: DataFrame, dims: int) -> DataFrame:
    """``pairs`` (mean_a, covariance_a, mean_b, covariance_b, ...) with ``w2``, the 2-Wasserstein distance of the two, by matrix roots."""
    names = [f.name for f in pairs.schema]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            square = lambda c: np.reshape(c, (dims, dims)).astype(float)
            yield p[names].assign(w2=[w2_squared(np.asarray(a, float), square(s), np.asarray(b, float), square(t)) ** 0.5 for a, s, b, t in zip(p["mean_a"], p["covariance_a"], p["mean_b"], p["covariance_b"], strict=True)])

    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, w2 double")


def aligned_to(components: DataFrame, reference, dims: int) -> DataFrame:
    """Components numbered like the nearest ones, by matrix-root distance, of the station ``reference``, whose few rows every task gets."""
    ref = components.where(F.col("station") == F.lit(reference)).orderBy("k").toPandas()
    if ref.empty:
        raise ValueError(f"no station {reference}")
    shape = lambda pdf: (np.stack(pdf["mean"]).astype(float), np.stack(pdf["covariance"]).astype(float).reshape(len(pdf), dims, dims))
    means, spreads = shape(ref)

    def renumber(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pdf.iloc[best_order(cost(means, spreads, *shape(pdf)))].assign(k=range(len(pdf)))

    return components.groupBy("station").applyInPandas(renumber, components.schema)


def aligned_by_level(components: DataFrame, tree: DataFrame, dims: int) -> DataFrame:
    """Components numbered like those of the station's parent, level by level of ``tree`` (station, parent, level; the root at 0).

    A level is one job: its stations meet their parents' numbered components by a join, so any number of stations goes through.
    """
    typed = components.schema["station"].simpleString().split(":", 1)[1]
    schema = f"station {typed}, {_COMPONENTS}"
    shape = lambda pdf: (np.stack(pdf["mean"]).astype(float), np.stack(pdf["covariance"]).astype(float).reshape(len(pdf), dims, dims))

    def renumber(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k")
        if len(above) and len(own):
            own = own.iloc[best_order(cost(*shape(above.sort_values("k")), *shape(own)))].assign(k=range(len(own)))
        return own[["station", "k", "weight", "mean", "covariance"]]

    rows = components.select("station", "k", "weight", "mean", "covariance")
    deepest = tree.agg(F.max("level")).first()[0]
    place = tree.select(F.col("station").alias("of"), "parent", "level")
    out = done = written(rows.join(place.where("level = 0"), F.col("station") == F.col("of")).select(rows.columns), "aligned")
    for level in range(1, (deepest or 0) + 1):
        here = place.where(F.col("level") == level)
        own = rows.join(here, F.col("station") == F.col("of")).select(rows.columns)
        above = done.join(here, F.col("station") == F.col("parent")).select(F.col("of").alias("station"), "k", "weight", "mean", "covariance")
        done = written(own.groupBy("station").cogroup(above.groupBy("station")).applyInPandas(renumber, schema), "aligned")
        out = out.unionByName(done)
    return out


def sampled(components: DataFrame, n: int, dims: int, seed: int = 0) -> DataFrame:
    """(station, draw, x): ``n`` points of each station's mixture; a lost task draws the same again."""
    typed = components.schema["station"].simpleString().split(":", 1)[1]
    each = components.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("k", "weight", "mean", "covariance"))).alias("c")).withColumn("key", F.xxhash64("station"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for station, c, key in zip(p["station"], p["c"], p["key"], strict=True):
                rng = np.random.default_rng([seed, key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF])
                w = np.array([r["weight"] for r in c])
                pick = rng.choice(len(c), n, p=w / w.sum())
                roots = [root(np.reshape(r["covariance"], (dims, dims))) for r in c]
                x = np.stack([np.asarray(c[k]["mean"]) + roots[k] @ rng.normal(size=dims) for k in pick]) if n else np.zeros((0, dims))
                yield pd.DataFrame({"station": [station] * n, "draw": range(n), "x": x.tolist()})

    return each.mapInPandas(run, f"station {typed}, draw int, x array<double>")
