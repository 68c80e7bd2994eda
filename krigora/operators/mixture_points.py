"""Mixtures of points in several dimensions: a diagonal mixture per station, alignment of their components, common weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krigora.functions.kernels import normal_density
from krigora.sources.store import discard, written

#: Most stations whose tree and components come together in one place.
MOST_STATIONS = 5_000


def station_mixtures(samples: DataFrame, k: int, rounds: int = 300, tol: float = 1e-4, floor: float = 1e-6) -> DataFrame:
    """(station, k, weight, mean, variance): a diagonal mixture for every station of ``samples`` (station, x), by EM.

    All stations go through a round together: points meet their station's few components and Spark sums responsibilities and
    moments by station, so no task holds a station's points. Starts between one deviation below and above each station's mean,
    the spread running along all coordinates; ends when no mean moves by ``tol``. Components are numbered by their means.
    Points that are null or hold a null or NaN are left out; an empty table gives no rows.
    """
    good = samples.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).select("station", "x")
    dims = good.agg(F.max(F.size("x"))).first()[0] or 1
    axis = [F.get("x", t) for t in range(dims)]
    first = good.groupBy("station").agg(F.array(*[F.avg(x) for x in axis]).alias("m"), F.array(*[F.var_pop(x) + floor for x in axis]).alias("v"))
    offset = [0.0] if k == 1 else [-1 + 2 * j / (k - 1) for j in range(k)]
    moved_by = lambda o: F.zip_with("m", "v", lambda m, v: m + o * F.sqrt(v))
    start = F.array(*[F.struct(F.lit(1 / k).alias("weight"), moved_by(o).alias("mean"), F.col("v").alias("variance")) for o in offset])
    state = written(first.select("station", start.alias("c")), "point-mixtures")
    for _ in range(rounds):
        joined = good.join(state.withColumnRenamed("station", "owner"), F.col("station") == F.col("owner"))
        parts = joined.select("station", "x", *[_log_term(F.get("c", j), F.col("x"), dims).alias(f"l{j}") for j in range(k)])
        top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
        each = [F.exp(F.col(f"l{j}") - top) for j in range(k)]
        total = sum(each[1:], each[0])
        sums = parts.groupBy("station").agg(F.count("*").alias("all"), *[f.alias(name) for j, e in enumerate(each) for name, f in [(f"n{j}", F.sum(e / total))] + [(f"{n}{j}_{t}", g) for t, x in enumerate(axis) for n, g in (("s", F.sum(e / total * x)), ("q", F.sum(e / total * x * x)))]])
        new = []
        for j in range(k):
            size = F.col(f"n{j}") + 1e-12
            mean = [F.col(f"s{j}_{t}") / size for t in range(dims)]
            spread = [F.greatest(F.col(f"q{j}_{t}") / size - m * m, F.lit(0.0)) + floor for t, m in enumerate(mean)]
            new.append(F.struct(F.greatest(F.col(f"n{j}") / F.col("all"), F.lit(1e-9)).alias("weight"), F.array(*mean).alias("mean"), F.array(*spread).alias("variance")))
        older, state = state, written(sums.select("station", F.array(*new).alias("c")), "point-mixtures")
        both = state.join(older.select(F.col("station").alias("owner"), F.col("c").alias("old")), F.col("station") == F.col("owner"))
        moved = both.agg(F.max(F.array_max(F.zip_with("c", "old", lambda p, q: F.array_max(F.zip_with(p["mean"], q["mean"], lambda u, v: F.abs(u - v))))))).first()[0]
        discard(older)
        if moved is None or moved < tol:
            break
    ranked = F.sort_array(F.transform("c", lambda c: F.struct(c["mean"], c["weight"], c["variance"])))
    return state.select("station", F.posexplode(ranked).alias("k", "c")).select("station", "k", "c.weight", "c.mean", "c.variance")


def wasserstein_cost(m1: np.ndarray, v1: np.ndarray, m2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """Squared 2-Wasserstein distance of every component of one mixture to every one of another."""
    return ((m1[:, None] - m2[None]) ** 2).sum(2) + ((np.sqrt(v1)[:, None] - np.sqrt(v2)[None]) ** 2).sum(2)


def best_order(cost: np.ndarray) -> list[int]:
    """Column for each row with the least total cost (an assignment by shortest augmenting paths, cubic in the rows)."""
    n = len(cost)
    rows, columns, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        owner[n], at = r, n  # column n is where the path of row r begins
        least, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            slack = cost[i] - rows[i] - columns[:n]
            closer = ~done[:n] & (slack < least)
            least[closer], back[closer] = slack[closer], at
            nxt = int(np.where(done[:n], np.inf, least).argmin())
            step = least[nxt]
            rows[owner[done]] += step
            columns[done] -= step
            least[~done[:n]] -= step
            at = nxt
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    order = np.empty(n, int)
    order[owner[:n]] = np.arange(n)
    return order.tolist()


def aligned_to(components: DataFrame, reference) -> DataFrame:
    """Components numbered like the nearest ones of the station ``reference``, whose few rows every task gets."""
    ref = components.where(F.col("station") == F.lit(reference)).orderBy("k").toPandas()
    if ref.empty:
        raise ValueError(f"no station {reference}")
    means, variances = np.stack(ref["mean"]), np.stack(ref["variance"])

    def renumber(pdf: pd.DataFrame) -> pd.DataFrame:
        order = best_order(wasserstein_cost(means, variances, np.stack(pdf["mean"]), np.stack(pdf["variance"])))
        return pdf.iloc[order].assign(k=range(len(pdf)))

    return components.groupBy("station").applyInPandas(renumber, components.schema)


def station_tree(places: DataFrame) -> list[tuple]:
    """(parent, child) links of the shortest tree over the stations (station, x), outward from the one nearest the centre."""
    rows = places.orderBy("station").limit(MOST_STATIONS + 1).toPandas()
    if len(rows) > MOST_STATIONS:
        raise ValueError(f"more than {MOST_STATIONS} stations")
    if rows.empty:
        return []
    x, names = np.stack(rows["x"]).astype(float), rows["station"].tolist()
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    near, parent, out = ((x - x[root]) ** 2).sum(1), np.full(len(x), root), []
    near[root] = np.inf
    for _ in range(len(x) - 1):
        c = int(near.argmin())
        out.append((names[parent[c]], names[c]))
        d = ((x - x[c]) ** 2).sum(1)
        closer = (d < near) & np.isfinite(near)
        parent[closer], near[closer] = c, d[closer]
        near[c] = np.inf
    return out


def aligned_along(components: DataFrame, tree: list[tuple]) -> DataFrame:
    """Components numbered like those of the station's parent in ``tree``, outward from the root.

    The components of at most ``MOST_STATIONS`` stations come to the driver, as each step needs the one before.
    """
    if components.select("station").distinct().count() > MOST_STATIONS:
        raise ValueError(f"more than {MOST_STATIONS} stations")
    rows = {s: g.sort_values("k") for s, g in components.toPandas().groupby("station")}
    for a, b in tree:
        if a in rows and b in rows:
            order = best_order(wasserstein_cost(np.stack(rows[a]["mean"]), np.stack(rows[a]["variance"]), np.stack(rows[b]["mean"]), np.stack(rows[b]["variance"])))
            rows[b] = rows[b].iloc[order].assign(k=range(len(order)))
    found = [(s, int(k), float(w), [*map(float, m)], [*map(float, v)]) for s, g in rows.items() for k, w, m, v in zip(g["k"], g["weight"], g["mean"], g["variance"], strict=True)]
    return components.sparkSession.createDataFrame(found, components.schema)


def aligned_in_order(components: DataFrame, stations: Sequence) -> DataFrame:
    """Components numbered like those of the station before, along the given order of stations."""
    return aligned_along(components, list(zip(stations[:-1], stations[1:], strict=True)))


def em_weights(samples: DataFrame, components: DataFrame, weights: Sequence[float], dims: int, floor: float = 1e-9) -> list[float]:
    """One EM step for weights shared by all stations: points (station, x) against their station's components."""
    k = len(weights)
    wide = components.groupBy("station").agg(*[F.max(F.when(F.col("k") == j, F.struct("mean", "variance"))).alias(f"c{j}") for j in range(k)])

    def density(j: int):
        out = F.lit(float(weights[j]))
        for t in range(dims):
            out = out * normal_density(F.get(F.col("x"), t), F.get(F.col(f"c{j}.mean"), t), F.get(F.col(f"c{j}.variance"), t))
        return out

    dens = [density(j) for j in range(k)]
    total = sum(dens[1:], dens[0]) + F.lit(1e-300)
    got = samples.join(wide, "station").agg(*[F.avg(d / total).alias(f"w{j}") for j, d in enumerate(dens)]).first()
    new = np.maximum([got[f"w{j}"] or 0.0 for j in range(k)], floor)
    return (new / new.sum()).tolist()


def log_likelihood(samples: DataFrame, components: DataFrame, dims: int) -> DataFrame:
    """(station, n, log_likelihood) of points (station, x) under their station's mixture (station, k, weight, mean, variance)."""
    rows = samples.where(F.col("x").isNotNull())
    each = rows.join(components.groupBy(F.col("station").alias("owner")).agg(F.collect_list(F.struct("weight", "mean", "variance")).alias("c")), F.col("station") == F.col("owner"))
    logs = each.select("station", F.transform("c", lambda c: _log_term(c, F.col("x"), dims)).alias("logs"))
    top = F.array_max("logs")
    total = top + F.log(F.aggregate("logs", F.lit(0.0), lambda s, l: s + F.exp(l - top)))
    return logs.groupBy("station").agg(F.count("*").alias("n"), F.sum(total).alias("log_likelihood"))


def _log_term(c, x, dims: int):
    out = F.log(c["weight"])
    for t in range(dims):
        v, gap = F.greatest(F.get(c["variance"], t), F.lit(1e-12)), F.get(x, t) - F.get(c["mean"], t)
        out = out - 0.5 * (F.log(2 * np.pi * v) + gap * gap / v)
    return out


def sampled(components: DataFrame, n: int, dims: int, seed: int = 0) -> DataFrame:
    """(station, draw, x): ``n`` points of each station's mixture, by random numbers in Spark; a lost task draws the same again."""
    each = components.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("k", "weight", "mean", "variance"))).alias("c"))
    unit = lambda salt: (F.pmod(F.xxhash64("station", "draw", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draws = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", unit(0))
    upto = lambda j: F.aggregate(F.slice("c", F.lit(1), j + 1), F.lit(0.0), lambda s, c: s + c["weight"])
    picked = F.element_at(F.filter("c", lambda c, j: (F.col("u") <= upto(j)) | (j == F.size("c") - 1)), 1)
    normal = lambda t: F.sqrt(-2 * F.log(unit(2 * t + 1))) * F.cos(2 * np.pi * unit(2 * t + 2))
    drawn = draws.withColumn("p", picked)
    return drawn.select("station", "draw", F.array(*[F.get("p.mean", t) + F.sqrt(F.get("p.variance", t)) * normal(t) for t in range(dims)]).alias("x"))
