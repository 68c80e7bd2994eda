"""Gaussian-process regression over point tables.

Places of a model on the driver are bounded (``most_dense``) and factorised where they are collected; prediction is a
Spark job of any size that carries the inverse triangle to the rows. ``exact_model`` takes tiles beyond that bound; compactly
supported kernels have strips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.sources.places import Places
from krigora.sources.store import in_batches

from . import linalg as L


def block(a: np.ndarray, b: np.ndarray, hyper: Sequence[float], kernel: Callable = K.default_kernel) -> np.ndarray:
    """Dense covariance of two arrays of points."""
    return kernel([a[:, k][:, None] for k in range(a.shape[1])], [b[:, k][None, :] for k in range(b.shape[1])], hyper, K.NUMPY)


class GaussianProcess:
    """An exact GP: ``points`` (pt_id, x, y[, noise_var]), hyper = [variance, length per dimension], constant prior mean.

    Without a noise column every point has the variance (mean |y| / 100)^2; without hyperparameters they are the variance of y
    and the spread of each coordinate. ``mean(x)`` and ``noise(x)`` may be functions of an array of points,
    ``kernel_slopes(a, b, hyper)`` gives the kernel's derivatives by its hyperparameters. Points of equal coordinates are one place
    (``counts`` of them), and ``most_dense`` bounds the places; ``n`` is the number of points.
    """

    def __init__(self, points: DataFrame | Places, hyper: Sequence[float] | None = None, kernel: Callable = K.default_kernel, mean: float | Callable | None = None, most_dense: int = 8000, noise: Callable | None = None, kernel_slopes: Callable | None = None) -> None:
        places = Places(points.drop("noise_var"), 1.0) if noise is not None else Places.of(points)
        if places.count > most_dense:
            raise ValueError(f"{places.count} places; a model on the driver takes {most_dense}, more take tiles or strips")
        got = places.table.orderBy("pt_id").toPandas()
        if places is not points:
            places.discard()
        self.spark, self.kernel, self.n, self.noise_level = places.table.sparkSession, kernel, places.n, places.noise
        self.ids, self.y = got["pt_id"].to_numpy(), got["y"].to_numpy(float)
        self.x = np.array(got["x"].tolist(), float).reshape(len(got), -1)
        self.noise, self.counts, self.total = got["noise_var"].to_numpy(float), got["n"].to_numpy(float), float(got["total"].to_numpy(float).sum())
        spare, within = got["spare_logdet"].to_numpy(float), got["spare_square"].to_numpy(float)
        if noise is not None:
            level = np.broadcast_to(np.asarray(noise(self.x), float), self.y.shape)
            if (level <= 0).any():
                raise ValueError("noise variances must be positive")
            self.noise, spare, within = self.noise * level, spare + (self.counts - 1) * np.log(level), within / level
            self.noise_level = float(level @ self.counts / self.n) if self.n else 0.0
        self.spare = (float(spare.sum()), float(within.sum()))  # what the points add to log-determinant and quadratic form of the places
        self._mean, self.kernel_slopes = mean, kernel_slopes
        self.set_hyper(hyper if hyper is not None else [max(places.variance, 1e-12), *np.maximum(np.ptp(self.x, axis=0), 1e-12)])

    def set_hyper(self, hyper: Sequence[float]) -> None:
        self.hyper = np.array(hyper, float)
        self.mean = self.prior(self.x)
        self.factor = L.cholesky(block(self.x, self.x, self.hyper, self.kernel) + np.diag(self.noise))
        self.alpha = L.solve(self.factor, self.y - self.mean)
        self.logdet, self.quadratic = L.logdet(self.factor) + self.spare[0], float((self.y - self.mean) @ self.alpha) + self.spare[1]

    def prior(self, q: np.ndarray) -> np.ndarray | float:
        """Prior mean at an array of points: a number, or what the function of the model gives."""
        if callable(self._mean):
            return np.broadcast_to(np.asarray(self._mean(q), float), (len(q),))
        return self.total / self.n if self._mean is None else self._mean

    def append(self, x: np.ndarray, y: np.ndarray, noise: np.ndarray) -> None:
        """More points: the factor grows by their rows, and the default mean follows all targets."""
        cross, own = block(self.x, x, self.hyper, self.kernel), block(x, x, self.hyper, self.kernel)
        self.factor = L.extended(self.factor, cross, own + np.diag(noise))
        self.x, self.y, self.noise = np.concatenate([self.x, x]), np.concatenate([self.y, y]), np.concatenate([self.noise, noise])
        self.ids = np.concatenate([self.ids, self.ids.max(initial=-1) + 1 + np.arange(len(y))])
        self.noise_level = (self.noise_level * self.n + float(np.sum(noise))) / max(1, self.n + len(y))
        self.counts, self.total, self.n = np.concatenate([self.counts, np.ones(len(y))]), self.total + float(np.sum(y)), self.n + len(y)
        self.mean = self.prior(self.x)
        self.alpha = L.solve(self.factor, self.y - self.mean)

    def replace(self, x: np.ndarray, y: np.ndarray, noise: np.ndarray) -> None:
        """Other points with the same hyperparameters."""
        self.x, self.y, self.noise, self.ids = np.array(x, float), np.array(y, float), np.array(noise, float), np.arange(len(y))
        self.counts, self.total, self.n, self.spare, self.noise_level = np.ones(len(y)), float(self.y.sum()), len(y), (0.0, 0.0), float(self.noise.mean())
        self.set_hyper(self.hyper)

    # --- likelihood

    def log_likelihood(self, hyper: Sequence[float] | None = None) -> float:
        r = self.y - self.mean
        if hyper is None:
            low, alpha = self.factor, self.alpha
        else:
            low = L.cholesky(block(self.x, self.x, np.array(hyper, float), self.kernel) + np.diag(self.noise))
            alpha = L.solve(low, r)
        return float(-0.5 * (r @ alpha + L.logdet(low) + sum(self.spare) + self.n * np.log(2 * np.pi)))

    def likelihood_gradient(self, hyper: Sequence[float] | None = None) -> np.ndarray:
        """Of the log likelihood: half of a'dK a - tr(K^-1 dK) per hyperparameter.

        dK is ``kernel_slopes(x, x, hyper)`` where the model has it, closed for the default kernel, else central differences.
        """
        h = self.hyper if hyper is None else np.array(hyper, float)
        low = L.cholesky(block(self.x, self.x, h, self.kernel) + np.diag(self.noise))
        inverse = L.inverse(low)
        alpha = inverse @ (self.y - self.mean)
        out = np.zeros(len(h))
        slopes = self.kernel_slopes or (K.default_kernel_slopes if self.kernel is K.default_kernel else None)
        if slopes:
            return np.array([0.5 * (alpha @ d @ alpha - (inverse * d).sum()) for d in slopes(self.x, self.x, h)])
        for k in range(len(h)):
            e = np.zeros(len(h))
            e[k] = 1e-6 * max(1.0, abs(h[k]))
            d = (block(self.x, self.x, h + e, self.kernel) - block(self.x, self.x, h - e, self.kernel)) / (2 * e[k])
            out[k] = 0.5 * (alpha @ d @ alpha - (inverse * d).sum())
        return out

    def gradient_gap(self, step: float = 1e-6) -> float:
        """Largest difference between ``likelihood_gradient`` and central differences of the likelihood, relative to its size."""
        g, out = self.likelihood_gradient(), []
        for k in range(len(self.hyper)):
            e = np.zeros(len(self.hyper))
            e[k] = step * max(1.0, abs(self.hyper[k]))
            out.append((self.log_likelihood(self.hyper + e) - self.log_likelihood(self.hyper - e)) / (2 * e[k]))
        return float(np.abs(g - out).max() / max(np.abs(g).max(), 1e-12))

    def likelihood_hessian(self) -> np.ndarray:
        g, out = self.likelihood_gradient(), []
        for k in range(len(self.hyper)):
            e = np.zeros(len(self.hyper))
            e[k] = 1e-4 * max(1e-3, abs(self.hyper[k]))
            out.append((self.likelihood_gradient(self.hyper + e) - g) / e[k])
        h = np.array(out)
        return (h + h.T) / 2

    # --- prediction

    def predict(self, points: DataFrame, id_col: str = "pred_id", add_noise: bool = False) -> DataFrame:
        """(id, m, v) of every row of ``points`` (id, x): a Spark job over its partitions; negative variances are zero."""
        noise, hyper, kernel = (self.noise_level if add_noise else 0.0), self.hyper, self.kernel
        trend = self._mean if callable(self._mean) else None
        level = 0.0 if trend else float(self.mean)
        sent = self.spark.sparkContext.broadcast((self.x, self.alpha, L.lower_inverse(self.factor)))  # at most most_dense ** 2 numbers

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, alpha, inverse = sent.value
            for part in parts:
                for s in range(0, len(part), 2000):
                    p = part.iloc[s : s + 2000]
                    q = np.array(p["x"].tolist(), float).reshape(len(p), -1)
                    k = block(x, q, hyper, kernel)
                    own = kernel([q[:, d] for d in range(q.shape[1])], [q[:, d] for d in range(q.shape[1])], hyper, K.NUMPY)
                    yield pd.DataFrame({id_col: p[id_col].to_numpy(), "m": (trend(q) if trend else level) + k.T @ alpha, "v": np.maximum(0.0, own - ((inverse @ k) ** 2).sum(0)) + noise})

        return points.select(id_col, "x").mapInPandas(run, f"{id_col} long, m double, v double")

    def predict_slopes(self, points: DataFrame, id_col: str = "pred_id", variance: bool = False) -> DataFrame:
        """(id, direction, dm, dv) for the default kernel in closed form: each row's slopes of mean and variance; with ``variance``
        also v, the variance itself."""
        hyper, dims = self.hyper, self.x.shape[1]
        sent = self.spark.sparkContext.broadcast((self.x, self.alpha, L.inverse(self.factor)))  # at most most_dense ** 2 numbers

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, alpha, inverse = sent.value
            for part in parts:
                q = np.array(part["x"].tolist(), float).reshape(len(part), dims)
                k = block(x, q, hyper)
                weighted = inverse @ k
                own = {"v": np.maximum(0.0, hyper[0] - (k * weighted).sum(0))} if variance else {}
                for t, dk in enumerate(K.default_kernel_point_slopes(x, q, hyper)):
                    yield pd.DataFrame({id_col: part[id_col].to_numpy(), "direction": t, "dm": alpha @ dk, "dv": -2 * (weighted * dk).sum(0), **own})

        return points.select(id_col, "x").mapInPandas(run, f"{id_col} long, direction int, dm double, dv double" + ", v double" * variance)

    def predict_entropy_slopes(self, points: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, direction, slope): of the entropy of the targets and the function at each row, by itself, along its coordinates.

        The targets' part doesn't move, so it is half the slope of the logarithm of the row's variance; where the variance is zero it
        has none (null). For the default kernel.
        """
        v = F.col("v")
        return self.predict_slopes(points, id_col, variance=True).select(id_col, "direction", F.when(v > 0, 0.5 * F.col("dv") / v).alias("slope"))

    def predict_gradient(self, points: DataFrame, id_col: str = "pred_id", step: float = 1e-5) -> DataFrame:
        """(id, direction, dm, dv): central differences of mean and variance along every coordinate, for any kernel."""
        dims = self.x.shape[1]
        moved = points.select(id_col, F.explode(F.array(*[F.lit(k) for k in range(dims)])).alias("direction"), "x").withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
        shift = F.transform("x", lambda c, k: c + F.when(k == F.col("direction"), F.col("sign") * step).otherwise(0.0))
        coded = moved.select(((F.col(id_col) * dims + F.col("direction")) * 2 + (F.col("sign") + 1) / 2).cast("long").alias("pred_id"), shift.alias("x"))
        both = self.predict(coded)
        up = F.col("pred_id") % 2 == 1
        key = F.floor(F.col("pred_id") / 2)
        d = lambda c: (F.sum(F.when(up, F.col(c)).otherwise(-F.col(c))) / (2 * step)).alias("d" + c)
        return both.groupBy(key.alias("key")).agg(d("m"), d("v")).select(F.floor(F.col("key") / dims).alias(id_col), (F.col("key") % dims).cast("int").alias("direction"), "dm", "dv")

    def posterior(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and full covariance at a small set of points."""
        k = block(self.x, q, self.hyper, self.kernel)
        half = L.forward(self.factor, k)
        return self.prior(q) + k.T @ self.alpha, block(q, q, self.hyper, self.kernel) - half.T @ half

    # --- information

    def _prior_entropy(self, q: np.ndarray) -> float:
        """Of the joint prior at every training point and ``q``, with 1e-9 on its diagonal: points of a place share one row."""
        n, own = self.n + len(q), np.concatenate([1e-9 / self.counts, np.full(len(q), 1e-9)])
        both = np.concatenate([self.x, q])
        spare = (self.n - len(self.x)) * np.log(1e-9) + np.log(self.counts).sum()
        return float(n / 2 * (1 + np.log(2 * np.pi)) + 0.5 * (np.linalg.slogdet(block(both, both, self.hyper, self.kernel) + np.diag(own))[1] + spare))

    def entropy(self, q: np.ndarray) -> float:
        """Of the joint prior of the training points and ``q``."""
        return self._prior_entropy(q)

    def joint_prior(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the function at the places of the training points and at ``q``, before any data."""
        both = np.concatenate([self.x, q])
        means = [np.broadcast_to(np.asarray(self.prior(z), float), (len(z),)) for z in (self.x, q)]
        return np.concatenate(means), block(both, both, self.hyper, self.kernel) + np.diag(np.concatenate([1e-9 / self.counts, np.full(len(q), 1e-9)]))

    def joint_prior_slopes(self, q: np.ndarray, direction: int, step: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
        """Of ``joint_prior`` as all of ``q`` move together along one coordinate: the training points' own block has none."""
        n, e = len(self.x), step * np.eye(q.shape[1])[direction]
        (m1, s1), (m2, s2) = self.joint_prior(q + e), self.joint_prior(q - e)
        mean, s = (m1 - m2) / (2 * step), (s1 - s2) / (2 * step)
        if self.kernel is K.default_kernel:
            s[:n, n:] = list(K.default_kernel_point_slopes(self.x, q, self.hyper))[direction]
            s[n:, :n], s[n:, n:] = s[:n, n:].T, 0.0  # it depends on differences of coordinates alone
        mean[:n], s[:n, :n] = 0.0, 0.0
        return mean, s

    def entropy_slopes(self, q: np.ndarray) -> np.ndarray:
        """Of ``entropy`` as all of ``q`` move together along each coordinate: half the trace of S^-1 dS."""
        low = L.cholesky(self.joint_prior(q)[1])
        return np.array([0.5 * np.trace(L.solve(low, self.joint_prior_slopes(q, k)[1])) for k in range(q.shape[1])])

    def posterior_covariance_slopes(self, q: np.ndarray, direction: int) -> np.ndarray:
        """Of the covariance of ``posterior`` as all of ``q`` move together along one coordinate."""
        n, s = len(self.x), self.joint_prior_slopes(q, direction)[1]
        pull = s[n:, :n] @ L.solve(self.factor, block(self.x, q, self.hyper, self.kernel))
        return s[n:, n:] - pull - pull.T

    def mutual_information(self, q: np.ndarray) -> float:
        return self._prior_entropy(q[:0]) + gaussian_entropy(block(q, q, self.hyper, self.kernel) + 1e-9 * np.eye(len(q))) - self._prior_entropy(q)

    def total_correlation(self, q: np.ndarray) -> float:
        """Divergence of the joint prior from that of the training points and each of ``q`` apart: the blocks agree, so it is the
        difference of entropies."""
        own = block(q, q, self.hyper, self.kernel).diagonal() + 1e-9
        return float(abs(self._prior_entropy(q[:0]) + 0.5 * (len(q) * (1 + np.log(2 * np.pi)) + np.log(own).sum()) - self._prior_entropy(q)))

    def relative_information_entropy(self, q: np.ndarray) -> float:
        m, s = self.posterior(q)
        return kl_divergence(np.full(len(q), self.prior(q)), m, block(q, q, self.hyper, self.kernel) + 1e-9 * np.eye(len(q)), s + 1e-9 * np.eye(len(q)))

    def divergence_from(self, q: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> float:
        m, s = self.posterior(q)
        return kl_divergence(m, mean, s + 1e-9 * np.eye(len(q)), covariance)

    def posterior_probability(self, q: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Product of the posterior and a given Gaussian: mean, covariance and the density of their agreement."""
        m, s = self.posterior(q)
        both = s + covariance
        new = covariance @ np.linalg.solve(both, s)
        d = m - mean
        log = -0.5 * (d @ np.linalg.solve(both, d) + np.linalg.slogdet(both)[1] + len(m) * np.log(2 * np.pi))
        return m - s @ np.linalg.solve(both, d), (new + new.T) / 2, float(np.exp(log))


def object_posterior(points: DataFrame, queries: DataFrame, kernel: Callable[[Column, Column], Column], most: int = 8000) -> DataFrame:
    """(pred_id, m, v) where points are not coordinates: ``points`` (pt_id, obj, y, noise_var) and ``queries`` (pred_id, obj) hold
    strings, arrays, maps or structs, and ``kernel`` is a column of two of them.

    The points are few (``most``): their covariance is computed by Spark and factorised on the driver; queries meet the broadcast
    points, whatever their number. Prior mean: the mean of y.
    """
    rows = points.orderBy("pt_id").select("pt_id", "y", "noise_var").toPandas() if points.count() <= most else None
    if rows is None:
        raise ValueError(f"more than {most} points that are not coordinates")
    left, right = points.select(F.col("pt_id").alias("i"), F.col("obj").alias("a")), points.select(F.col("pt_id").alias("j"), F.col("obj").alias("b"))
    pairs = left.join(F.broadcast(right), F.col("i") <= F.col("j")).select("i", "j", kernel(F.col("a"), F.col("b")).alias("v")).toPandas()
    ids = rows["pt_id"].to_numpy()
    i, j, k = np.searchsorted(ids, pairs["i"]), np.searchsorted(ids, pairs["j"]), np.zeros((len(ids),) * 2)
    k[i, j] = k[j, i] = pairs["v"]
    low, mean = L.cholesky(k + np.diag(rows["noise_var"])), rows["y"].mean()
    sent = points.sparkSession.sparkContext.broadcast((L.solve(low, rows["y"].to_numpy() - mean), L.lower_inverse(low)))
    known = points.agg(F.sort_array(F.collect_list(F.struct("pt_id", F.col("obj").alias("a")))).alias("known"))  # one row of at most ``most`` points
    each = queries.select("pred_id", F.col("obj").alias("q")).join(F.broadcast(known), how="cross")
    each = each.select("pred_id", F.transform("known", lambda p: kernel(p["a"], F.col("q"))).alias("k"), kernel(F.col("q"), F.col("q")).alias("own"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alpha, inverse = sent.value
        for part in parts:
            k = np.array(part["k"].tolist(), float).reshape(len(part), len(alpha))
            yield pd.DataFrame({"pred_id": part["pred_id"], "m": mean + k @ alpha, "v": np.maximum(0.0, part["own"].to_numpy() - ((inverse @ k.T) ** 2).sum(0))})

    return in_batches(each, run, "pred_id long, m double, v double", 1000)


def exact_model(points: DataFrame, hyper: Sequence[float], kernel: Callable = K.default_kernel, mean: float | None = None, most_dense: int = 8000):
    """A model of the same likelihood and predictions on the driver or, beyond ``most_dense`` places, in tiles."""
    from .tiles import TiledGaussianProcess

    places = Places(points, mean=mean)
    if places.count <= most_dense:
        return GaussianProcess(places, hyper, kernel, mean, most_dense)
    return TiledGaussianProcess(places, hyper, kernel, mean)


def gaussian_entropy(s: np.ndarray) -> float:
    n = len(s)
    return float(n / 2 * (1 + np.log(2 * np.pi)) + 0.5 * np.linalg.slogdet(s)[1])


def kl_divergence(m1: np.ndarray, m2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> float:
    """Of N(m1, s1) from N(m2, s2)."""
    low1, low2 = L.cholesky(s1), L.cholesky(s2)
    d = m2 - m1
    return float(abs(0.5 * (np.trace(L.solve(low2, s1)) - len(d) + d @ L.solve(low2, d) + L.logdet(low2) - L.logdet(low1))))


def kl_normal(m1, v1, m2, v2):
    """Divergence of N(m1, v1) from N(m2, v2) on the line, as a column."""
    return 0.5 * (v1 / v2 - 1 + (m1 - m2) * (m1 - m2) / v2 + F.log(v2 / v1))


def z_value(interval: float) -> float:
    return NormalDist().inv_cdf(0.5 + interval / 2)


def _exact_product(k: np.ndarray, kernel: np.ndarray, noise: np.ndarray, low: np.ndarray, r: np.ndarray) -> np.ndarray:
    """k' (K + V)^-1 r with one refinement and sums in extended precision, so that neither the order of points nor the machine's
    linear algebra decides a last digit."""
    wide = L.solve(low, r.astype(float)).astype(np.longdouble)
    rest = r - noise * wide
    for s in range(0, len(r), 256):
        rest[s : s + 256] -= (kernel[s : s + 256] * wide).sum(1)
    wide = wide + L.solve(low, rest.astype(float))
    return np.array([(c * wide).sum() for c in k.T], np.longdouble)


def grouped_posterior(points: DataFrame, group: str, queries: DataFrame, hyper: Sequence[float]) -> DataFrame:
    """One GP per group, all groups at once: (group, pred_id, m, v). ``queries`` (group, pred_id, x) meet their group's points.

    Points of a group with equal coordinates are one place. A group's places are factorised in one task, so they are 8000 at most;
    a larger group raises (it takes a model of its own, in tiles).
    """
    hyper = list(hyper)
    y = F.coalesce(F.col("y"), F.lit(float("nan")))
    places = points.groupBy(group, "x").agg(F.count("*").alias("n"), F.sum(y).alias("total"), F.sum(F.abs(y)).alias("size"))

    def solve(key: tuple, pts: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(ask):
            return pd.DataFrame({group: [], "pred_id": [], "m": [], "v": []})
        q = np.array(ask["x"].tolist(), float)
        if not len(pts):
            m, v = np.zeros(len(q)), np.full(len(q), hyper[0])
        else:
            if len(pts) > 8000:
                raise ValueError(f"{len(pts)} places in one group; a model in one task takes 8000")
            x = np.array(pts["x"].tolist(), float)
            order = np.lexsort(x.T[::-1])
            x, n, total, size = x[order], *(pts[c].to_numpy(float)[order] for c in ("n", "total", "size"))
            mean, noise = total.astype(np.longdouble).sum() / n.sum(), max((size.sum() / n.sum() / 100) ** 2, 1e-9) / n
            own, k = block(x, x, hyper), block(x, q, hyper)
            low = L.cholesky(own + np.diag(noise))
            m = float(mean) + _exact_product(k, own, noise, low, total / n - mean).astype(float)
            v = np.maximum(0.0, hyper[0] - (L.forward(low, k) ** 2).sum(0))
        return pd.DataFrame({group: key[0], "pred_id": ask["pred_id"].to_numpy(), "m": m, "v": v})

    schema = f"{points.select(group).schema[0].simpleString().replace(':', ' ')}, pred_id long, m double, v double"
    return places.groupBy(group).cogroup(queries.groupBy(group)).applyInPandas(solve, schema)
