"""Training: searches over hyperparameters whose every step asks a likelihood that Spark or a factor has made cheap."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krigora.sources.store import written

Objective = Callable[[np.ndarray], float]


def default_bounds(points: DataFrame, dims: int) -> np.ndarray:
    """Variance of y over 100 to 10 times it; range of each coordinate over 100 to 10 times it."""
    x = [F.get(F.col("x"), k) for k in range(dims)]
    got = points.agg(F.var_pop("y"), *[F.max(c) - F.min(c) for c in x]).first()
    return np.array([[max(v or 0.0, 1e-12) / 100, max(v or 0.0, 1e-12) * 10] for v in got])


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: Sequence[float], bounds: np.ndarray, rate: float = 0.01, steps: int = 500, tol: float = 1e-6) -> np.ndarray:
    """Minimises by Adam, inside the bounds."""
    x, m, v = np.array(start, float), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        new = np.clip(x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), bounds[:, 0], bounds[:, 1])
        done, x = np.linalg.norm(new - x) < tol, new
        if done:
            break
    return x


def quasi_newton(f: Objective, gradient: Callable[[np.ndarray], np.ndarray], start: Sequence[float], bounds: np.ndarray, steps: int = 100, tol: float = 1e-6) -> np.ndarray:
    """BFGS steps projected on the bounds, with backtracking."""
    x = np.clip(np.array(start, float), bounds[:, 0], bounds[:, 1])
    h, fx, g = np.eye(len(x)), f(x), gradient(x)
    for _ in range(steps):
        d, t = -h @ g, 1.0
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        while True:
            new = np.clip(x + t * d, bounds[:, 0], bounds[:, 1])
            fn = f(new)
            if fn <= fx + 1e-4 * g @ (new - x) or t < 1e-10:
                break
            t /= 2
        s, gn = new - x, gradient(new)
        if np.abs(s).max() < tol or fn > fx:
            return new if fn < fx else x
        y = gn - g
        if s @ y > 1e-12:
            r = np.eye(len(x)) - np.outer(s, y) / (s @ y)
            h = r @ h @ r.T + np.outer(s, s) / (s @ y)
        x, fx, g = new, fn, gn
    return x


def until_flat(f: Objective, gradient: Callable[[np.ndarray], np.ndarray], start: Sequence[float], bounds: np.ndarray, tol: float = 1e-8, patience: int = 20) -> np.ndarray:
    """Minimises inside the bounds, in as many BFGS steps as it takes, also where slopes jump (rectifiers).

    Parameters that their bounds hold are left out of a step, and a step ends at the first bound. It is as long as the weak Wolfe
    conditions ask, so that curvature stays positive across kinks. The end is where no step is found from the plain gradient,
    or where ``patience`` steps together have gained less than ``tol`` of the value.
    """
    low, high = bounds.T
    x = np.clip(np.array(start, float), low, high)
    h, fx, g, plain, seen = np.eye(len(x)), f(x), gradient(x), True, []
    while True:
        seen.append(fx)
        if len(seen) > patience and seen[-1 - patience] - fx <= tol * (1 + abs(fx)):
            return x
        free = ~((x <= low) & (g >= 0) | (x >= high) & (g <= 0))
        d = -(h * np.outer(free, free)) @ g
        held = (x <= low) & (d < 0) | (x >= high) & (d > 0)
        if held.any():
            free &= ~held
            d = -(h * np.outer(free, free)) @ g
        if not d @ g < 0 or ((x <= low) & (d < 0) | (x >= high) & (d > 0)).any():
            free = ~((x <= low) & (g >= 0) | (x >= high) & (g <= 0))
            h, d, plain = np.eye(len(x)), np.where(free, -g, 0.0), True
        if not d.any():
            return x
        with np.errstate(divide="ignore", invalid="ignore"):
            far = float(np.min(np.where(d > 0, (high - x) / d, np.where(d < 0, (low - x) / d, np.inf))))
        t, least, most, found = min(far, 1.0 / max(1.0, np.abs(d).max()) if plain else 1.0), 0.0, np.inf, None
        for _ in range(60):  # halves 60 times: beyond that a step changes no digit
            new = np.clip(x + t * d, low, high)
            new = np.where(new - low <= 1e-9 * (high - low), low, np.where(high - new <= 1e-9 * (high - low), high, new))
            fn = f(new)
            if not fn <= fx + 1e-4 * t * (d @ g):
                most = t
            else:
                gn = gradient(new)
                found = new, fn, gn
                if gn @ d >= 0.9 * (g @ d) or t >= far:
                    break
                least = t
            t = (least + most) / 2 if np.isfinite(most) else min(2 * t, far)
        if found is None or not found[1] < fx:
            if plain:
                return x
            h, plain = np.eye(len(x)), True
            continue
        new, fn, gn = found
        s, y = new - x, gn - g
        if s @ y > 1e-12 * (s @ s) ** 0.5 * (y @ y) ** 0.5:
            if plain:
                h = np.eye(len(x)) * (s @ y) / (y @ y)
            r = np.eye(len(x)) - np.outer(s, y) / (s @ y)
            h, plain = r @ h @ r.T + np.outer(s, s) / (s @ y), False
        x, fx, g = new, fn, gn


def evaluate(spark: SparkSession, f: Objective, candidates: np.ndarray) -> np.ndarray:
    """Objective of many candidates at once, one Spark task for each handful of them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"k": p["k"], "f": [float(f(np.array(h, float))) for h in p["h"]]})

    rows = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(candidates)], "k int, h array<double>").repartition(min(len(candidates), 4 * spark.sparkContext.defaultParallelism))
    got = dict(rows.mapInPandas(run, "k int, f double").collect())
    return np.array([got[k] for k in range(len(candidates))])


def evolution(spark: SparkSession, f: Objective, bounds: np.ndarray, population: int = 24, generations: int = 15, seed: int = 0) -> np.ndarray:
    """Differential evolution: each generation's trials are one Spark job."""
    rng, (low, high) = np.random.default_rng(seed), bounds.T
    x = low + rng.random((population, len(low))) * (high - low)
    fx = evaluate(spark, f, x)
    for _ in range(generations):
        pick = np.array([rng.choice(population, 3, replace=False) for _ in range(population)])
        trial = np.where(rng.random(x.shape) < 0.7, x[pick[:, 0]] + rng.uniform(0.5, 1.0) * (x[pick[:, 1]] - x[pick[:, 2]]), x)
        trial = np.clip(trial, low, high)
        ft = evaluate(spark, f, trial)
        better = ft < fx
        x[better], fx[better] = trial[better], ft[better]
        if np.ptp(fx) < 1e-8 * (1 + abs(fx.min())):
            break
    return x[fx.argmin()]


def multi_start(spark: SparkSession, f: Objective, bounds: np.ndarray, starts: int = 16, steps: int = 50, seed: int = 0) -> DataFrame:
    """(start, h, f) of local searches from spread starting points, one Spark task for each, the best first."""
    rng, (low, high) = np.random.default_rng(seed), bounds.T
    cells = np.stack([(rng.permutation(starts) + rng.random(starts)) / starts for _ in low], 1)

    def slope(h: np.ndarray) -> np.ndarray:
        e = 1e-6 * np.maximum(1.0, np.abs(h))
        return np.array([(f(h + d) - f(h - d)) / (2 * d.sum()) for d in np.diag(e)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [quasi_newton(f, slope, np.array(h, float), bounds, steps) for h in p["h"]]
            yield pd.DataFrame({"start": p["start"], "h": [h.tolist() for h in found], "f": [float(f(h)) for h in found]})

    rows = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(low + cells * (high - low))], "start int, h array<double>").repartition(starts)
    return written(rows.mapInPandas(run, "start int, h array<double>, f double"), "searches").orderBy("f", "start")


def chains(
    spark: SparkSession, log_density: Objective, start: Sequence[float], bounds: np.ndarray, n_chains: int = 4, steps: int = 500, seed: int = 0,
    covariance: np.ndarray | None = None, scale: float | None = None, log_prior: Callable[[np.ndarray], float] | None = None, propose: Callable | None = None, adapt: bool = True,
) -> DataFrame:
    """(chain, iter, hps, f, taken): Metropolis chains, one per Spark task.

    Jumps are normal with ``covariance`` (a fifth of the bounds' deviation each way by default) times a scale that follows the
    acceptance rate unless ``adapt`` is false. ``propose(x, rng)`` replaces them by jumps of any symmetric kind; ``log_prior``
    replaces the uniform prior over the bounds. ``f`` is the log density without the prior.
    """
    low, high, first = bounds[:, 0], bounds[:, 1], np.array(start, float)
    shape = np.diag((0.2 * (high - low) / np.sqrt(12)) ** 2) if covariance is None else np.asarray(covariance, float)
    root, size = np.linalg.cholesky(shape + 1e-12 * np.trace(shape) * np.eye(len(first))), 1.0 if scale is None else scale
    prior = log_prior or (lambda x: 0.0 if (x >= low).all() and (x <= high).all() else -np.inf)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for chain in p["chain"]:
                rng = np.random.default_rng([seed, int(chain)])
                x, s, taken, trace = first.copy(), size, 0, []
                fx, px = log_density(x), prior(x)
                for t in range(steps):
                    new = propose(x, rng) if propose else x + s * (root @ rng.normal(size=len(x)))
                    pn = prior(new)
                    fn = log_density(new) if np.isfinite(pn) else -np.inf
                    ok = np.log(rng.random()) < fn + pn - fx - px
                    if ok:
                        x, fx, px, taken = new, fn, pn, taken + 1
                    if adapt and t % 50 == 49:
                        s, taken = s * np.exp((taken / 50 - 0.234) / np.sqrt(1 + t / 50)), 0
                    trace.append((int(chain), t, x.tolist(), float(fx), bool(ok)))
                yield pd.DataFrame(trace, columns=["chain", "iter", "hps", "f", "taken"])

    return spark.range(n_chains).select(F.col("id").cast("int").alias("chain")).repartition(n_chains).mapInPandas(run, "chain int, iter int, hps array<double>, f double, taken boolean")


def pooled_covariance(trace: DataFrame, burn: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and acceptance rate over all chains of a trace, by sums of products in Spark."""
    last = trace.agg(F.max("iter")).first()[0] or 0
    rows = trace.where(F.col("iter") >= burn * last)
    d = rows.agg(F.max(F.size("hps"))).first()[0] or 0
    x = [F.get("hps", k) for k in range(d)]
    got = rows.agg(F.avg(F.col("taken").cast("double")), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i in range(d) for j in range(i, d)]).first()
    s, at = np.zeros((d, d)), iter(got[1 + d :])
    for i in range(d):
        for j in range(i, d):
            s[i, j] = s[j, i] = next(at) or 0.0
    return np.array(got[1 : 1 + d], float), s, float(got[0] or 0.0)


def learned_chains(
    spark: SparkSession, log_density: Objective, start: Sequence[float], bounds: np.ndarray, n_chains: int = 4, steps: int = 200, portions: int = 10, seed: int = 0,
    log_prior: Callable[[np.ndarray], float] | None = None, stop: Callable[[DataFrame], bool] | None = None,
) -> DataFrame:
    """(portion, chain, iter, hps, f, taken): chains whose jumps follow the covariance that all of them have seen.

    Between portions the pooled covariance moves towards that of the last portion, in steps that shrink as portions pass (so the
    chains come to rest on one distribution), and the jump's scale towards an acceptance rate of 0.234. Each portion starts from
    the mean of the last. ``stop(trace)`` ends the run early; ``settled`` is such a rule.
    """
    d = len(bounds)
    shape, scale, at, out = np.diag((0.2 * (bounds[:, 1] - bounds[:, 0])) ** 2 / 12), 2.4 / np.sqrt(d), np.array(start, float), None
    for k in range(portions):
        part = chains(spark, log_density, at, bounds, n_chains, steps, seed + k, shape, scale, log_prior, adapt=False)
        part = written(part.withColumn("iter", F.col("iter") + F.lit(k * steps)).withColumn("portion", F.lit(k)), "learned-chains")
        out = part if out is None else out.unionByName(part)
        mean, seen, rate = pooled_covariance(part)
        gain = 1.0 / (k + 1) ** 0.8
        shape = shape + gain * (seen - shape) if rate > 0 else shape * 0.25
        scale = scale * np.exp(min(10 * gain, 2.0) * (rate - 0.234))
        inside = mean if log_prior is None or np.isfinite(log_prior(mean)) else at
        at = inside if np.isfinite(log_density(inside)) else at
        if stop is not None and stop(out if k == 0 else out.where(F.col("portion") >= k // 2).withColumn("iter", F.col("iter") - F.lit((k // 2) * steps))):
            break
    return out.select("portion", "chain", "iter", "hps", "f", "taken")


def settled(trace: DataFrame, window: float = 0.25, within: float = 0.1) -> bool:
    """Whether every parameter's mean over the last ``window`` of all chains lies within ``within`` deviations of that over the
    window before."""
    last = trace.agg(F.max("iter")).first()[0]
    if not last:
        return False
    later = F.floor((F.col("iter") - (1 - 2 * window) * last) / (window * last + 1))
    long = trace.where(F.col("iter") >= (1 - 2 * window) * last).select(F.least(later, F.lit(1)).alias("part"), F.posexplode("hps").alias("parameter", "value"))
    got = long.groupBy("parameter").agg(*[F.avg(F.when(F.col("part") == p, F.col("value"))).alias(f"m{p}") for p in (0, 1)], F.stddev("value").alias("sd"))
    return not got.where(F.abs(F.col("m0") - F.col("m1")) > within * F.greatest("sd", F.lit(1e-12))).limit(1).count()


def chains_until_settled(spark: SparkSession, log_density: Objective, start: Sequence[float], bounds: np.ndarray, n_chains: int = 4, steps: int = 500, most: int = 10, seed: int = 0) -> DataFrame:
    """Runs chains in portions of ``steps``, each from the best point so far, until the last portion is settled."""
    out, best = None, np.array(start, float)
    for k in range(most):
        part = written(chains(spark, log_density, best, bounds, n_chains, steps, seed + k).withColumn("iter", F.col("iter") + F.lit(k * steps)), "chains")
        out = part if out is None else out.unionByName(part)
        best = np.array(part.agg(F.max_by("hps", "f")).first()[0], float)
        if settled(part.withColumn("iter", F.col("iter") - F.lit(k * steps))):
            break
    return out


def trace_median(trace: DataFrame, share: float = 0.01) -> DataFrame:
    """(parameter, median) over the last ``share`` of all chains: what a run of chains is taken to have found."""
    last = trace.agg(F.max("iter")).first()[0] or 0
    long = trace.where(F.col("iter") >= (1 - share) * last).select(F.posexplode("hps").alias("parameter", "value"))
    return long.groupBy("parameter").agg(F.median("value").alias("median"))


def trace_summary(trace: DataFrame, dims: int, burn: float = 0.5) -> DataFrame:
    """(parameter, mean, sd, best) of the later part of all chains."""
    last = trace.agg(F.max("iter")).first()[0] or 0
    kept = trace.where(F.col("iter") >= burn * last)
    long = kept.select("f", F.posexplode("hps").alias("parameter", "value"))
    return long.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.max_by("value", "f").alias("best"))


def bayesian(f: Objective, bounds: np.ndarray, evaluations: int = 30, seed: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """Minimises a costly objective: a Matern-5/2 surrogate on the unit cube and expected improvement over it."""
    from statistics import NormalDist

    from krigora.functions.kernels import NUMPY, distance, matern_5_2
    from krigora.operators import linalg as L

    rng, (low, high), n01 = np.random.default_rng(seed), bounds.T, NormalDist()
    logs = low > 0
    out = lambda u: np.where(logs, np.exp(np.log(np.where(logs, low, 1)) + u * (np.log(np.where(logs, high, 1)) - np.log(np.where(logs, low, 1)))), low + u * (high - low))
    d = len(low)
    kernel = lambda a, b, size: matern_5_2(distance([a[:, k][:, None] for k in range(d)], [b[:, k][None] for k in range(d)], size, NUMPY), 1.0, NUMPY)

    def surrogate_loss(size: np.ndarray, noise: float, u: np.ndarray, z: np.ndarray) -> float:
        """Minus the log likelihood of the values with the best variance, and a mild pull of the lengths to 0.5."""
        try:
            factor = L.cholesky(kernel(u, u, size) + noise * np.eye(len(u)))
        except ValueError:
            return np.inf
        return 0.5 * len(z) * np.log(max(z @ L.solve(factor, z), 1e-12)) + 0.5 * L.logdet(factor) + 0.5 * float((np.log(size / 0.5) ** 2).sum())

    def fit_surrogate(size: np.ndarray, noise: float, u: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float]:
        """Lengths and noise by trying steps of one at a time, each smaller than the last."""
        at, best = np.log([*size, noise]), surrogate_loss(size, noise, u, z)
        for step in (1.0, 0.5, 0.25):
            for k in range(d + 1):
                for sign in (-1, 1):
                    new = at.copy()
                    new[k] = np.clip(new[k] + sign * step, np.log(1e-6), np.log(5.0))
                    got = surrogate_loss(np.exp(new[:d]), float(np.exp(new[d])), u, z)
                    if got < best:
                        at, best = new, got
        return np.exp(at[:d]), float(np.exp(at[d]))

    first = min(evaluations, max(5, 2 * (d + 1)))
    u = np.stack([(rng.permutation(first) + rng.random(first)) / first for _ in range(d)], 1)
    y = np.array([f(out(p)) for p in u])
    size, noise = np.full(d, 0.4), 1e-4
    while len(y) < evaluations:
        scale = max(y.std(), 1e-12)
        z = (y - y.mean()) / scale
        size, noise = fit_surrogate(size, noise, u, z)
        low_t = L.cholesky(kernel(u, u, size) + noise * np.eye(len(u)))
        alpha, best = L.solve(low_t, z), u[y.argmin()]
        tall = max(float(z @ alpha) / len(z), 1e-12)
        cand = np.clip(np.concatenate([rng.random((512, d)), best + 0.1 * rng.normal(size=(256, d)), best + 0.01 * rng.normal(size=(128, d))]), 0, 1)
        k = kernel(u, cand, size)
        mu, sd = k.T @ alpha, np.sqrt(np.maximum(1e-12, tall * (1 - (L.forward(low_t, k) ** 2).sum(0))))
        t = ((kernel(u, u, size) @ alpha).min() - mu) / sd  # the best of the values without their noise
        gain = sd * (t * np.array([n01.cdf(v) for v in t]) + np.exp(-t * t / 2) / np.sqrt(2 * np.pi))
        if gain.max() < 1e-9:
            break
        u = np.concatenate([u, cand[[gain.argmax()]]])
        y = np.append(y, f(out(u[-1])))
    return out(u[y.argmin()]), [(out(p), float(v)) for p, v in zip(u, y, strict=True)]


def keep_if_better(objective: Objective, old: np.ndarray, new: np.ndarray, variance: Callable[[np.ndarray], float] | None = None) -> np.ndarray:
    """The trained values, or the old ones if training has made the objective worse.

    An objective that is an estimate says how uncertain it is by ``variance``: then worse means by more than three deviations of
    the difference of two estimates.
    """
    slack = 3.0 * np.sqrt(variance(old) + variance(new)) if variance else 0.0
    return new if objective(new) <= objective(old) + slack else old


class TableObjective:
    """Minus the likelihood of a model over tables and its slopes, as functions of its hyperparameters.

    ``build(hyper)`` makes the model by Spark jobs; the one asked last is kept, so a value and its slopes share its factor, and the
    tables of the one before are deleted. A covariance without a factor counts as ``worst``.
    """

    def __init__(self, build: Callable[[np.ndarray], object], worst: float = 1e12) -> None:
        self.build, self.worst, self.asked = build, worst, 0
        self._at: bytes | None = None
        self._model = None

    def model(self, hyper: np.ndarray):
        key = np.asarray(hyper, float).tobytes()
        if key != self._at:
            if hasattr(self._model, "discard"):
                self._model.discard()
            self._at = self._model = None
            self._model, self._at = self.build(np.asarray(hyper, float)), key
            self.asked += 1
        return self._model

    def __call__(self, hyper: np.ndarray) -> float:
        try:
            return -self.model(hyper).log_likelihood()
        except Exception as e:  # the same failure comes from a task as another class
            if "no Cholesky factor" not in str(e):
                raise
            return self.worst

    def slopes(self, hyper: np.ndarray) -> np.ndarray:
        return -self.model(hyper).likelihood_gradient()

    def variance(self, hyper: np.ndarray) -> float:
        """Of the estimate of a model that estimates its likelihood, else zero."""
        model = self.model(hyper)
        return model.log_likelihood_variance() if hasattr(model, "log_likelihood_variance") else 0.0


def train(objective: Objective, start: Sequence[float], bounds: np.ndarray, method: str | Callable = "local", slopes: Callable[[np.ndarray], np.ndarray] | None = None, spark: SparkSession | None = None, steps: int | None = 100, seed: int = 0, accept_only_if_improved: bool = True, variance: Callable[[np.ndarray], float] | None = None) -> np.ndarray:
    """Hyperparameters that minimise ``objective`` inside the bounds, from ``start``.

    ``method`` is ``local`` (quasi-Newton), ``adam``, ``global`` (evolution), ``searches`` (many local ones), ``mcmc`` (the median of
    chains), ``bo``, or a function of (objective, start, bounds) that returns them. The first two take ``slopes``, or
    differences, and ``local`` with ``steps`` of None goes on until it can't get lower; global, searches and mcmc evaluate in Spark tasks, so their objective must do without a session. The start is
    kept where training has made it worse, unless ``accept_only_if_improved`` is false.
    """
    start = np.clip(np.array(start, float), bounds[:, 0], bounds[:, 1])

    def differences(h: np.ndarray) -> np.ndarray:
        e = 1e-6 * np.maximum(1.0, np.abs(h))
        return np.array([(objective(h + d) - objective(h - d)) / (2 * d.sum()) for d in np.diag(e)])

    slopes = slopes or getattr(objective, "slopes", None) or differences
    if callable(method):
        new = np.asarray(method(objective, start, bounds), float)
    elif method == "local":
        new = until_flat(objective, slopes, start, bounds) if steps is None else quasi_newton(objective, slopes, start, bounds, steps)
    elif method == "adam":
        new = adam(slopes, start, bounds, steps=steps)
    elif method == "global":
        new = evolution(spark, objective, bounds, generations=steps, seed=seed)
    elif method == "searches":
        new = np.array(multi_start(spark, objective, bounds, steps=steps, seed=seed).first()["h"], float)
    elif method == "mcmc":
        trace = chains(spark, lambda h: -objective(h), start, bounds, steps=max(200, steps), seed=seed)
        new = np.array([r["median"] for r in trace_median(trace, 0.5).orderBy("parameter").collect()])
    elif method == "bo":
        new = bayesian(objective, bounds, steps, seed)[0]
    else:
        raise ValueError(f"no method {method!r}")
    return keep_if_better(objective, start, new, variance) if accept_only_if_improved else new
