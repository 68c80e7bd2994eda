"""Distributions as observations: every station has a mixture, one Gaussian process per component joins the stations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mixture
from .gp import exact_model


def component_points(components: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Points (pt_id, x, y, noise_var) of component ``k``: its means at the stations' places, its variances as noise."""
    own = components.where(F.col("k") == k).select("station", "mean", "variance")
    at = places.select(F.col("station").alias("place"), "x")
    return own.join(at, F.col("station") == F.col("place")).select(F.col("station").cast("long").alias("pt_id"), "x", F.col("mean").alias("y"), F.col("variance").alias("noise_var"))


class DistributionalProcess:
    """One model per component of ``components`` (station, k, mean, variance) over ``places`` (station, x); shared weights.

    A component's prior mean is the mean of its stations' means. Components must be numbered alike at all stations
    (``mixture_points.aligned_along``).
    """

    def __init__(self, components: DataFrame, places: DataFrame, hypers: Sequence[Sequence[float]], weights: Sequence[float] | None = None) -> None:
        self.components, self.places = components, places
        self.models = [exact_model(component_points(components, places, k), h) for k, h in enumerate(hypers)]
        self.weights = list(weights) if weights is not None else [1 / len(hypers)] * len(hypers)

    def train_components(self, bounds: Sequence[np.ndarray] | None = None, method: str = "local", steps: int = 30, **more) -> list[np.ndarray]:
        """Trains the hyperparameters of every component's model (``training.train`` says how) and goes on with them; bounds
        follow each component's points unless given. Returns them."""
        from krigora.plans import training

        found = []
        for k, model in enumerate(self.models):
            points = component_points(self.components, self.places, k)
            b = training.default_bounds(points, len(model.hyper) - 1) if bounds is None else np.asarray(bounds[k], float)
            objective = training.TableObjective(lambda h, points=points: exact_model(points, h))
            found.append(training.train(objective, model.hyper, b, method, steps=steps, **more))
            self.models[k] = exact_model(points, found[-1])
        return found

    def log_likelihoods(self) -> list[float]:
        return [m.log_likelihood() for m in self.models]

    def predicted_components(self, queries: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, k, weight, mean, variance) of every component at every row of ``queries`` (id, x)."""
        out = None
        for k, (m, w) in enumerate(zip(self.models, self.weights, strict=True)):
            got = m.predict(queries, id_col).select(id_col, F.lit(k).alias("k"), F.lit(float(w)).alias("weight"), F.col("m").alias("mean"), F.col("v").alias("variance"))
            out = got if out is None else out.unionByName(got)
        return out

    def predict(self, queries: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, mean, variance) of the predicted mixtures."""
        return mixture.mixture_moments(self.predicted_components(queries, id_col), id_col)

    def train_weights(self, densities: DataFrame, width: float, rounds: int = 200, tol: float = 1e-10) -> list[float]:
        """Weights that make the components, as predicted at the stations, fit the stations' densities (station, at, density)."""
        stations = self.places.select(F.col("station").cast("long").alias("pred_id"), "x")
        found = self.predicted_components(stations).withColumnRenamed("pred_id", "station")
        for _ in range(rounds):
            new = density_weights(densities, found, self.weights, width)
            done, self.weights = sum(abs(a - b) for a, b in zip(new, self.weights, strict=True)) < tol, new
            if done:
                break
        return self.weights


def log_normal(at: Column, mean: Column, variance: Column) -> Column:
    v = F.greatest(variance, F.lit(1e-12))
    return -0.5 * (F.log(2 * np.pi * v) + (at - mean) * (at - mean) / v)


def density_weights(densities: DataFrame, components: DataFrame, weights: Sequence[float], width: float, floor: float = 1e-9) -> list[float]:
    """One EM step for common weights on densities (station, at, density): each bin counts by its mass, and Spark sums."""
    k = len(weights)
    wide = components.groupBy("station").agg(*[F.max(F.when(F.col("k") == j, F.struct("mean", "variance"))).alias(f"c{j}") for j in range(k)])
    logs = [F.lit(float(np.log(max(w, 1e-300)))) + log_normal(F.col("at"), F.col(f"c{j}.mean"), F.col(f"c{j}.variance")) for j, w in enumerate(weights)]
    rows = densities.join(wide.withColumnRenamed("station", "owner"), F.col("station") == F.col("owner")).select((F.col("density") * width).alias("mass"), *[c.alias(f"l{j}") for j, c in enumerate(logs)])
    top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
    parts = [F.exp(F.col(f"l{j}") - top) for j in range(k)]
    total = sum(parts[1:], parts[0])
    got = rows.agg(*[F.sum(F.col("mass") * p / total).alias(f"w{j}") for j, p in enumerate(parts)]).first()
    new = np.array([got[f"w{j}"] or 0.0 for j in range(k)])
    new = np.maximum(new / max(new.sum(), 1e-300), floor)
    return (new / new.sum()).tolist()
