"""Models over moved coordinates: a network warps the points, a compactly supported model in strips takes them from there.

The network's slopes are the chain rule over tables: the model gives the likelihood's slopes along every moved coordinate, each
partition carries its points back through the network, and one sum over partitions remains.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krigora.functions.networks import Network
from krigora.sources.places import Places

from . import linalg as L
from .strips import compact_model, wendland_block, wendland_point_slopes, wendland_slopes

#: Places of a model that is asked for likelihood and slopes only, up to which one matrix on the driver gives them; as many as strips
#: leave to one task.
LOCAL_PLACES = 2500


class WarpedProcess:
    """An exact GP over ``points`` (pt_id, x, y[, noise_var]) whose Wendland kernel sees ``network(x)``.

    ``hyper`` = [variance, length per moved coordinate]; both kinds of parameters are set together by ``set_parameters``, the kernel's
    first. Points that the network brings together beyond what a strip holds are left to cells, which predict but give no slopes.
    """

    def __init__(self, points: DataFrame | Places, network: Network, network_parameters: Sequence[float], hyper: Sequence[float], **strips) -> None:
        self.places = Places.of(points, strips.pop("noise", None), strips.pop("mean", None))
        if self.places.dims != network.dims:
            raise ValueError(f"a network for {network.dims} coordinates, points of {self.places.dims}")
        self._own, self.network, self.strips, self.model = self.places is not points, network, strips, None
        self.points = self.places.table.select("pt_id", "x", "y", "noise_var")
        self.set_parameters([*hyper, *network_parameters])

    def set_parameters(self, parameters: Sequence[float]) -> None:
        k = 1 + self.network.out
        if self.model is not None:
            self._drop()
        self.hyper, self.weights = [float(h) for h in parameters[:k]], np.array(parameters[k:], float)
        self.model = compact_model(self.warped(self.points), self.hyper, mean=self.places.mean, **self.strips)

    def warped(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("x", self.network.column(F.col("x"), self.weights))

    def log_likelihood(self) -> float:
        p = self.places  # the model's points are the places before the network moves them
        return self.model.log_likelihood() - 0.5 * float(p.logdet + p.square + (p.n - p.count) * np.log(2 * np.pi))

    def log_likelihood_variance(self) -> float:
        """Of a likelihood that cells estimate; strips are exact."""
        return self.model.log_likelihood_variance() if hasattr(self.model, "log_likelihood_variance") else 0.0

    def predict(self, queries: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, m, v) of every row of ``queries`` (id, x), warped as the points are."""
        return self.model.predict(self.warped(queries.select(id_col, "x")), id_col)

    def likelihood_gradient(self) -> np.ndarray:
        """Of the log likelihood by the kernel's, then the network's parameters."""
        if not hasattr(self.model, "point_slopes"):
            raise ValueError("the points are too crowded for strips, and cells give no slopes; take shorter lengths")
        network, weights, dims = self.network, self.weights, self.network.dims

        def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(network.size)
            for part in parts:
                if len(part):
                    x, outer = (np.array(part[c].tolist(), float).reshape(len(part), n) for c, n in (("x", dims), ("slope", network.out)))
                    total += network.slopes(x, outer, weights)
            yield pd.DataFrame({"k": range(network.size), "slope": total})

        both = self.points.select(F.col("pt_id").alias("i"), "x").join(self.model.point_slopes(), "i").select("x", "slope")
        sums = dict(both.mapInPandas(back, "k int, slope double").groupBy("k").agg(F.sum("slope")).collect())  # one row a parameter
        return np.array([*self.model.likelihood_gradient(), *[sums.get(k, 0.0) for k in range(network.size)]])

    def discard(self) -> None:
        """Deletes the model's tables."""
        self._drop()
        if self._own:
            self.places.discard()

    def _drop(self) -> None:
        if hasattr(self.model, "discard"):
            self.model.discard()


class LocalWarpedProcess:
    """Likelihood and slopes of ``WarpedProcess`` by one matrix over few places, without a job: for searches that ask for many of them."""

    def __init__(self, places: Places, network: Network, network_parameters: Sequence[float], hyper: Sequence[float]) -> None:
        self.places, self.network, self.weights, self.hyper = places, network, np.asarray(network_parameters, float), [float(h) for h in hyper]
        self.x, y, noise = places.arrays()
        self.at, right = network(self.x, self.weights), y - places.mean
        low = L.cholesky(wendland_block(self.at, self.at, self.hyper) + np.diag(noise))
        self.inverse = L.inverse(low)
        self.alpha = self.inverse @ right
        self.logdet, self.quadratic = L.logdet(low) + places.logdet, float(right @ self.alpha) + places.square

    def log_likelihood(self) -> float:
        return self.places.log_likelihood(self.logdet, self.quadratic)

    def likelihood_gradient(self) -> np.ndarray:
        """Of the log likelihood by the kernel's, then the network's parameters."""
        pull = np.outer(self.alpha, self.alpha) - self.inverse
        outer = np.stack([(pull * d).sum(0) for d in wendland_point_slopes(self.at, self.at, self.hyper)], 1)
        return np.array([*[0.5 * (pull * d).sum() for d in wendland_slopes(self.at, self.at, self.hyper)], *self.network.slopes(self.x, outer, self.weights)])


def warped_likelihood(places: Places, network: Network, network_parameters: Sequence[float], hyper: Sequence[float]) -> WarpedProcess | LocalWarpedProcess:
    """A model for likelihood and slopes: on the driver while the places are few, else over tables."""
    if places.count <= LOCAL_PLACES:
        return LocalWarpedProcess(places, network, network_parameters, hyper)
    return WarpedProcess(places, network, network_parameters, hyper, predicts=False)
