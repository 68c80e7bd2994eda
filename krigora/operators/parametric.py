"""Models over tables whose prior mean and noise are functions with parameters of their own.

Mean and noise are columns of the coordinates and of their parameters, so they are evaluated where the points lie. The likelihood and
its slopes by all parameters (kernel, mean, noise) come from a model in strips and one sum over the points joined with their
weights; nothing as long as the points reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krigora.sources.points import check, coordinates

from .strips import StripGaussianProcess

#: f(coordinates, parameters) -> column
Form = Callable[[list[Column], Sequence[float]], Column]
Slopes = Callable[[list[Column], Sequence[float]], list[Column]]


def difference_slopes(form: Form, step: float = 1e-6) -> Slopes:
    """Central differences of a form by each of its parameters, as columns."""

    def slopes(x: list[Column], parameters: Sequence[float]) -> list[Column]:
        out = []
        for k, p in enumerate(parameters):
            e = step * max(1.0, abs(p))
            up, down = ([*parameters[:k], p + s, *parameters[k + 1 :]] for s in (e, -e))
            out.append((form(x, up) - form(x, down)) / (2 * e))
        return out

    return slopes


class ParametricProcess:
    """An exact GP over ``points`` (pt_id, x, y) with the Wendland kernel, a mean form and a noise form.

    ``kernel`` = [variance, length per dimension]; ``mean`` and ``noise`` are forms with their parameters. Slopes that are not
    given are differences. Noise must be positive at every point.
    """

    def __init__(self, points: DataFrame, kernel: Sequence[float], mean: Form, mean_parameters: Sequence[float], noise: Form, noise_parameters: Sequence[float], mean_slopes: Slopes | None = None, noise_slopes: Slopes | None = None, **strips) -> None:
        self.points, self.forms, self.strips = points, (mean, noise), strips
        self.slopes = (mean_slopes or difference_slopes(mean), noise_slopes or difference_slopes(noise))
        self.dims = check(points)["dims"]
        self.sizes = (self.dims + 1, len(mean_parameters), len(noise_parameters))
        self.set_parameters([*kernel, *mean_parameters, *noise_parameters])

    def set_parameters(self, parameters: Sequence[float]) -> None:
        """Kernel, mean and noise parameters, one after the other."""
        if len(parameters) != sum(self.sizes):
            raise ValueError(f"{len(parameters)} parameters, not {sum(self.sizes)}")
        self.parameters = [float(p) for p in parameters]
        a, b = self.sizes[0], self.sizes[0] + self.sizes[1]
        self.kernel, self.theta, self.phi = self.parameters[:a], self.parameters[a:b], self.parameters[b:]
        x = coordinates("x", self.dims)
        rest = self.points.select("pt_id", "x", (F.col("y") - self.forms[0](x, self.theta)).alias("y"), self.forms[1](x, self.phi).cast("double").alias("noise_var"))
        if rest.where(~(F.col("noise_var") > 0)).limit(1).count():
            raise ValueError("noise variances must be positive")
        self.model = StripGaussianProcess(rest, self.kernel, mean=0.0, **self.strips)

    def log_likelihood(self) -> float:
        return self.model.log_likelihood()

    def likelihood_gradient(self) -> np.ndarray:
        """By the kernel's, the mean's and the noise's parameters: a'dK a - tr(K^-1 dK), a'dm and sums of (a^2 - K^-1_ii) dv, halved
        where they are quadratic."""
        x = coordinates("x", self.dims)
        both = self.points.select(F.col("pt_id").alias("i"), "x").join(self.model.inverse_diagonal(), "i")
        by_mean, by_noise = self.slopes[0](x, self.theta), self.slopes[1](x, self.phi)
        wanted = [F.sum(F.col("alpha") * d) for d in by_mean] + [0.5 * F.sum((F.col("alpha") * F.col("alpha") - F.col("inverse")) * d) for d in by_noise]
        sums = both.agg(*[c.alias(f"s{k}") for k, c in enumerate(wanted)]).first() if wanted else []
        return np.array([*self.model.likelihood_gradient(), *[v or 0.0 for v in sums]])

    def predict(self, queries: DataFrame, id_col: str = "pred_id", add_noise: bool = False) -> DataFrame:
        """(id, m, v) of every row of ``queries`` (id, x), ids distinct."""
        x = coordinates("x", self.dims)
        got = self.model.predict(queries, id_col)
        own = queries.select(F.col(id_col).alias("_id"), self.forms[0](x, self.theta).alias("_m"), (self.forms[1](x, self.phi) if add_noise else F.lit(0.0)).alias("_v"))
        return got.join(own, F.col(id_col) == F.col("_id")).select(id_col, (F.col("m") + F.col("_m")).alias("m"), (F.col("v") + F.col("_v")).alias("v"))
