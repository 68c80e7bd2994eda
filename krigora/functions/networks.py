"""Small rectifier networks that move coordinates before a covariance is taken: three layers, as columns and on arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Network:
    """``dims`` coordinates to ``out`` (as many by default) through two hidden layers of ``width`` units.

    Parameters are one sequence: the weights of the layers, each by rows, then their biases. Hidden layers are rectified, the last
    one where ``rectify_last`` is set.
    """

    def __init__(self, dims: int, width: int, out: int | None = None, rectify_last: bool = False) -> None:
        self.dims, self.out = dims, out or dims
        self.shapes = [(width, dims), (width, width), (self.out, width)]
        self.rectified = (True, True, rectify_last)
        self.size = sum(a * b + a for a, b in self.shapes)

    def split(self, parameters: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and biases of every layer."""
        p = np.asarray(parameters, float)
        if len(p) != self.size:
            raise ValueError(f"{len(p)} parameters, not {self.size}")
        ends = np.cumsum([a * b for a, b in self.shapes] + [a for a, _ in self.shapes])
        parts = np.split(p, ends[:-1])
        return [(parts[k].reshape(s), parts[k + 3]) for k, s in enumerate(self.shapes)]

    def start(self, seed: int = 0) -> np.ndarray:
        """Random weights of a size that keeps the spread from layer to layer, biases zero."""
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(0, (2 / b) ** 0.5, a * b) for a, b in self.shapes] + [np.zeros(a) for a, _ in self.shapes])

    def column(self, x: Column, parameters: Sequence[float]) -> Column:
        """The moved coordinates of an array column; nulls where the point or a coordinate is null or missing. Every layer is bound
        once, whatever the number of units that read it."""
        for (w, b), rectified in zip(self.split(parameters), self.rectified, strict=True):
            x = _layer(x, w, b, rectified)
        return x

    def _layers(self, x: np.ndarray, parameters: Sequence[float]) -> list[np.ndarray]:
        out = [x]
        for (w, b), rectified in zip(self.split(parameters), self.rectified, strict=True):
            z = out[-1] @ w.T + b
            out.append(np.maximum(z, 0.0) if rectified else z)
        return out

    def __call__(self, x: np.ndarray, parameters: Sequence[float]) -> np.ndarray:
        return self._layers(x, parameters)[-1]

    def slopes(self, x: np.ndarray, outer: np.ndarray, parameters: Sequence[float]) -> np.ndarray:
        """Slopes by the parameters of a quantity whose slopes along the moved coordinates of each point are ``outer``."""
        layers, weights, biases = self._layers(x, parameters), [], []
        for k, (w, _) in reversed(list(enumerate(self.split(parameters)))):
            if self.rectified[k]:
                outer = outer * (layers[k + 1] > 0)
            weights.append((outer.T @ layers[k]).ravel())
            biases.append(outer.sum(0))
            outer = outer @ w
        return np.concatenate(weights[::-1] + biases[::-1])


def _layer(x: Column, w: np.ndarray, b: np.ndarray, rectified: bool) -> Column:
    def units(v: Column) -> Column:
        sums = [reduce(add, [F.get(v, j) * float(s) for j, s in enumerate(row)]) + float(c) for row, c in zip(w, b, strict=True)]
        # greatest() would turn the nulls of odd points into zeros
        return F.transform(F.array(*sums), lambda s: F.when(s < 0, 0.0).otherwise(s)) if rectified else F.array(*sums)

    return F.get(F.transform(F.array(x), units), 0)
