"""Covariance functions, written once for Spark columns and for NumPy arrays.

``m`` names the mathematics: ``COLUMN`` (the default) builds expressions that stay in generated code, ``NUMPY`` evaluates the
same formula on arrays for the small dense blocks that are factorised.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

COLUMN = SimpleNamespace(exp=F.exp, log=F.log, sqrt=F.sqrt, sin=F.sin, abs=F.abs, low=lambda x, c: F.least(x, F.lit(c)), high=lambda x, c: F.greatest(x, F.lit(c)), pick=lambda c, a, b: F.when(c, a).otherwise(b))
NUMPY = SimpleNamespace(exp=np.exp, log=np.log, sqrt=np.sqrt, sin=np.sin, abs=np.abs, low=np.minimum, high=np.maximum, pick=np.where)


def squared_exponential(d, length, m=COLUMN):
    return m.exp(-(d * d) / (2.0 * length**2))


def squared_exponential_robust(d, phi, m=COLUMN):
    return m.exp(-(d * d) * phi**2)


def exponential(d, length, m=COLUMN):
    return m.exp(-d / length)


def exponential_robust(d, phi, m=COLUMN):
    return m.exp(-d * phi**2)


def matern_3_2(d, length, m=COLUMN):
    s = d * (3**0.5 / length)
    return (1.0 + s) * m.exp(-s)


def matern_3_2_robust(d, phi, m=COLUMN):
    s = d * (3**0.5 * phi**2)
    return (1.0 + s) * m.exp(-s)


def matern_3_2_slope(d, d_slope, m=COLUMN):
    """Change of the unit-length Matern-3/2 along a parameter that changes the distance by ``d_slope``."""
    return d * d_slope * -3.0 * m.exp(d * -(3**0.5))


def matern_5_2(d, length, m=COLUMN):
    s = d * (5**0.5 / length)
    return (1.0 + s + s * s / 3.0) * m.exp(-s)


def matern_5_2_robust(d, phi, m=COLUMN):
    """With the factor 3 phi^4 multiplied, not divided: results must equal those of existing models."""
    s = d * (5**0.5 * phi**2)
    return (1.0 + s + d * d * (5.0 * 3.0 * phi**4)) * m.exp(-s)


def sparse_log(d, radius, m=COLUMN):
    """Compact support in logarithmic form; zero distance counts as 1e-5."""
    r = m.low(m.pick(d == 0.0, 1e-5, d) / radius, 1.0)
    root = m.sqrt(1.0 - r * r)
    return (2.0**0.5 / (3.0 * np.pi**0.5)) * (3.0 * r * r * m.log(r / (1.0 + root)) + (2.0 * r * r + 1.0) * root)


def periodic(d, length, period, m=COLUMN):
    s = m.sin(d * (np.pi / period))
    return m.exp(s * s * (-2.0 / length**2))


def linear(a, b, offset, slope, centre, m=COLUMN):
    return offset + slope * ((a - centre) * (b - centre))


def polynomial(dot, power, m=COLUMN):
    return (1.0 + dot) ** power


def wendland(d, m=COLUMN):
    """Compact support: zero from distance 1 on."""
    d = m.low(d, 1.0)
    return (1.0 - d) ** 8 * (32.0 * d * d * d + 25.0 * d * d + 8.0 * d + 1.0)


def bump(d, radius, beta=1.0, amplitude=1.0, m=COLUMN):
    a = 1.0 - (d * d) / radius**2
    return m.pick(a > 0.0, amplitude * m.exp(beta - beta / m.pick(a > 0.0, a, 1.0)), 0.0)


def radial_sum(x, centres, weights, width, m=COLUMN):
    """Weighted radial bases at a point; products of two give the rank-one non-stationary kernel."""
    terms = [w * m.exp(-squared_distance(x, c, [1.0] * len(c)) / width) for c, w in zip(centres, weights, strict=True)]
    return reduce(add, terms)


def radial_sum_slopes(x, centres, weights, width, m=COLUMN):
    """Derivatives of ``radial_sum`` by each weight, then by the width."""
    d2 = [squared_distance(x, c, [1.0] * len(c)) for c in centres]
    bases = [m.exp(-d / width) for d in d2]
    return [*bases, reduce(add, [w * e * d / width**2 for w, e, d in zip(weights, bases, d2, strict=True)])]


def non_stationary_slopes(a, b, centres, weights, width, m=COLUMN):
    """Derivatives of the non-stationary kernel by each weight, then by the width: the product rule on its two factors."""
    ga, gb = (radial_sum(x, centres, weights, width, m) for x in (a, b))
    return [p * gb + q * ga for p, q in zip(radial_sum_slopes(a, centres, weights, width, m), radial_sum_slopes(b, centres, weights, width, m), strict=True)]


def landmark(a, b, landmarks, hyper, m=COLUMN):
    """Squared exponential over an embedding by bumps around landmarks: hyper = [variance, radius, beta, squared length]."""
    near = lambda x: [bump(distance(x, c, [1.0] * len(c), m), hyper[1], hyper[2], 1.0, m) for c in landmarks]
    gap = reduce(add, [(p - q) * (p - q) for p, q in zip(near(a), near(b), strict=True)])
    return hyper[0] * m.exp(-gap / hyper[3])


def dot_product(a, b, offset, matrix, m=COLUMN):
    """offset + a' M b for a symmetric matrix of numbers."""
    return offset + reduce(add, [p * reduce(add, [w * q for w, q in zip(row, b, strict=True)]) for p, row in zip(a, matrix, strict=True)])


def out_of_bounds(values, bounds, m=COLUMN):
    """Whether any value lies outside its (low, high)."""
    return reduce(lambda p, q: p | q, [(v < low) | (v > high) for v, (low, high) in zip(values, bounds, strict=True)])


def default_kernel_slopes(a, b, hyper):
    """Derivatives of the default kernel's block (arrays of points) by the variance and each length, in closed form."""
    gaps = [(a[:, k][:, None] - b[:, k][None]) ** 2 for k in range(a.shape[1])]
    d = np.sqrt(sum(g / h**2 for g, h in zip(gaps, hyper[1:], strict=True)))
    yield matern_3_2(d, 1.0, NUMPY)
    fall = 3.0 * hyper[0] * np.exp(-(3**0.5) * d)
    for g, h in zip(gaps, hyper[1:], strict=True):
        yield fall * g / h**3


def default_kernel_point_slopes(a, b, hyper):
    """Derivatives of the default kernel's block by each coordinate of the second points, in closed form."""
    yield from default_kernel_along([a[:, k][:, None] for k in range(a.shape[1])], [b[:, k][None] for k in range(b.shape[1])], hyper, NUMPY)


def default_kernel_along(a, b, hyper, m=COLUMN):
    """Derivatives of ``default_kernel`` by each coordinate of the second point."""
    fall = 3.0 * hyper[0] * m.exp(-(3**0.5) * distance(a, b, hyper[1:], m))
    return [fall * (p - q) / h**2 for p, q, h in zip(a, b, hyper[1:], strict=True)]


def squared_distance(a, b, lengths):
    """Sum of ((a_k - b_k) / length_k)^2 of two sequences of columns, arrays or numbers."""
    return reduce(add, [((p - q) / s) * ((p - q) / s) for p, q, s in zip(a, b, lengths, strict=True)])


def distance(a, b, lengths, m=COLUMN):
    return m.sqrt(squared_distance(a, b, lengths))


def default_kernel(a, b, hyper, m=COLUMN):
    """Signal variance times Matern-3/2 over a distance with a length per dimension: hyper = [variance, length, ...]."""
    return hyper[0] * matern_3_2(distance(a, b, hyper[1:], m), 1.0, m)


def normal_density(x, mean, variance, m=COLUMN):
    v = m.high(variance, 1e-12)
    d = x - mean
    return m.exp(-(d * d) / (2.0 * v)) / m.sqrt(2.0 * np.pi * v)


def sorted_profile_distance(a, b):
    """Mean absolute difference of two sorted array columns after each is scaled to sum one."""
    scaled = lambda v: F.transform(v, lambda e: e / F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
    gaps = F.zip_with(F.array_sort(scaled(a)), F.array_sort(scaled(b)), lambda p, q: F.abs(p - q))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a)
