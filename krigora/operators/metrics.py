"""Validation metrics: aggregates over rows of observed value, predicted mean and predicted variance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gp import z_value

#: Coefficients of a rational form of the normal distribution function in double precision, highest power first.
NORMAL_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    a = F.least(F.abs(z), F.lit(37.0))
    fraction = lambda c: reduce(lambda s, x: s * a + x, c[1:], F.lit(c[0]))
    near = fraction(NORMAL_ABOVE) / fraction(NORMAL_BELOW)
    far = 1.0 / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.exp(-a * a / 2.0) * F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def crps(y: Column, m: Column, v: Column) -> Column:
    """Continuous ranked probability score of a Gaussian at a value."""
    s = F.sqrt(v)
    z = (y - m) / s
    return s * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) - 1.0 / math.sqrt(math.pi))


def negative_log_density(y: Column, m: Column, v: Column) -> Column:
    return 0.5 * F.log(2.0 * math.pi * v) + 0.5 * (y - m) * (y - m) / v


def scores(rows: DataFrame, y: str = "y", m: str = "m", v: str = "v", interval: float = 0.95, train: tuple[float, float] | None = None) -> DataFrame:
    """All metrics in one pass over ``rows``; ``train`` (mean, variance of the training targets) adds msll."""
    y_, m_, v_ = F.col(y), F.col(m), F.col(v)
    d, half, alpha = y_ - m_, z_value(interval) * F.sqrt(F.col(v)), 1 - interval
    low, high = m_ - half, m_ + half
    miss = 2 / alpha * (F.greatest(low - y_, F.lit(0.0)) + F.greatest(y_ - high, F.lit(0.0)))
    out = [
        F.avg(crps(y_, m_, v_)).alias("crps"), F.stddev_pop(crps(y_, m_, v_)).alias("crps_std"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.sqrt(F.avg(d * d)) / (F.max(y_) - F.min(y_))).alias("nrmse"), F.avg(negative_log_density(y_, m_, v_)).alias("nlpd"),
        (1.0 - F.sum(d * d) / (F.var_pop(y_) * F.count(y_))).alias("r2"), F.avg(((y_ >= low) & (y_ <= high)).cast("double")).alias("picp"),
        F.avg(2.0 * half).alias("mpiw"), F.avg(2.0 * half + miss).alias("interval_score"), F.avg(F.abs(d)).alias("mae"), F.avg(F.abs(d / y_)).alias("mape"),
    ]
    if train:
        out.append(F.avg(negative_log_density(y_, m_, v_) - negative_log_density(y_, F.lit(train[0]), F.lit(train[1]))).alias("msll"))
    return rows.agg(*out)


def coverage_curve(rows: DataFrame, levels: int = 19, y: str = "y", m: str = "m", v: str = "v") -> DataFrame:
    """(level, coverage) at equally spaced levels, in one pass: a row is inside every interval from its own central level on."""
    own = 2.0 * normal_cdf(F.abs(F.col(y) - F.col(m)) / F.sqrt(v)) - 1.0
    at = [round((k + 1) / (levels + 1), 10) for k in range(levels)]
    counts = rows.agg(*[F.avg((own <= p).cast("double")).alias(f"c{k}") for k, p in enumerate(at)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"c{k}").alias("coverage")) for k, p in enumerate(at)])).alias("r")).select("r.*")
