"""Points that arrive as a stream: running moments, and scores of a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krigora.operators.gp import GaussianProcess


def window_moments(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and variance of every window; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")).select(F.col("window.start").alias("start"), "n", "mean", "variance")


def scored(stream: DataFrame, model: GaussianProcess, id_col: str = "pred_id") -> DataFrame:
    """Mean and variance of the model at every arriving point."""
    return model.predict(stream, id_col)
