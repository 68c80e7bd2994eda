"""Point tables: pt_id, x (array of doubles), y, and their grids, checks, appends and storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def points(df: DataFrame, key: str, x: Sequence[Column], y: Column | None = None, noise: Column | None = None) -> DataFrame:
    """Columns of any table as points; rows without a key are left out."""
    more = [c.cast("double").alias(n) for n, c in (("y", y), ("noise_var", noise)) if c is not None]
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("pt_id"), F.array(*[c.cast("double") for c in x]).alias("x"), *more)


def coordinates(name: str, dims: int) -> list[Column]:
    return [F.get(F.col(name), k) for k in range(dims)]


def check(pts: DataFrame) -> dict[str, int]:
    """Rows, dimensions, rows with null or NaN values, in one pass; raises if dimensions differ or values are missing."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v)) | (F.col("y").isNull() | F.isnan("y") if "y" in pts.columns else F.lit(False))
    got = pts.agg(F.count("*").alias("rows"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0)).alias("bad")).first()
    if got["rows"] and (got["least"] != got["most"] or got["bad"]):
        raise ValueError(f"points need one dimension and no missing values: {got.asDict()}")
    return {"rows": got["rows"], "dims": got["most"] or 0, "bad": got["bad"]}


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new points with their batch; a noise column can't come or go."""
    if set(old.columns) - {"batch_id"} != set(new.columns) - {"batch_id"}:
        raise ValueError(f"columns differ: {old.columns} and {new.columns}")
    last = old if "batch_id" in old.columns else old.withColumn("batch_id", F.lit(0))
    n = last.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    return last.unionByName(new.drop("batch_id").withColumn("batch_id", F.lit(n + 1)))


def line_grid(spark: SparkSession, low: float, high: float, n: int = 100) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pred_id"), F.array(F.lit(low) + F.col("id") * ((high - low) / max(1, n - 1))).alias("x"))


def plane_grid(spark: SparkSession, low: Sequence[float], high: Sequence[float], nx: int = 100, ny: int = 100) -> DataFrame:
    """Row-major product grid; its size is the product of the two given counts."""
    step = [(high[0] - low[0]) / max(1, nx - 1), (high[1] - low[1]) / max(1, ny - 1)]
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    return spark.range(nx * ny).select(F.col("id").alias("pred_id"), F.array(low[0] + i * step[0], low[1] + j * step[1]).alias("x"))


def unpivot_tasks(df: DataFrame, key: str, x: Sequence[Column], tasks: Sequence[Column]) -> DataFrame:
    """Several outputs as one long point table: the task number is a further coordinate; null and NaN outputs are left out."""
    long = df.select(F.col(key).cast("long").alias("pt_id"), F.array(*[c.cast("double") for c in x]).alias("x"), F.posexplode(F.array(*[c.cast("double") for c in tasks])).alias("task", "y"))
    return long.where(F.col("y").isNotNull() & ~F.isnan("y")).withColumn("x", F.concat("x", F.array(F.col("task").cast("double"))))


def task_grid(pred: DataFrame, n_pred: int, tasks: Sequence[int]) -> DataFrame:
    """Prediction points for every task, numbered task by task."""
    each = pred.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    at = F.array_position(F.array(*[F.lit(t) for t in tasks]), F.col("task")) - 1
    return each.select((F.col("pred_id") + at * n_pred).alias("flat_id"), "pred_id", "task", F.concat("x", F.array(F.col("task").cast("double"))).alias("x"))


def histogram_density(df: DataFrame, station: str, value: str, low: float, high: float, bins: int = 120) -> DataFrame:
    """Per station a density on equal bins, each at least 1e-12 before it is scaled to integrate to one."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(station).alias("station"), at.alias("bin")).agg(F.count("*").alias("n"))
    full = counts.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"), F.sum("n").alias("total"))
    dens = full.select("station", "total", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.greatest(F.coalesce(F.try_element_at("by_bin", b), F.lit(0)) / (F.col("total") * width), F.lit(1e-12)))).alias("bin", "raw"))
    from pyspark.sql import Window as W

    return dens.select("station", "bin", (low + (F.col("bin") + 0.5) * width).alias("at"), (F.col("raw") / (F.sum("raw").over(W.partitionBy("station")) * width)).alias("density"))
