"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import json
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: short lineage, and nothing is lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_clean)
    _OWN.append((df.sparkSession, path))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def in_batches(df: DataFrame, run, schema: str, rows: int = 100) -> DataFrame:
    """``df.mapInPandas`` for rows that hold matrices: few of them are in memory at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInPandas(run, schema)


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended already; the folder is scratch
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _OWN:
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` made and nothing reads any more."""
    _delete(df.sparkSession, df.folder)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_model(spark: SparkSession, path: str, points: DataFrame, state: dict) -> None:
    """Points as Parquet and the rest of a model as one JSON row beside them."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/points"), json.loads(spark.read.text(f"{path}/state").first()[0])


def cached(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``path`` for ``key`` (what the table hangs on), built and written there when it is missing."""
    folder = f"{path}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
