"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_OWN_DIRS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir; unset, one below the warehouse, but only in local mode."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OWN_DIRS:
        atexit.register(_clean)
    _OWN_DIRS.append((spark, path))
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended already; the folder is scratch
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _OWN_DIRS:
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` made and nothing reads any more."""
    _delete(df.sparkSession, df.folder)


def running_total(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all rows that come earlier in ``order``, without a one-task window.

    Rows are dealt to ranges of the order; the totals of the ranges (one row each) are summed first, then each range by itself.
    """
    parts = shuffle_partitions(df.sparkSession)
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))  # at most ``parts`` rows
    ahead = totals.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(ahead), F.col("_range") == F.col("_at")).withColumn("before", F.col("_ahead") + inside).drop("_range", "_at", "_ahead")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; one that lies in fewer splits than there are cores (a small file) is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: The white space of the word rule, [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words in each row (0 for null)."""
    data, off = text_bytes(column)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    start[heads] = inside[heads]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(start, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


#: Rows of a batch that goes to a Python worker: texts are long, and both sides hold a few batches at once.
BATCH_ROWS = 1000


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in small batches; a worker that is done hands its free memory back, as the next stage reuses it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def with_arrow(df: DataFrame, add, columns: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, with columns that ``add(batch) -> list[pa.Array]`` makes from each Arrow batch.

    ``columns`` is the DDL of the added columns; an added name replaces an equal one of ``df``.
    """
    new = T.StructType.fromDDL(columns).fields
    gone = {f.name.lower() for f in new} | {d.lower() for d in drop}
    keep = [(i, f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    schema = T.StructType([f for _, f in keep] + new)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b):
                yield pa.RecordBatch.from_arrays([part.column(i) for i, _ in keep] + list(add(part)), names=names)

    return in_arrow(df, run, schema)


def by_bytes(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes, so that work arrays stay small beside very long texts."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= most:
        yield batch
        return
    half = n // 2
    yield from by_bytes(batch.slice(0, half), most)
    yield from by_bytes(batch.slice(half), most)
