"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal bytes.

Rows near each other on the curve agree in all the quantised columns at once, so a shard (and a Parquet row group in it)
spans a small box of the metadata space and filters on any of the columns prune files.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import running_total, shuffle_partitions, with_arrow, written

#: Most distinct values of a column whose quantiles are taken on the driver.
FEW_VALUES = 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points, one per row (Skilling's transpose form, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cuts(df: DataFrame, name: str, bits: int) -> list:
    """At most 2**bits - 1 distinct quantiles of a column: of numbers approximate, of strings exact (by code point)."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        got = df.select(F.percentile_approx(F.nanvl(c.cast("double"), F.lit(None)), shares, 10_000)).first()[0]
        return sorted(set(got or []))
    values = written(df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n")), "curve-values")
    few = values.limit(FEW_VALUES + 1).collect()
    total = sum(r["n"] for r in few)
    if len(few) <= FEW_VALUES:
        few.sort(key=lambda r: r["value"].encode())
        upto = list(accumulate(r["n"] for r in few))
        return [few[k]["value"] for k in sorted({bisect_left(upto, share * total) for share in shares if few})]
    counted = running_total(values, ["value"], "n")
    total = counted.agg(F.sum("n")).first()[0]
    upto = F.col("before") + F.col("n")
    at = [F.min(F.when(upto >= F.lit(share * total), F.col("value"))).alias(f"q{k}") for k, share in enumerate(shares)]
    return sorted({v for v in counted.agg(*at).first() if v is not None}, key=lambda v: v.encode())


def curve_cells(df: DataFrame, dims: tuple[str, ...], bits: int) -> list[Column]:
    """Cell of each dimension: how many of at most 2**bits - 1 distinct quantiles of all rows lie at or below it (null: 0).

    Whole values are compared, so strings that begin alike are told apart."""
    out = []
    for d in dims:
        c = F.col(f"`{d}`")
        c = c if isinstance(df.schema[d].dataType, T.StringType) else F.nanvl(c.cast("double"), F.lit(None))
        out.append(sum((F.when(c >= F.lit(v), 1).otherwise(0) for v in _cuts(df, d, bits)), F.lit(0)).cast("long"))
    return out


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), n_shards: int = 8, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", whole: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve (the Hilbert index) of every row.

    The law is ``bytes``: with sizes (UTF-8 bytes plus 1; null text: none) summed along the curve, a document belongs to the
    shard in whose share the middle of its bytes falls, so shards differ by about one document. Equal texts lie together, in
    the curve cell of the one with the smallest id, and go to one shard by the middle of their group unless the group holds
    more than ``whole`` of a shard's share; then it is cut by rows. Within a cell groups follow a hash of the text, rows of a
    group a hash of the id and the id; equal rows come in any order. Null metadata fall into cell 0; missing columns of
    ``dims`` are left out; other columns are ignored, whatever their names. Cells (at most 2**16) and large groups are cut by
    hash into ranges of bounded size, so that one with a third of all rows is no hot key. An empty table gives no rows.
    """
    spark = docs.sparkSession
    dims = tuple(d for d in dims if d in docs.columns)
    if bits * len(dims) > 16:
        raise ValueError(f"{bits} bits of {len(dims)} dimensions make more than 2**16 cells; take fewer bits")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), *[c.alias(f"d{i}") for i, c in enumerate(curve_cells(docs, dims, bits))])
    k = len(dims)
    slim = with_arrow(slim, lambda b: [pa.array(hilbert_index(np.stack([b.column(4 + i).to_numpy() for i in range(k)], 1), bits) if k else np.zeros(b.num_rows, np.int64))], "own_curve long", drop=tuple(f"d{i}" for i in range(k)))
    slim = written(slim.withColumn("tie", F.xxhash64("doc_id", "text_crc32")), "curve-rows")
    all_bytes, all_rows = (x or 0 for x in slim.agg(F.sum("size"), F.count("*")).first())
    # Ranges of a cell: about a quarter of a task's fair share of rows, a million at most.
    each = max(1, min(1_000_000, all_rows // (4 * shuffle_partitions(spark))))
    groups = slim.groupBy("same").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own_curve"))["own_curve"].alias("curve")).where("copies > 1")
    groups = groups.select(F.col("same").alias("group"), "curve", F.when(F.col("copies") > each, F.col("same")).alias("large"))
    slim = slim.join(groups, F.col("same") == F.col("group"), "left").withColumn("curve", F.coalesce("curve", "own_curve")).withColumn("large", F.coalesce("large", F.lit(0)))
    slim = written(slim.drop("group", "own_curve"), "curve-groups")
    # At most 2**16 cells and all_rows / each large groups.
    cells = slim.groupBy("curve", "large").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    along = W.orderBy("curve", "large").rowsBetween(W.unboundedPreceding, -1)
    cells = written(cells.select("curve", "large", F.ceil(F.col("rows") / each).alias("ranges"), F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("cell_bytes"), F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("cell_rows")), "curve-cells")
    by = F.when(F.col("large") == 0, F.xxhash64("same")).otherwise(F.xxhash64("tie"))
    rows = slim.join(F.broadcast(cells), ["curve", "large"]).withColumn("range", F.pmod(F.shiftright(by, 16), F.col("ranges")))
    totals = rows.groupBy("curve", "large", "range", "cell_bytes", "cell_rows").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    inside = W.partitionBy("curve", "large").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("curve", "large", "range", (F.col("cell_bytes") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("range_bytes"), (F.col("cell_rows") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).alias("range_rows"))
    spot = W.partitionBy("curve", "large", "range")
    order, group = spot.orderBy("same", "tie", "doc_id", "text_crc32", "size"), W.partitionBy("curve", "large", "range", "same")
    before = F.col("range_bytes") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("curve", "large", "range", "doc_id", "size", "text_crc32", "same", "tie").join(starts, ["curve", "large", "range"])
    placed = placed.select("*", before.alias("before"), (F.col("range_rows") + F.row_number().over(order) - 1).alias("place"))
    placed = placed.select("*", F.sum("size").over(group).alias("group_bytes"), F.min("before").over(group).alias("group_before"))
    kept = (F.col("large") == 0) & (F.col("group_bytes") * n_shards <= whole * all_bytes)
    middle = F.when(kept, F.col("group_before") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2) * n_shards / max(all_bytes, 1)
    placed = written(placed.select("doc_id", "size", "text_crc32", "curve", F.least(F.floor(middle), F.lit(n_shards - 1)).cast("int").alias("shard"), "place"), "curve-placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # n_shards rows
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
