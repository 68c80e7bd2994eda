"""Hard-negative mining: scores along a spanning tree of anchors, bounded by edge lengths and candidate norms.

A score is an integer inner product. For an anchor a with parent p in the tree, |<a, c> - <p, c>| <= |a - p| |c|, so what is known
of a candidate at the parent (a score, or bounds of it) bounds it at the child, and only candidates whose bounds overlap the
child's window are scored there. Anchors lie in blocks of near ones, each with its shortest tree; blocks go to all tasks in waves
of bounded size, and every task streams its candidates past them. First a sixteenth of the rows is scored, which gives each
window a lower end that the full pass may not fall below; it decides how much is scored, never what is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, shuffle_partitions, written

#: Anchors of a block (one tree), blocks of a wave (one broadcast: about 64 kB for each of them at 64 dimensions, twice in transit).
BLOCK_ANCHORS, WAVE_BLOCKS = 256, 96
#: The share of rows whose scores give the windows their first lower ends.
FIRST_SHARE = 16
#: No score lies below it.
LOWEST = -(1 << 62)
_BLOCK = "number long, dim int, n int, ids binary, labels binary, vectors binary, parents binary, edges binary"
_FOUND = "block long, anchor int, anchor_id long, own long, score long, vec_id long"


def shortest_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, parent, edge: rows of ``x`` parents first; parent (place in the order, -1 for the root) and distance to it."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    square = (x * x).sum(1)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    near, via, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at = root
    for k in range(n):
        order[k], done[at] = at, True
        if k:
            parent[k], edge[k] = via[at], np.sqrt(((x[at] - x[order[via[at]]]) ** 2).sum())
        d = np.maximum(square + square[at] - 2 * (x @ x[at]), 0)
        closer = d < near
        near[closer], via[closer] = d[closer], k
        at = int(np.where(done, np.inf, near).argmin())
    return order, parent, edge


def _vectors(column: pa.Array, rows: int, scale: float) -> np.ndarray:
    """floor(scale * x) of the rows as doubles, which are whole numbers."""
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of one whole-number row with many."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(a)) < 2.0**53:
        return (x @ a).astype(np.int64)
    return x.astype(np.int64) @ a.astype(np.int64)


class Block:
    """A tree of anchors, parents first. ``ends`` are the upper ends of each anchor's windows (one row an anchor), ``lows`` the
    least score that any of them takes and ``low_ids`` the largest id that it takes there."""

    def __init__(self, row, ends: np.ndarray, lows: np.ndarray, low_ids: np.ndarray) -> None:
        self.number, self.n = row["number"], row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], float).reshape(self.n, row["dim"])
        self.parents, self.edges = np.frombuffer(row["parents"], np.int64), np.frombuffer(row["edges"], float)
        self.ends, self.lows, self.low_ids = ends, lows.copy(), low_ids.copy()
        self.own = np.array([int(products(v, v[None])[0]) for v in self.vectors])
        self.sizes = np.sqrt((self.vectors**2).sum(1))
        self.kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * self.n
        self.scored = 0

    def scan(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, most: int) -> None:
        """Takes a block of candidates past all anchors: those of an anchor's label (``same``) or of the others. Keeps what comes
        first, ``most`` rows below each upper end, and narrows the windows by it."""
        reach = np.sqrt((x * x).sum(1)) * (1 + 1e-9)
        below, above = np.empty((self.n, len(x))), np.empty((self.n, len(x)))
        for k in range(self.n):
            p = self.parents[k]
            step = (self.sizes[k] if p < 0 else self.edges[k]) * reach + 1e-6  # the root is bounded by its own length
            np.subtract(below[p] if p >= 0 else 0.0, step, out=below[k])
            np.add(above[p] if p >= 0 else 0.0, step, out=above[k])
            high = self.ends[k].max()
            open_to = (labels == self.labels[k]) if same else (labels != self.labels[k])
            at = np.flatnonzero(open_to & (above[k] >= self.lows[k]) & (below[k] <= high))
            if not len(at):
                continue
            s = products(self.vectors[k], x[at])
            self.scored += len(at)
            below[k, at] = above[k, at] = s
            stay = ((s > self.lows[k]) | ((s == self.lows[k]) & (ids[at] <= self.low_ids[k]))) & (s <= high)
            if stay.any():
                self._keep(k, s[stay], ids[at[stay]], most)

    def _keep(self, k: int, score: np.ndarray, ids: np.ndarray, most: int) -> None:
        if self.kept[k] is not None:
            score, ids = np.concatenate([self.kept[k][0], score]), np.concatenate([self.kept[k][1], ids])
        order = np.lexsort([ids, -score])
        score, ids = score[order], ids[order]
        stay, last, full = np.zeros(len(score), bool), 0, True
        for first in np.searchsorted(-score, -self.ends[k], "left"):  # the first row at or below an upper end
            stay[first : first + most] = True
            last, full = max(last, first + most - 1), full and first + most <= len(score)
        if full:  # every window has its rows, so nothing that comes after the last of them matters
            self.lows[k], self.low_ids[k] = score[last], ids[last]
        self.kept[k] = score[stay], ids[stay]

    def found(self) -> pa.RecordBatch:
        sizes = [0 if kept is None else len(kept[0]) for kept in self.kept]
        some = [kept for kept in self.kept if kept is not None]
        score, ids = (np.concatenate([k[j] for k in some]) if some else np.zeros(0, np.int64) for j in (0, 1))
        columns = [np.full(len(score), self.number), np.repeat(np.arange(self.n, dtype=np.int32), sizes), np.repeat(self.ids, sizes), np.repeat(self.own, sizes), score, ids]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "anchor", "anchor_id", "own", "score", "vec_id"])


def _anchor_blocks(scale: float, per_block: int):
    """Arrow batches (vec_id, label, vector), sorted so that near anchors are neighbours -> blocks of up to ``per_block``."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, x = (np.array(c) for c in zip(*held, strict=True))
        order, parent, edge = shortest_tree(x)
        columns = [c.tobytes() for c in (ids[order], labels[order], x[order], parent, edge)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([x.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                row = (one.column(0)[0].as_py(), one.column(1)[0].as_py(), _vectors(one.column(2), 1, scale)[0])
                if held and (len(held) == per_block or len(held[-1][2]) != len(row[2])):
                    yield block(number, held)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block(number, held)

    return run


def _near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``key``: the signs of 12 random projections, so that sorting brings near anchors together."""
    for b in batches:
        sizes = b.column(2).value_lengths().to_numpy()
        key = np.zeros(b.num_rows, np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = _vectors(b.column(2).take(pa.array(at)), len(at), 4096.0)
            key[at] = (x @ np.random.default_rng([11, dim]).normal(size=(dim, 12)) > 0) @ (1 << np.arange(12))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(key)], names=["vec_id", "label", "vector", "dim", "key"])


def _search(sent, scale: float, same: bool, most: int):
    """Arrow batches (vec_id, label, vector) -> what lies in the windows of the anchors in ``sent``: (row, ends, lows, low_ids) a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(*b) for b in sent.value]
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim)) if (sizes != dim).any() else b
                ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _vectors(part.column(2), part.num_rows, scale)
                for block in blocks:
                    if block.vectors.shape[1] == dim:
                        block.scan(ids, labels, x, same, most)
        for block in blocks:
            yield block.found()

    return run


_KEY = ["block", "anchor"]


def _lows_of(blocks: list, thresholds: list, lows: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lows, low_ids) of each block: the thresholds (block, anchor, score, vec_id) where there are some, else ``lows`` with any id."""
    at = {r["number"]: k for k, r in enumerate(blocks)}
    out = [(lows[r["number"]].copy() if lows else np.full(r["n"], LOWEST), np.full(r["n"], np.iinfo(np.int64).max)) for r in blocks]
    for r in thresholds:
        out[at[r["block"]]][0][r["anchor"]], out[at[r["block"]]][1][r["anchor"]] = r["score"], r["vec_id"]
    return out


def _mine(rows: DataFrame, blocks: list, scale: float, positives: int, negatives: int, low: float, high: float) -> DataFrame:
    """The result for one wave of anchors: positives first, as their scores are the windows of the negatives."""
    spark = rows.sparkSession
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(FIRST_SHARE)) == 0)

    def search(part: DataFrame, ends: list, lows: list, same: bool, most: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r, e, *l) for r, e, l in zip(blocks, ends, lows, strict=True)])
        return in_arrow(part, _search(sent, scale, same, most), _FOUND)

    # One more than wanted: the anchor itself may be among them.
    whole = [np.full((r["n"], 1), -LOWEST) for r in blocks]
    ranked = lambda df: df.withColumn("r", F.row_number().over(W.partitionBy(*_KEY).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= positives + 1)
    first = ranked(search(some, whole, _lows_of(blocks, []), True, positives + 1)).where(F.col("r") == positives + 1).select(*_KEY, "score", "vec_id").collect()  # a row an anchor of the wave
    near = ranked(search(rows, whole, _lows_of(blocks, first), True, positives + 1))
    itself = F.min(F.when((F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(W.partitionBy(*_KEY))
    near = near.withColumn("itself", itself).where("itself IS NULL OR r <> itself").withColumn("place", F.col("r") - F.when(F.col("r") > F.col("itself"), 1).otherwise(0)).where(F.col("place") <= positives)
    near = written(near.select(*_KEY, "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where(f"{low} * positive_score <= {high} * positive_score"), "anchor-positives")
    ends = {r["number"]: np.full((r["n"], positives), LOWEST) for r in blocks}
    lows = {r["number"]: np.full(r["n"], -LOWEST) for r in blocks}
    for r in near.collect():  # a few rows an anchor of the wave
        ends[r["block"]][r["anchor"], r["place"] - 1] = high * r["positive_score"] // 100
        lows[r["block"]][r["anchor"]] = min(lows[r["block"]][r["anchor"]], -(-low * r["positive_score"] // 100))
    ends = [ends[r["number"]] for r in blocks]

    def windows(found: DataFrame) -> DataFrame:
        both = found.join(near, _KEY).where(f"{low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score")
        return both.withColumn("rank", F.row_number().over(W.partitionBy(*_KEY, "place").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= negatives)

    # Where every positive of an anchor has its negatives among the first rows, the last of them bounds what the others may add.
    filled = windows(search(some, ends, _lows_of(blocks, [], lows), False, negatives)).where(F.col("rank") == negatives)
    last = filled.groupBy(*_KEY).agg(F.count("*").alias("filled"), F.min(F.struct("score", (-F.col("vec_id")).alias("back"))).alias("last"))
    first = last.join(near.groupBy(*_KEY).agg(F.count("*").alias("all")), _KEY).where("filled = all").select(*_KEY, "last.score", (-F.col("last.back")).alias("vec_id")).collect()
    got = windows(search(rows, ends, _lows_of(blocks, first, lows), False, negatives))
    return got.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", one_in: int = 50, positives: int = 5, negatives: int = 3, scale: float = 256.0, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``one_in``. Components x become floor(scale * x); scores are inner products,
    higher ones first and ties by the smaller id. For an anchor and each of its first ``positives`` other rows of its label
    come the first ``negatives`` rows of other labels with ``low`` to ``high`` per cent of the positive's score (whole numbers).

    Rows with a null id, a null label, a null or empty vector or a null or non-finite component take no part. Vectors of
    another length than the anchor's are not its candidates. Repeated rows are rows each, so an anchor's twin may be its
    positive. Scores must fit 64 bits. An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = written(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(whole, F.lit(False))), "labelled-vectors")
    anchors = rows.where(F.col("vec_id") % one_in == 0)
    keyed = in_arrow(anchors, _near_first, T.StructType([*anchors.schema, *T.StructType.fromDDL("dim int, key long")]))
    near = keyed.repartitionByRange(shuffle_partitions(spark), "dim", "key", "vec_id").sortWithinPartitions("dim", "key", "vec_id")
    blocks = written(in_arrow(near.select("vec_id", "label", "vector"), _anchor_blocks(scale, BLOCK_ANCHORS), _BLOCK), "anchor-blocks")
    waves = -(-blocks.count() // WAVE_BLOCKS)
    out = []
    for w in range(waves):
        some = blocks.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == w).collect()
        if some:
            out.append(written(_mine(rows, some, scale, positives, negatives, low, high), "hard-negatives").folder)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
"""
