"""Exact Gaussian processes with any kernel on more points than one machine factorises: a Cholesky factor in tiles.

Points are dealt to blocks; a tile is the covariance of two blocks, one row of a table. Each step factorises one diagonal tile,
solves the tiles below it and updates the others, all of a step at once. The targets, and for predictions the unit matrix, are
further block rows of the same elimination: they become the solution's coefficients and the inverse triangle W, once for a model.
Predictions then pass over the points asked for, with a slab of W's rows of bounded size at a time; nothing as long as those
points is shuffled but the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.sources.places import Places
from krigora.sources.store import discard, in_batches, written

from . import linalg as L

_PART = "of long, rows int, columns int, tile binary"
_TILE = "i long, j long, rows int, columns int, tile binary"
#: Tiles in memory at once, and bytes of W's rows that go to all tasks at once.
TILE_ROWS, SLAB_BYTES = 4, 64 << 20


def _matrix(raw: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(rows, columns)


class TiledGaussianProcess:
    """``points`` (pt_id, x, y[, noise_var]), hyper = [variance, length per dimension], constant prior mean; tiles of about ``size``.

    Points of equal coordinates are one place; ``points`` may be places already.
    """

    def __init__(self, points: DataFrame | Places, hyper: Sequence[float], kernel: Callable = K.default_kernel, mean: float | None = None, size: int = 1000) -> None:
        places = Places.of(points, mean=mean)
        self.spark, self.kernel, self.hyper, self.n = places.table.sparkSession, kernel, list(map(float, hyper)), places.n
        self.mean, self.follows, self.spare = places.mean, mean is None, (places.logdet, places.square)
        self.blocks, self.size = max(1, -(-places.count // size)), size
        rows = places.table.select(F.pmod(F.xxhash64("pt_id"), F.lit(self.blocks)).alias("block"), F.struct("pt_id", "x", (F.col("y") - self.mean).alias("r"), F.col("noise_var").alias("noise")).alias("p"))
        # One row per block of about ``size`` points.
        self.rows = written(rows.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("pts")), "tile-blocks")
        self.logdet = self.quadratic = self._inverse = None

    def _tiles(self, inverse: bool) -> DataFrame:
        """Tiles i >= j of K + V, the targets as block row ``blocks``, and beyond it the unit matrix where ``inverse`` is asked for
        (of its block rows only what can become other than zero)."""
        hyper, kernel, targets = self.hyper, self.kernel, self.blocks
        last = F.lit(self.blocks).cast("long")
        own = self.rows.select(F.col("block").alias("j"), F.col("pts").alias("own"))
        wanted = own.withColumn("i", F.explode(F.sequence(F.col("j"), last)))
        if inverse:
            wanted = wanted.unionByName(own.withColumn("i", F.explode(F.sequence(last + 1, last + 1 + F.col("j")))))
        others = self.rows.select(F.col("block").alias("i"), F.col("pts").alias("other"))
        if inverse:
            others = others.unionByName(self.rows.select((F.col("block") + last + 1).alias("i"), F.col("pts").alias("other")))
        pairs = wanted.join(others, "i", "left")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for r in part.itertuples():
                    if r.i == targets:
                        k = np.array([[p["r"] for p in r.own]], float)
                    elif r.i > targets:
                        k = np.eye(len(r.own)) if r.i - targets - 1 == r.j else np.zeros((0 if r.other is None else len(r.other), len(r.own)))
                    else:
                        a, b = (np.array([p["x"] for p in pts], float) for pts in (r.other, r.own))
                        k = kernel([a[:, d][:, None] for d in range(a.shape[1])], [b[:, d][None] for d in range(b.shape[1])], hyper, K.NUMPY)
                        if r.i == r.j:
                            k = k + np.diag([p["noise"] for p in r.own])
                    out.append((r.i, r.j, *k.shape, np.ascontiguousarray(k).tobytes()))
                yield pd.DataFrame(out, columns=["i", "j", "rows", "columns", "tile"])

        dealt = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "i", "j")
        return written(in_batches(dealt, run, _TILE, TILE_ROWS), "tiles")

    def _eliminate(self, inverse: bool = False) -> DataFrame:
        """Tiles of the factor's rows of the targets and of the unit matrix; sets the log-determinant on the way."""
        tiles, logdet, kept = self._tiles(inverse), 0.0, []
        for k in range(self.blocks):
            panel = tiles.where(F.col("j") == k)

            def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for r in part.itertuples():
                        low = L.cholesky(_matrix(r.tile, r.rows, r.columns))
                        yield pd.DataFrame({"w": [L.lower_inverse(low).tobytes()], "logdet": [L.logdet(low)]})

            corner = written(in_batches(panel.where(F.col("i") == k), invert, "w binary, logdet double", TILE_ROWS), "tile-corner")
            own = corner.agg(F.sum("logdet")).first()[0]
            if own is None:  # a block without points
                continue
            logdet += own

            def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    part["tile"] = [(_matrix(r.tile, r.rows, r.columns) @ _matrix(r.w, r.columns, r.columns).T).tobytes() for r in part.itertuples()]
                    yield part.drop(columns="w")

            # One tile is broadcast.
            below = panel.where(F.col("i") > k).join(F.broadcast(corner.select("w")), how="cross")
            solved = written(in_batches(below, solve, _TILE, TILE_ROWS), "tile-panel")
            kept.append(solved.where(F.col("i") >= self.blocks))
            if k == self.blocks - 1:
                break

            def update(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    part["tile"] = [r.tile if r.a is None else (_matrix(r.tile, r.rows, r.columns) - _matrix(r.a, r.rows, r.inner) @ _matrix(r.b, r.columns, r.inner).T).tobytes() for r in part.itertuples()]
                    yield part.drop(columns=["a", "b", "inner"])

            a = solved.select("i", F.col("tile").alias("a"), F.col("columns").cast("double").alias("inner"))
            b = solved.where(F.col("i") < self.blocks).select(F.col("i").alias("j"), F.col("tile").alias("b"), F.col("columns").alias("inner"))
            # Block rows of the unit matrix that begin further right have no tile in this panel and stay as they are.
            met = tiles.where(F.col("j") > k).join(a.drop("inner"), "i", "left").join(b, "j").select("i", "j", "rows", "columns", "tile", "a", "b", "inner")
            older, tiles = tiles, written(in_batches(met, update, _TILE, TILE_ROWS), "tiles")
            discard(older)
        out = kept[0]
        for more in kept[1:]:
            out = out.unionByName(more)
        self.logdet = logdet + self.spare[0]
        return out

    def log_likelihood(self) -> float:
        if self.quadratic is None:
            self.quadratic = self._square(self._eliminate())
        return float(-0.5 * (self.quadratic + self.logdet + self.n * np.log(2 * np.pi)))

    def _square(self, rows: DataFrame) -> float:
        return self._square_of(rows.where(F.col("i") == self.blocks)) + self.spare[1]

    @staticmethod
    def _square_of(rows: DataFrame) -> float:
        def squares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"s": [float((np.frombuffer(t, float) ** 2).sum()) for t in part["tile"]]})

        return float(in_batches(rows.select("tile"), squares, "s double", TILE_ROWS).agg(F.sum("s")).first()[0] or 0.0)

    def _solve(self) -> None:
        """Once for a model: the inverse triangle as tiles (i, k) of W', and the weights (block, alpha)."""
        rows = self._eliminate(inverse=True)
        self.quadratic = self._square(rows)
        first = self.blocks + 1
        self._inverse = rows.where(F.col("i") >= first).select((F.col("i") - first).alias("i"), F.col("j").alias("k"), "rows", "columns", "tile")
        self._weights(rows.where(F.col("i") == self.blocks).select(F.col("j").alias("k"), F.col("tile").alias("z")))

    def _weights(self, z: DataFrame) -> None:
        def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for t in part.itertuples():
                    yield pd.DataFrame({"block": t.i, "at": np.arange(t.rows), "alpha": _matrix(t.tile, t.rows, t.columns) @ np.frombuffer(t.z, float)})

        sums = in_batches(self._inverse.join(z, "k"), products, "block long, at int, alpha double", TILE_ROWS).groupBy("block", "at").agg(F.sum("alpha").alias("alpha"))
        self.weights = written(self.rows.select("block", F.posexplode("pts").alias("at", "p")).join(sums, ["block", "at"]).select("block", "at", F.col("p.x").alias("x"), "alpha"), "tile-weights")

    def append(self, points: DataFrame) -> None:
        """More points (pt_id, x, y, noise_var; new ids), one block of about ``size`` after the other: each adds a block row to the
        inverse triangle and leaves what is there as it is. The default mean follows all targets."""
        if self._inverse is None:
            self._solve()
        if not points.limit(1).count():
            return
        places, moved = Places(points), self.mean
        more = places.n
        if self.follows:
            self.mean = (self.mean * self.n + float(places.table.agg(F.sum("total")).first()[0])) / (self.n + more)
        self.logdet, self.spare = self.logdet + places.logdet, (self.spare[0] + places.logdet, self.spare[1] + places.square)
        parts = -(-places.count // self.size)
        dealt = places.table.select((F.pmod(F.xxhash64("pt_id"), F.lit(parts)) + self.blocks).alias("block"), F.struct("pt_id", "x", (F.col("y") - self.mean).alias("r"), F.col("noise_var").alias("noise")).alias("p"))
        old = self.rows.select("block", F.transform("pts", lambda p: F.struct(p["pt_id"], p["x"], (p["r"] + (moved - self.mean)).alias("r"), p["noise"])).alias("pts"))
        fresh = written(dealt.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("pts")), "tile-new-blocks")
        self.rows, self.n = written(old, "tile-blocks"), self.n + more
        for k in range(self.blocks, self.blocks + parts):
            block = fresh.where(F.col("block") == k)
            if block.limit(1).count():
                self._append_block(k, block)
        self.blocks += parts
        self._weigh()

    def _append_block(self, k: int, block: DataFrame) -> None:
        own = block.first()["pts"]  # one block
        x, noise = np.array([p["x"] for p in own], float), np.array([p["noise"] for p in own], float)
        kernel, hyper, sent = self.kernel, self.hyper, self.spark.sparkContext.broadcast(x)

        def cross(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for t in part.itertuples():
                    s = _covariance(sent.value, np.array([p["x"] for p in t.pts], float), kernel, hyper)
                    yield pd.DataFrame({"of": [t.k], "rows": [len(s)], "columns": [t.columns], "tile": [(s @ _matrix(t.tile, t.rows, t.columns)).tobytes()]})

        met = self._inverse.join(self.rows.select(F.col("block").alias("i"), "pts"), "i").select("k", "rows", "columns", "tile", "pts")
        b = written(_added(in_batches(met, cross, _PART, TILE_ROWS)), "tile-cross")

        def squares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(x), len(x)))
            for part in parts:
                for t in part.itertuples():
                    m = _matrix(t.tile, t.rows, t.columns)
                    total += m @ m.T
            yield pd.DataFrame({"tile": [total.tobytes()]})

        own_k = _covariance(x, x, kernel, hyper) + np.diag(noise)
        for r in in_batches(b.coalesce(8), squares, "tile binary", TILE_ROWS).toLocalIterator():  # a few tiles
            own_k = own_k - np.frombuffer(r["tile"], float).reshape(own_k.shape)
        low = L.cholesky(own_k)
        w = L.lower_inverse(low)
        corner = self.spark.sparkContext.broadcast(w)

        def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for t in part.itertuples():
                    got = corner.value @ (_matrix(t.b, t.brows, t.columns) @ _matrix(t.tile, t.rows, t.columns).T)
                    yield pd.DataFrame({"of": [t.i], "rows": [t.rows], "columns": [len(got)], "tile": [np.ascontiguousarray(-got.T).tobytes()]})

        both = self._inverse.join(b.select(F.col("of").alias("k"), F.col("rows").alias("brows"), F.col("tile").alias("b")), "k").select("i", "rows", "columns", "tile", "brows", "b")
        rows = _added(in_batches(both, back, _PART, TILE_ROWS)).select(F.col("of").alias("i"), F.lit(k).cast("long").alias("k"), "rows", "columns", "tile")
        last = self.spark.createDataFrame([(k, k, len(x), len(x), bytearray(np.ascontiguousarray(w.T).tobytes()))], rows.schema)
        self._inverse = self._inverse.unionByName(written(rows.unionByName(last), "tile-inverse"))
        self.rows = self.rows.unionByName(block)
        self.logdet += L.logdet(low)

    def _weigh(self) -> None:
        """Coefficients of the targets and weights from the inverse triangle: z = W r, alpha = W' z."""

        def forward(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for t in part.itertuples():
                    r = np.array([p["r"] for p in t.pts], float)
                    yield pd.DataFrame({"of": [t.k], "rows": [t.columns], "columns": [1], "tile": [(_matrix(t.tile, t.rows, t.columns).T @ r).tobytes()]})

        met = self._inverse.join(self.rows.select(F.col("block").alias("i"), "pts"), "i").select("k", "rows", "columns", "tile", "pts")
        z = written(_added(in_batches(met, forward, _PART, TILE_ROWS)).select(F.col("of").alias("k"), F.col("tile").alias("z")), "tile-coefficients")
        self.quadratic = self._square_of(z.select(F.col("z").alias("tile"))) + self.spare[1]
        self._weights(z)

    def predict(self, points: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, m, v) of every row of ``points`` (id, x), any number of them."""
        if self._inverse is None:
            self._solve()
        asked = written(points.select(F.col(id_col).alias("id"), "x").withColumn("row", F.monotonically_increasing_id()), "tile-asked")
        known = self.weights.orderBy("block", "at").toPandas()  # coordinates and weights: a few numbers a point of the model
        x, alpha, block = np.array(known["x"].tolist(), float), known["alpha"].to_numpy(), known["block"].to_numpy()
        sc, kernel, hyper, level = self.spark.sparkContext, self.kernel, self.hyper, self.mean
        sent = sc.broadcast((x, alpha))

        def means(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, alpha = sent.value
            for part in parts:
                q = np.array(part["x"].tolist(), float)
                m, own = np.full(len(q), level), kernel([q[:, d] for d in range(q.shape[1])], [q[:, d] for d in range(q.shape[1])], hyper, K.NUMPY)
                for s in range(0, len(x), 2000):
                    m += _covariance(q, x[s : s + 2000], kernel, hyper) @ alpha[s : s + 2000]
                yield pd.DataFrame({"row": part["row"], "id": part["id"], "m": m, "own": np.broadcast_to(own, len(q))})

        base = in_batches(asked, means, "row long, id long, m double, own double", 1000)
        sums = None
        for slab, columns in self._slabs(block):
            piece = sc.broadcast((x[:columns], slab))

            def squares(parts: Iterator[pd.DataFrame], piece=piece) -> Iterator[pd.DataFrame]:
                x, w = piece.value
                for part in parts:
                    p = _covariance(np.array(part["x"].tolist(), float), x, kernel, hyper) @ w.T
                    yield pd.DataFrame({"row": part["row"], "s": (p * p).sum(1)})

            part = written(in_batches(asked.select("row", "x"), squares, "row long, s double", 500), "tile-squares")
            piece.unpersist()
            sums = part if sums is None else sums.unionByName(part)
        total = sums.groupBy("row").agg(F.sum("s").alias("s")) if sums is not None else asked.select("row", F.lit(0.0).alias("s"))
        return base.join(total, "row").select(F.col("id").alias(id_col), "m", F.greatest(F.lit(0.0), F.col("own") - F.col("s")).alias("v"))

    def _slabs(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Runs of W's rows of at most ``SLAB_BYTES`` with the number of columns that they reach to."""
        for k in range(self.blocks):
            columns, rows = int(np.searchsorted(block, k, "right")), int((block == k).sum())
            height = max(1, SLAB_BYTES // max(1, 8 * columns))
            for first in range(0, rows, height):
                end = min(first + height, rows)

                def cut(parts: Iterator[pd.DataFrame], first=first, end=end) -> Iterator[pd.DataFrame]:
                    for part in parts:
                        for t in part.itertuples():
                            yield pd.DataFrame({"i": [t.i], "w": [np.ascontiguousarray(_matrix(t.tile, t.rows, t.columns)[:, first:end].T).tobytes()]})

                got = in_batches(self._inverse.where(F.col("k") == k), cut, "i long, w binary", TILE_ROWS).collect()  # one slab
                yield np.concatenate([np.frombuffer(r["w"], float).reshape(end - first, -1) for r in sorted(got, key=lambda r: r["i"])], 1), columns


def _added(parts: DataFrame) -> DataFrame:
    """Sums of the tiles of each ``of``: one for every block of the model at most, summed as they come."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["tile"].iloc[0], float).copy()
        for raw in pdf["tile"].iloc[1:]:
            total += np.frombuffer(raw, float)
        return pd.DataFrame({"of": [key[0]], "rows": [pdf["rows"].iloc[0]], "columns": [pdf["columns"].iloc[0]], "tile": [total.tobytes()]})

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(8)))
    first = salted.groupBy("of", "salt").applyInPandas(lambda key, pdf: run(key, pdf), _PART)
    return first.groupBy("of").applyInPandas(run, _PART)


def _covariance(q: np.ndarray, x: np.ndarray, kernel: Callable, hyper: Sequence[float]) -> np.ndarray:
    return kernel([q[:, d][:, None] for d in range(q.shape[1])], [x[:, d][None] for d in range(x.shape[1])], hyper, K.NUMPY)
