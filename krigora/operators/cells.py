"""Covariances with compact support as a table of grid cells, and the iterations that solve with them.

A cell is at least one support radius wide in each grid dimension, so points covary with those of touching cells only. Points of a
cell are one row (a crowded cell is dealt to several), the pairs of touching cells another table, and the covariance itself is
never stored: a product with many vectors at once joins the pairs with the vectors' rows and evaluates the kernel on the way.
No cell gathers more than its own points, whatever lies in a slab, so neither the number nor the density of points is limited.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krigora.sources.places import Places
from krigora.sources.points import check
from krigora.sources.store import discard, exists, in_batches, written

from . import linalg as L
from .strips import wendland_block, wendland_point_slopes

_VECTOR = "block string, n int, v binary"
#: Crowded cells whose list is broadcast; a longer one is joined.
BROADCAST_CELLS = 100_000
#: Numbers of a vector (points by columns) up to which the driver holds those of an iteration, which then writes no tables.
HELD_NUMBERS = 500_000


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(rows, -1)


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


def _added(rows: DataFrame, each: Callable, v: np.ndarray, at: dict[str, slice]) -> np.ndarray:
    """The sum of what ``each(row, v of a block)`` gives for the rows, pairs (block, matrix); tasks add up their own and bring those home."""
    sent = rows.sparkSession.sparkContext.broadcast((v, at))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (v, at), sums = sent.value, {}
        for p in parts:
            for r in p.itertuples():
                for block, m in each(r, lambda b: v[at[b]]):
                    sums[block] = sums[block] + m if block in sums else m
        if sums:
            yield pd.DataFrame({"block": list(sums), "v": [_raw(m) for m in sums.values()]})

    out = np.zeros_like(v)
    for r in in_batches(rows, run, "block string, v binary").collect():
        out[at[r["block"]]] += np.frombuffer(r["v"], float).reshape(-1, v.shape[1])
    sent.unpersist()
    return out


def _summed(parts: DataFrame, tasks: int) -> DataFrame:
    """(block, n, v) sums of the matrices of each block; a block has a row for each of its neighbours at most."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(pdf["v"].iloc[0], float).copy()
        for raw in pdf["v"].iloc[1:]:
            v += np.frombuffer(raw, float)
        return pd.DataFrame({"block": [key[0]], "n": [pdf["n"].iloc[0]], "v": [v.tobytes()]})

    return parts.repartition(tasks, "block").groupBy("block").applyInPandas(run, _VECTOR)


def _crowded(rows: DataFrame, names: Sequence[str], most: int, name: str) -> DataFrame:
    """(cells, parts) of the cells with over ``most`` of ``rows``."""
    crowded = written(rows.groupBy(*names).count().where(F.col("count") > most).select(*names, F.ceil(F.col("count") / most).alias("parts")), name)
    return F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many blocks or domains: few bytes but much work each, so they are not dealt by size."""
    return max(1, min(-(-rows // 4), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 64))))


class Cells:
    """K + V over ``points`` (pt_id, x[, y][, noise_var]) for the Wendland kernel, hyper = [variance, length per dimension].

    Cells hold about ``aim`` points where lengths allow, rows ``most`` at most (by hash). ``noise`` is the variance of points
    without a column of it; without either it is (mean |y| / 100)^2. Cells are ``room`` lengths wide at least, so that other
    hyperparameters with lengths up to that can be asked for.
    """

    def __init__(self, points: DataFrame, hyper: Sequence[float], noise: float | None = None, aim: int = 150, most: int = 600, room: float = 1.0) -> None:
        info = check(points)
        self.spark, self.hyper, self.n, self.dims = points.sparkSession, [float(h) for h in hyper], info["rows"], info["dims"]
        if len(self.hyper) != self.dims + 1:
            raise ValueError(f"{len(self.hyper)} hyperparameters for {self.dims} dimensions")
        self.grid = min(self.dims, 3)
        y = F.col("y") if "y" in points.columns else F.lit(0.0)
        ends = points.agg(F.avg(F.abs(y)).alias("size"), *[f(F.get("x", k)).alias(f"{n}{k}") for k in range(self.grid) for n, f in (("low", F.min), ("high", F.max))]).first()
        spread = [max(1.0, (ends[f"high{k}"] - ends[f"low{k}"]) / self.hyper[k + 1]) for k in range(self.grid)]
        wide = max(room, (aim * np.prod(spread) / max(1, self.n)) ** (1 / self.grid))
        self.widths = [h * wide for h in self.hyper[1 : self.grid + 1]]
        variance = F.col("noise_var") if "noise_var" in points.columns else F.lit(noise if noise is not None else (ends["size"] / 100) ** 2)
        if points.where(~(variance > 0)).limit(1).count():
            raise ValueError("noise variances must be positive")
        self.names = [f"c{k}" for k in range(self.grid)]
        rows = points.select(*self._cell("x"), F.col("pt_id").cast("long").alias("pt_id"), "x", variance.cast("double").alias("noise"), y.cast("double").alias("y"))
        self.most, self._crowded = most, _crowded(rows, self.names, most, "crowded-cells")
        block = self._dealt(rows).groupBy("block", *self.names).agg(F.sort_array(F.collect_list(F.struct("pt_id", "x", "noise", "y"))).alias("pts"))
        self.blocks = written(block, "cells")
        self.tasks = _tasks(self.spark, self.blocks.count())
        near = F.explode(F.array(*[F.struct(*[(F.col(c) + s).alias(c) for c, s in zip(self.names, step, strict=True)]) for step in product((-1, 0, 1), repeat=self.grid)]))
        left = self.blocks.select(F.col("block").alias("a"), F.flatten("pts.x").alias("xa"), F.col("pts.noise").alias("noise"), near.alias("c")).select("a", "xa", "noise", "c.*")
        right = self.blocks.select(F.col("block").alias("b"), F.flatten("pts.x").alias("xb"), *self.names)
        pairs = left.join(right, self.names).select("a", "b", "xa", "xb", F.when(F.col("a") == F.col("b"), F.col("noise")).alias("noise"))
        self.pairs = written(pairs.repartition(self.tasks, "b"), "cell-pairs")

    def _within(self, hyper: Sequence[float] | None) -> list[float]:
        """``hyper`` or the cells' own; the cells must be as wide as its lengths."""
        hyper = list(self.hyper if hyper is None else map(float, hyper))
        if any(h > w for h, w in zip(hyper[1:], self.widths, strict=False)):
            raise ValueError(f"lengths {hyper[1:]} reach over cells of {self.widths}; make cells for them")
        return hyper

    def _cell(self, x: str) -> list:
        return [F.floor(F.get(x, k) / w).alias(f"c{k}") for k, w in enumerate(self.widths)]

    def _dealt(self, rows: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
        """``rows`` (cells, pt_id, ...) with their block: the cell, and in a crowded one a part by hash."""
        part = F.pmod(F.xxhash64("pt_id"), F.coalesce(F.col("parts"), F.lit(1)))
        return rows.join(self._crowded if crowded is None else crowded, self.names, "left").withColumn("block", F.concat_ws(":", *self.names, part)).drop("parts")

    # --- vectors: one row a block, a matrix of its points by the columns

    def column(self, value: str, less: float = 0.0) -> DataFrame:
        """A field of the points, less a number, as a vector of one column."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"block": p["block"], "n": [len(v) for v in p["v"]], "v": [_raw(np.array(v, float) - less) for v in p["v"]]})

        return in_batches(self.blocks.select("block", F.col(f"pts.{value}").alias("v")), run, _VECTOR)

    def signs(self, columns: int, seed: int = 0) -> DataFrame:
        """Random signs by the hash of a point and column."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = [np.stack([np.where(np.random.default_rng([seed, int(i) & 0xFFFFFFFF, int(i) >> 32 & 0xFFFFFFFF]).random(columns) < 0.5, -1.0, 1.0) for i in ids]) for ids in p["ids"]]
                yield pd.DataFrame({"block": p["block"], "n": [len(v) for v in out], "v": [_raw(v) for v in out]})

        return in_batches(self.blocks.select("block", F.col("pts.pt_id").alias("ids")), run, _VECTOR)

    def entries(self, vector: DataFrame, name: str = "v") -> DataFrame:
        """(i, v) rows of a vector of one column."""
        both = self.blocks.select("block", F.col("pts.pt_id").alias("ids")).join(vector, "block")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for r in p.itertuples():
                    yield pd.DataFrame({"i": np.array(r.ids, np.int64), name: np.frombuffer(r.v, float)})

        return in_batches(both, run, f"i long, {name} double")

    def product(self, vector: DataFrame, hyper: Sequence[float] | None = None) -> DataFrame:
        """(K + V) times ``vector`` (block, n, v), all its columns in one join."""
        hyper, dims = self._within(hyper), self.dims

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for r in p.itertuples():
                    a, b = (np.asarray(x, float).reshape(-1, dims) for x in (r.xa, r.xb))
                    v = _matrix(r.v, len(b))
                    got = wendland_block(a, b, hyper) @ v
                    out.append(_raw(got if r.noise is None else got + np.asarray(r.noise)[:, None] * v))
                yield pd.DataFrame({"block": p["a"], "n": [len(x) // dims for x in p["xa"]], "v": out})

        sent = vector.select(F.col("block").alias("b"), "v").repartition(self.tasks, "b")
        met = self.pairs.repartition(self.tasks, "b").join(sent, "b").select("a", "xa", "xb", "noise", "v")
        return _summed(in_batches(met, run, _VECTOR), self.tasks)

    def fingerprint(self, hyper: Sequence[float] | None = None) -> dict[str, float]:
        """Rows, trace and Frobenius norm of K + V under ``hyper``, in one pass over the pairs."""
        hyper, dims = self._within(hyper), self.dims

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for r in p.itertuples():
                    a, b = (np.asarray(x, float).reshape(-1, dims) for x in (r.xa, r.xb))
                    k = wendland_block(a, b, hyper)
                    if r.noise is not None:
                        k = k + np.diag(np.asarray(r.noise))
                    yield pd.DataFrame({"n": [len(a) * (r.noise is not None)], "trace": [k.trace() * (r.noise is not None)], "square": [(k * k).sum()]})

        got = in_batches(self.pairs.select("xa", "xb", "noise"), run, "n long, trace double, square double").agg(F.sum("n"), F.sum("trace"), F.sum("square")).first()
        return {"n": got[0] or 0, "trace": got[1] or 0.0, "frobenius": (got[2] or 0.0) ** 0.5}

    # --- preconditioners

    def jacobi(self, hyper: Sequence[float] | None = None) -> Schwarz:
        """Solves on every block by itself."""
        return Schwarz(self, 0.0, self._within(hyper))

    def schwarz(self, overlap: float = 0.5, hyper: Sequence[float] | None = None) -> Schwarz:
        """Solves on cells that reach ``overlap`` lengths into their neighbours, added up where they overlap."""
        return Schwarz(self, overlap, self._within(hyper))

    def inverse(self, nearest: int = 24) -> ApproximateInverse:
        return ApproximateInverse(self, nearest)

    # --- iterations

    def solve(self, right: DataFrame, precondition: Callable[[DataFrame], DataFrame] | None = None, start: DataFrame | None = None, tol: float = 1e-9, most: int = 1000, hyper: Sequence[float] | None = None) -> tuple[DataFrame, int]:
        """(block, n, v) with (K + V) v = ``right`` for all its columns at once, and the iterations it took: block conjugate gradients.

        An iteration is one product and one preconditioner for all columns; only Gram matrices of the columns (a few numbers a
        side) reach the driver. Directions are made orthonormal and dependent ones dropped, so columns may be alike or done.
        ``start`` is a first guess. Raises if a column is not within ``tol`` of its right side after ``most`` iterations.
        """
        norm = np.sqrt(np.diag(_gram(right, [("v", "v")])[0]))
        scale = np.where(norm > 0, norm, 1.0)
        if self.n * len(norm) <= HELD_NUMBERS and (precondition is None or hasattr(precondition, "held")):
            return self._solve_held(right, scale, precondition, start, tol, most, self._within(hyper))
        state = _mapped(right, {"r": lambda m: m["v"] / scale, "x": lambda m: 0.0 * m["v"]})
        if start is not None:
            moved = _with(_with(state.drop("x"), start, "x"), self.product(start, hyper), "q")
            state = _mapped(moved, {"r": lambda m: m["r"] - m["q"] / scale, "x": lambda m: m["x"] / scale})
        state = written(state, "block-cg")
        (rr,), k = _gram(state, [("r", "r")]), 0
        turn, held = None, None
        while not (np.sqrt(np.diag(rr)) <= tol).all():
            if k == most:
                raise RuntimeError(f"block conjugate gradients are at {np.sqrt(np.diag(rr)).max():.3g} of the right sides after {most} iterations, not at {tol:g}")
            k += 1
            if held is None:
                held = self._conditioned(state, precondition)
                basis = _orthonormal(_gram(held, [("z", "z")])[0])
            way = (lambda m, basis=basis: m["z"] @ basis) if turn is None else (lambda m, basis=basis, turn=turn: (m["z"] + m["p"] @ turn) @ basis)
            moved = _mapped(held, {"x": lambda m: m["x"], "r": lambda m: m["r"], "p": way})
            both = written(_with(moved, self.product(moved.select("block", "n", F.col("p").alias("v")), hyper), "q"), "block-cg")
            discard(held)
            bend, along = _gram(both, [("p", "q"), ("p", "r")])
            if np.linalg.eigvalsh((bend + bend.T) / 2).min() <= 0:
                raise L.NotPositiveDefinite("P'KP is not positive definite in block conjugate gradients")
            step = np.linalg.solve(bend, along)
            moved = _mapped(both, {"x": lambda m, s=step: m["x"] + m["p"] @ s, "r": lambda m, s=step: m["r"] - m["q"] @ s, "p": lambda m: m["p"], "q": lambda m: m["q"]})
            held = self._conditioned(moved, precondition)
            discard(both)
            rr, qz, zz, pz, pp = _gram(held, [("r", "r"), ("q", "z"), ("z", "z"), ("p", "z"), ("p", "p")])
            turn = -np.linalg.solve(bend, qz)
            basis = _orthonormal(zz + pz.T @ turn + turn.T @ pz + turn.T @ pp @ turn)
        return _mapped(state if held is None else held, {"v": lambda m: m["x"] * scale}), k

    def _solve_held(self, right: DataFrame, scale: np.ndarray, precondition: Schwarz | ApproximateInverse | None, start: DataFrame | None, tol: float, most: int, hyper: list[float]) -> tuple[DataFrame, int]:
        """``solve`` with its vectors on the driver: the same steps, in one job for a product and one or two for the preconditioner."""
        sizes = self.blocks.select("block", F.size("pts").alias("n")).orderBy("block").collect()
        ends = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
        at, dims = {r["block"]: slice(a, b) for r, a, b in zip(sizes, ends[:-1], ends[1:], strict=True)}, self.dims

        def gathered(vector: DataFrame) -> np.ndarray:
            out = np.zeros((ends[-1], len(scale)))
            for r in vector.select("block", "v").collect():
                out[at[r["block"]]] = np.frombuffer(r["v"], float).reshape(-1, len(scale))
            return out

        def transposed(r, of: Callable) -> list:  # of a pair of blocks (a, b) the rows of b, whose pairs lie together
            a, b = (np.asarray(x, float).reshape(-1, dims) for x in (r.xa, r.xb))
            got = wendland_block(b, a, hyper) @ of(r.a)
            return [(r.b, got if r.noise is None else got + np.asarray(r.noise)[:, None] * of(r.a))]

        product = lambda v: _added(self.pairs, transposed, v, at)
        conditioned = (lambda v: precondition.held(v, at)) if precondition is not None else (lambda v: v)
        r, x = gathered(right) / scale, np.zeros((ends[-1], len(scale)))
        if start is not None:
            x = gathered(start) / scale
            r = r - product(x)
        k, p, q, bend = 0, None, None, None
        while not ((left := np.sqrt((r * r).sum(0))) <= tol).all():
            if k == most:
                raise RuntimeError(f"block conjugate gradients are at {left.max():.3g} of the right sides after {most} iterations, not at {tol:g}")
            k += 1
            z = conditioned(r)
            if p is not None:
                z = z + p @ -np.linalg.solve(bend, q.T @ z)
            p = z @ _orthonormal(z.T @ z)
            q = product(p)
            bend = p.T @ q
            if np.linalg.eigvalsh((bend + bend.T) / 2).min() <= 0:
                raise L.NotPositiveDefinite("P'KP is not positive definite in block conjugate gradients")
            step = np.linalg.solve(bend, p.T @ r)
            x, r = x + p @ step, r - q @ step
        x = x * scale
        return self.spark.createDataFrame([(b, s.stop - s.start, bytearray(_raw(x[s]))) for b, s in at.items()], _VECTOR), k

    def _conditioned(self, state: DataFrame, precondition: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        """``state`` with z, the preconditioner times r, written."""
        if precondition is None:
            return written(state.withColumn("z", F.col("r")), "block-cg")
        return written(_with(state, precondition(state.select("block", "n", F.col("r").alias("v"))), "z"), "block-cg")

    def random_logdet(self, probes: int = 32, degree: int = 30, seed: int = 0) -> tuple[float, float]:
        """Stochastic Lanczos estimate of log|K + V| and its variance: the probes are the columns of one vector, a step is one product."""
        size = self.n**-0.5
        v = _mapped(self.signs(probes, seed), {"v": lambda m: m["v"] * size, "old": lambda m: 0.0 * m["v"]})
        state, alpha, beta, live = written(v, "lanczos"), [[] for _ in range(probes)], [[] for _ in range(probes)], np.ones(probes, bool)
        for step in range(min(degree, self.n)):
            last = np.array([b[-1] if b else 0.0 for b in beta]) * live
            u = written(_with(state, self.product(state.select("block", "n", "v")), "u"), "lanczos")
            discard(state)
            vu, vo, vv, uu, uo, oo = (np.diag(g) for g in _gram(u, [("v", "u"), ("v", "old"), ("v", "v"), ("u", "u"), ("u", "old"), ("old", "old")]))
            a = vu - last * vo
            # The length of u - last old - a v from the products at hand.
            square = uu + last**2 * oo + a**2 * vv - 2 * last * uo - 2 * a * vu + 2 * a * last * vo
            size = np.sqrt(np.maximum(square, 0.0))
            for k in np.flatnonzero(live):
                alpha[k].append(float(a[k]))
                live[k] = size[k] >= 1e-8
                if live[k] and step < min(degree, self.n) - 1:
                    beta[k].append(float(size[k]))
            if not live.any():
                break
            by = np.where(live, 1 / np.maximum(size, 1e-300), 0.0)
            state = written(_mapped(u, {"v": lambda m, a=a, by=by, last=last: (m["u"] - last * m["old"] - a * m["v"]) * by, "old": lambda m: m["v"]}), "lanczos")
            discard(u)
        got = [L.quadrature(x, y[: len(x) - 1], self.n) for x, y in zip(alpha, beta, strict=True)]
        return float(np.mean(got)), float(np.var(got, ddof=1) / probes) if probes > 1 else 0.0


def _with(state: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    return state.join(vector.select("block", F.col("v").alias(name)), "block")


def _mapped(state: DataFrame, new: dict[str, Callable]) -> DataFrame:
    """(block, n, names of ``new``): each a function of the row's matrices by name."""
    names = [c for c in state.columns if c not in ("block", "n")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{c: _matrix(raw, n) for c, raw in zip(names, row, strict=True)} for n, *row in zip(p["n"], *(p[c] for c in names), strict=True)]
            yield pd.DataFrame({"block": p["block"], "n": p["n"], **{c: [_raw(f(m)) for m in rows] for c, f in new.items()}})

    return in_batches(state, run, "block string, n int, " + ", ".join(f"{c} binary" for c in new))


def _gram(state: DataFrame, pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """Products A'B of the state's tall matrices: each task brings home its sums, matrices of columns by columns."""
    names = sorted({c for p in pairs for c in p})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[np.ndarray] | None = None
        for p in parts:
            for n, *row in zip(p["n"], *(p[c] for c in names), strict=True):
                m = {c: _matrix(raw, n) for c, raw in zip(names, row, strict=True)}
                got = [m[a].T @ m[b] for a, b in pairs]
                total = got if total is None else [t + g for t, g in zip(total, got, strict=True)]
        if total is not None:
            yield pd.DataFrame({"k": range(len(total)), "w": [t.shape[1] for t in total], "g": [t.tobytes() for t in total]})

    out: list[np.ndarray] = [np.zeros((0, 0))] * len(pairs)
    for r in in_batches(state.select("n", *names), run, "k int, w int, g binary").collect():
        m = np.frombuffer(r["g"], float).reshape(-1, r["w"])
        out[r["k"]] = m if not out[r["k"]].size else out[r["k"]] + m
    return out


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """T so that Z T has orthonormal columns where ``gram`` = Z'Z; directions that depend on others are left out."""
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w, u = np.linalg.eigh(gram / np.outer(size, size))
    keep = w > 1e-12 * w.max()
    return (u[:, keep] / np.sqrt(w[keep])) / size[:, None]


class Schwarz:
    """Preconditioner of local solves: each cell's domain holds its points and those within ``overlap`` lengths of it.

    Points are exploded to the domains they lie in, and what domains say of a shared point is added up, which keeps the
    preconditioner symmetric. A domain is a row of its points; its matrix is made anew in the task that solves with it, so that
    none is stored or shuffled. Crowded cells' domains take the points of their part, and those of over four rows'
    points are dealt further.
    """

    def __init__(self, cells: Cells, overlap: float, hyper: Sequence[float]) -> None:
        names, reach = cells.names, overlap
        each = cells.blocks.select("block", F.size("pts").alias("n"), F.posexplode("pts").alias("at", "p"), *names)
        if overlap > 0:
            steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, step, strict=True)]) for step in product((-1, 0, 1), repeat=cells.grid)]))
            near = each.withColumn("s", steps)
            for k, (c, w) in enumerate(zip(names, cells.widths, strict=True)):
                x, least = F.get("p.x", k), (F.col(c) + F.col(f"s.{c}")) * w
                near = near.where((x >= least - reach * hyper[k + 1]) & (x < least + w + reach * hyper[k + 1]))
            near = near.select("block", "n", "at", "p", *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in names])
            more = _crowded(near, names, 4 * cells.most, "crowded-domains").withColumnRenamed("parts", "more")
            crowded = cells._crowded.join(more, names, "full").select(*names, F.greatest("parts", "more").alias("parts"))
        else:
            near, crowded = each, cells._crowded
        dealt = cells._dealt(near.select(F.col("block").alias("home"), "n", "at", F.col("p.pt_id").alias("pt_id"), F.col("p.x").alias("x"), F.col("p.noise").alias("noise"), *names), crowded)

        def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["home", "at"])
            homes = [(h, g["n"].iloc[0], g["at"].to_numpy(np.int32).tobytes()) for h, g in pdf.groupby("home", sort=True)]
            return pd.DataFrame({"domain": [key[0]], "x": [_raw(np.array(pdf["x"].tolist(), float))], "noise": [_raw(pdf["noise"].to_numpy())], "hyper": [list(hyper)], "homes": [[h[0] for h in homes]], "sizes": [[h[1] for h in homes]], "places": [[h[2] for h in homes]]})

        made = dealt.withColumnRenamed("block", "domain").repartition(cells.tasks, "domain").groupBy("domain").applyInPandas(gather, "domain string, x binary, noise binary, hyper array<double>, homes array<string>, sizes array<int>, places array<binary>")
        self.domains = written(made, "domains")
        self.tasks = cells.tasks

    def __call__(self, vector: DataFrame) -> DataFrame:
        asked = self.domains.select("domain", F.explode(F.arrays_zip("homes", "places")).alias("h")).select("domain", F.col("h.homes").alias("block"), F.col("h.places").alias("places"))

        def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"domain": p["domain"], "block": p["block"], "v": [_raw(_matrix(v, n)[np.frombuffer(at, np.int32)]) for v, n, at in zip(p["v"], p["n"], p["places"], strict=True)]})

        def local(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            d, got = own.iloc[0], dict(zip(sent["block"], sent["v"], strict=True))
            at = [np.frombuffer(p, np.int32) for p in d["places"]]
            x, noise = _matrix(d["x"], sum(map(len, at))), np.frombuffer(d["noise"], float)
            k = wendland_block(x, x, d["hyper"])
            k[np.diag_indices_from(k)] += noise
            solved = L.solve(L.cholesky(k), np.concatenate([_matrix(got[h], len(a)) for h, a in zip(d["homes"], at, strict=True)]))
            out, k = [], 0
            for a, n in zip(at, d["sizes"], strict=True):
                v = np.zeros((n, solved.shape[1]))
                v[a] = solved[k : k + len(a)]
                k += len(a)
                out.append(_raw(v))
            return pd.DataFrame({"block": d["homes"], "n": d["sizes"], "v": out})

        sent = in_batches(asked.join(vector, "block").select("domain", "block", "n", "places", "v"), pick, "domain string, block string, v binary")
        own, sent = (df.repartition(self.tasks, "domain") for df in (self.domains, sent))
        return _summed(own.groupBy("domain").cogroup(sent.groupBy("domain")).applyInPandas(local, _VECTOR), self.tasks)


    def held(self, vector: np.ndarray, at: dict[str, slice]) -> np.ndarray:
        """Of a vector on the driver, whose blocks lie ``at``."""

        def local(d, of: Callable) -> list:
            places = [np.frombuffer(p, np.int32) for p in d.places]
            x, noise = _matrix(d.x, sum(map(len, places))), np.frombuffer(d.noise, float)
            k = wendland_block(x, x, d.hyper)
            k[np.diag_indices_from(k)] += noise
            solved, out, start = L.solve(L.cholesky(k), np.concatenate([of(h)[a] for h, a in zip(d.homes, places, strict=True)])), [], 0
            for h, a in zip(d.homes, places, strict=True):
                v = np.zeros_like(of(h))
                v[a] = solved[start : start + len(a)]
                start += len(a)
                out.append((h, v))
            return out

        return _added(self.domains, local, vector, at)


class ApproximateInverse:
    """Preconditioner G'G with a sparse triangle G: each row is one small solve over the point's ``nearest`` earlier neighbours.

    Row i of G makes G K G' as near to the unit matrix as its places allow, so G'G approximates the inverse of K + V and is
    symmetric and positive whatever the data. The neighbours come by the join of touching cells; rows go through two products.
    """

    def __init__(self, cells: Cells, nearest: int) -> None:
        hyper, dims = cells.hyper, cells.dims
        noise = cells.blocks.select(F.col("block").alias("b"), F.col("pts.noise").alias("noises"))
        near = cells.pairs.where("b <= a").select("a", "b", "xa", "xb").join(noise, "b")

        def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b")
            own = np.asarray(pdf["xa"].iloc[0], float).reshape(-1, dims)
            x = np.concatenate([np.asarray(v, float).reshape(-1, dims) for v in pdf["xb"]])
            noise, sizes = np.concatenate([np.asarray(v, float) for v in pdf["noises"]]), [len(v) // dims for v in pdf["xb"]]
            first = len(x) - len(own)  # the own block is the last of those up to it
            k = wendland_block(own, x, hyper)
            ri, ci, g = [], [], []
            for i in range(len(own)):
                before = np.flatnonzero(k[i, : first + i])
                if len(before) > nearest:
                    before = before[np.argsort(-k[i, before], kind="stable")[:nearest]]
                at = np.append(before, first + i)
                y = np.linalg.solve(wendland_block(x[at], x[at], hyper) + np.diag(noise[at]), np.append(np.zeros(len(before)), 1.0))
                ri.append(np.full(len(at), i))
                ci.append(at)
                g.append(y / np.sqrt(y[-1]))
            ri, ci, g = map(np.concatenate, (ri, ci, g))
            ends = np.cumsum(sizes)
            of, out = np.searchsorted(ends, ci, "right"), []
            for j, b in enumerate(pdf["b"]):
                m = of == j
                out.append((key[0], b, len(own), sizes[j], ri[m].astype(np.int32).tobytes(), (ci[m] - (ends[j] - sizes[j])).astype(np.int32).tobytes(), g[m].tobytes()))
            return pd.DataFrame([o for o in out if o[6]], columns=["a", "b", "na", "nb", "ri", "ci", "g"])

        self.tasks = cells.tasks
        self.triangle = written(near.groupBy("a").applyInPandas(rows, "a string, b string, na int, nb int, ri binary, ci binary, g binary"), "inverse-rows")

    def _times(self, vector: DataFrame, turned: bool) -> DataFrame:
        to, by, rows, columns, size, other = ("b", "a", "ci", "ri", "nb", "na") if turned else ("a", "b", "ri", "ci", "na", "nb")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for r in p.itertuples():
                    got = np.frombuffer(r.g, float)[:, None] * _matrix(r.v, getattr(r, other))[np.frombuffer(getattr(r, columns), np.int32)]
                    v = np.zeros((getattr(r, size), got.shape[1]))
                    np.add.at(v, np.frombuffer(getattr(r, rows), np.int32), got)
                    out.append(_raw(v))
                yield pd.DataFrame({"block": p[to], "n": p[size], "v": out})

        return _summed(in_batches(self.triangle.join(vector.select(F.col("block").alias(by), "v"), by), run, _VECTOR), self.tasks)

    def __call__(self, vector: DataFrame) -> DataFrame:
        return self._times(self._times(vector, False), True)

    def held(self, vector: np.ndarray, at: dict[str, slice]) -> np.ndarray:
        """Of a vector on the driver, whose blocks lie ``at``."""

        def times(turned: bool) -> Callable:
            to, by, rows, columns, size = ("b", "a", "ci", "ri", "nb") if turned else ("a", "b", "ri", "ci", "na")

            def each(r, of: Callable) -> list:
                got = np.frombuffer(r.g, float)[:, None] * of(getattr(r, by))[np.frombuffer(getattr(r, columns), np.int32)]
                v = np.zeros((getattr(r, size), got.shape[1]))
                np.add.at(v, np.frombuffer(getattr(r, rows), np.int32), got)
                return [(getattr(r, to), v)]

            return each

        return _added(self.triangle, times(True), _added(self.triangle, times(False), vector, at), at)


class WarmSolver:
    """Solves for one right side under hyperparameters that change little by little, as training asks for.

    The last solution, its preconditioner and the fingerprint of its covariance are kept as tables, under ``path`` too if that is
    given, so that another session goes on from them. While the fingerprint has drifted by less than ``most_drift``, a solve
    starts from that solution; the preconditioner stays until its own covariance is that far off, or has served ``refresh`` solves.
    """

    def __init__(self, cells: Cells, right: DataFrame, path: str | None = None, overlap: float = 0.5, most_drift: float = 0.1, refresh: int = 20, tol: float = 1e-9) -> None:
        self.cells, self.right, self.path, self.overlap, self.most_drift, self.refresh, self.tol = cells, right, path, overlap, most_drift, refresh, tol
        self.last: dict | None = None
        self.solution = self.precondition = None
        if path:
            self._load()

    @staticmethod
    def drift(a: dict, b: dict) -> float:
        """The larger relative change of trace and Frobenius norm; 1 if the sizes differ."""
        change = [abs(a[k] - b[k]) / max(abs(a[k]), abs(b[k]), 1e-300) for k in ("trace", "frobenius")]
        return 1.0 if a["n"] != b["n"] else max(change)

    def solve(self, hyper: Sequence[float] | None = None) -> tuple[DataFrame, int]:
        """(block, n, v) with (K + V) v = right under ``hyper``, and the iterations it took."""
        now = self.cells.fingerprint(hyper)
        near = self.last is not None and self.drift(self.last["solution"], now) < self.most_drift
        if self.last is None or self.drift(self.last["preconditioner"], now) >= self.most_drift or self.last["served"] >= self.refresh:
            self.precondition, made, served = self.cells.schwarz(self.overlap, hyper), now, 0
        else:
            made, served = self.last["preconditioner"], self.last["served"]
        solved, steps = self.cells.solve(self.right, self.precondition, self.solution if near else None, self.tol, hyper=hyper)
        self.solution = written(solved, "warm-solution")
        self.last = {"solution": now, "preconditioner": made, "served": served + 1}
        if self.path:
            self._save()
        return self.solution, steps

    def _layout(self) -> dict:
        return {"n": self.cells.n, "widths": self.cells.widths, "domains": "points"}

    def _save(self) -> None:
        spark = self.cells.spark
        self.solution.write.mode("overwrite").parquet(f"{self.path}/solution")
        self.precondition.domains.write.mode("overwrite").parquet(f"{self.path}/domains")
        spark.createDataFrame([(json.dumps({"last": self.last, "layout": self._layout()}),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state")

    def _load(self) -> None:
        """What another session left, if it belongs to the same layout of cells. Tables are copied, as this one writes there too."""
        spark = self.cells.spark
        if not exists(spark, f"{self.path}/state/_SUCCESS"):
            return
        kept = json.loads(spark.read.text(f"{self.path}/state").first()[0])
        if kept["layout"] != self._layout():
            return
        self.last, self.solution = kept["last"], written(spark.read.parquet(f"{self.path}/solution"), "warm-solution")
        self.precondition = Schwarz.__new__(Schwarz)
        self.precondition.domains, self.precondition.tasks = written(spark.read.parquet(f"{self.path}/domains"), "domains"), self.cells.tasks


class CellGaussianProcess:
    """An exact GP over ``points`` (pt_id, x, y[, noise_var]) with the Wendland kernel, whatever their number and density.

    The weights take one solve, variances one solve for every ``columns`` points asked for; means of any number of points are one
    join. The prior mean is a number (the mean of y by default). Points of equal coordinates are one place of the cells; ``points`` may
    be places already.
    """

    def __init__(self, points: DataFrame | Places, hyper: Sequence[float], noise: float | None = None, mean: float | None = None, overlap: float = 0.5, aim: int = 150, most: int = 600, tol: float = 1e-10) -> None:
        self.places = Places.of(points, noise, mean)
        self.cells, self.mean = Cells(self.places.table, hyper, None, aim, most), self.places.mean
        self.precondition, self.tol = self.cells.schwarz(overlap), tol
        solved, self.iterations = self.cells.solve(self.cells.column("y", self.mean), self.precondition, tol=tol)
        self.alpha = written(solved, "cell-weights")

    def weights(self) -> DataFrame:
        return self.places.weights(self.cells.entries(self.alpha, "alpha"))

    def log_likelihood(self, probes: int = 32, degree: int = 30, seed: int = 0) -> float:
        """An estimate: the log-determinant is that of random probes; ``log_likelihood_variance`` tells how far it may be off."""
        (square,) = _gram(_with(self.cells.column("y", self.mean), self.alpha, "a"), [("v", "a")])
        self.quadratic = float(square[0, 0]) + self.places.square
        logdet, self.logdet_variance = self.cells.random_logdet(probes, degree, seed)
        self.logdet = logdet + self.places.logdet
        return self.places.log_likelihood(self.logdet, self.quadratic)

    def log_likelihood_variance(self) -> float:
        """Of the last estimate: the log-determinant enters it by half, so by a quarter of its variance."""
        return 0.25 * self.logdet_variance

    def _near(self, queries: DataFrame) -> DataFrame:
        """(pred_id, q, block, xb): every query with the blocks of touching cells; queries of a cell stay apart in groups of 2,000."""
        c = self.cells
        near = F.explode(F.array(*[F.struct(*[(F.floor(F.get("x", k) / w) + s).alias(n) for k, (n, w, s) in enumerate(zip(c.names, c.widths, step, strict=True))]) for step in product((-1, 0, 1), repeat=c.grid)]))
        asked = queries.select("pred_id", F.col("x").alias("q"), near.alias("c")).select("pred_id", "q", "c.*")
        part = F.pmod(F.xxhash64("pred_id"), F.lit(4096))
        sizes = asked.groupBy(*c.names).agg(F.ceil(F.count("*") / 2000).alias("parts"))
        asked = asked.join(sizes, c.names).withColumn("part", part % F.col("parts"))
        grouped = asked.groupBy(*c.names, "part").agg(F.collect_list("pred_id").alias("ids"), F.flatten(F.collect_list("q")).alias("q"))
        return grouped.join(c.blocks.select("block", F.flatten("pts.x").alias("xb"), *c.names), c.names).select("block", "ids", "q", "xb")

    def predict_mean(self, queries: DataFrame) -> DataFrame:
        """(pred_id, m) of queries (pred_id, x), any number of them."""
        hyper, dims, level = self.cells.hyper, self.cells.dims, self.mean

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for r in p.itertuples():
                    q, b = (np.asarray(v, float).reshape(-1, dims) for v in (r.q, r.xb))
                    yield pd.DataFrame({"pred_id": np.array(r.ids, np.int64), "m": wendland_block(q, b, hyper) @ np.frombuffer(r.v, float)})

        near = self._near(queries).join(self.alpha.select("block", "v"), "block")
        sums = in_batches(near, run, "pred_id long, m double").groupBy("pred_id").agg(F.sum("m").alias("m"))
        return queries.select("pred_id").distinct().join(sums, "pred_id", "left").select("pred_id", (F.lit(level) + F.coalesce("m", F.lit(0.0))).alias("m"))

    def _right_sides(self, some: DataFrame, slopes: bool = False) -> tuple[list[int], DataFrame]:
        """The ids of few points asked for and (block, n, k[, d]): their covariances with the points, and with ``slopes`` those
        covariances' derivatives along every coordinate of the point asked for, dimension by dimension."""
        hyper, dims = self.cells.hyper, self.cells.dims
        ids = sorted(r["pred_id"] for r in some.select("pred_id").collect())  # the columns of one solve
        place, width = {i: k for k, i in enumerate(ids)}, len(ids) * (1 + dims * slopes)

        def side(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                made = []
                for r in p.itertuples():
                    q, b = (np.asarray(v, float).reshape(-1, dims) for v in (r.q, r.xb))
                    v, at = np.zeros((len(b), width)), np.array([place[i] for i in r.ids])
                    v[:, at] = wendland_block(b, q, hyper)
                    for t, d in enumerate(wendland_point_slopes(b, q, hyper) if slopes else ()):
                        v[:, len(place) * (1 + t) + at] = d
                    made.append((r.block, len(b), _raw(v)))
                yield pd.DataFrame(made, columns=["block", "n", "v"])

        near = _summed(in_batches(self._near(some), side, _VECTOR), self.cells.tasks)
        whole = self.cells.blocks.select("block", F.size("pts").alias("n")).join(near.drop("n"), "block", "left")

        def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"block": p["block"], "n": p["n"], "v": [v if v is not None else _raw(np.zeros((n, width))) for v, n in zip(p["v"], p["n"], strict=True)]})

        made = written(in_batches(whole, fill, _VECTOR), "cell-right-sides")
        n = len(ids)
        return ids, _mapped(made, {"k": lambda m: m["v"][:, :n], **({"d": lambda m: m["v"][:, n:]} if slopes else {})})

    def predict(self, queries: DataFrame, columns: int = 64, id_col: str = "pred_id") -> DataFrame:
        """(id, m, v) of every row of ``queries`` (id, x), ids distinct: their covariances are right sides of one solve per ``columns``."""
        asked = written(queries.select(F.col(id_col).cast("long").alias("pred_id"), "x"), "cell-queries")
        turns = max(1, -(-asked.count() // columns))
        asked = written(asked.withColumn("turn", F.pmod(F.xxhash64("pred_id"), F.lit(turns))), "cell-queries")
        schema, out = f"{id_col} long, m double, v double", None
        for turn in range(turns):
            ids, sides = self._right_sides(asked.where(F.col("turn") == turn).drop("turn"))
            if not ids:
                continue
            right = sides.withColumnRenamed("k", "v")
            solved, self.iterations = self.cells.solve(right, self.precondition, tol=self.tol)
            ks, ka = _gram(_with(_with(sides, solved, "s"), self.alpha, "a"), [("k", "s"), ("k", "a")])
            rows = [(i, self.mean + float(ka[j, 0]), max(0.0, self.cells.hyper[0] - float(ks[j, j]))) for j, i in enumerate(ids)]
            got = self.cells.spark.createDataFrame(rows, schema)
            out = got if out is None else out.unionByName(got)
        return out if out is not None else self.cells.spark.createDataFrame([], schema)

    def posterior(self, queries: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
        """For at most ``most`` points asked for (pred_id, x): their posterior covariance (i, j, s), and the slopes (i, j, direction, ds)
        of -2 dk_i' (K + V)^-1 k_j, with dm (the slope of i's mean) on the rows i = j, whose ds is the slope of the variance."""
        spark, dims, hyper = self.cells.spark, self.cells.dims, self.cells.hyper
        asked = written(queries.select(F.col("pred_id").cast("long").alias("pred_id"), "x"), "cell-queries")
        rows = asked.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} points asked for jointly; variances of any number come from predict")
        ids, sides = self._right_sides(asked, slopes=True)
        solved, self.iterations = self.cells.solve(sides.select("block", "n", F.col("k").alias("v")), self.precondition, tol=self.tol)
        ks, ds, da = _gram(_with(_with(sides, solved, "s"), self.alpha, "a"), [("k", "s"), ("d", "s"), ("d", "a")])
        x = {r["pred_id"]: r["x"] for r in rows}
        q = np.array([x[i] for i in ids], float).reshape(len(ids), dims)
        s, n = wendland_block(q, q, hyper) - ks, len(ids)
        pairs = [(a, b) for a in range(n) for b in range(n)]
        covariance = spark.createDataFrame([(ids[a], ids[b], float(s[a, b])) for a, b in pairs], "i long, j long, s double")
        slopes = [(ids[a], ids[b], t, -2.0 * float(ds[t * n + a, b]), float(da[t * n + a, 0]) if a == b else None) for a, b in pairs for t in range(dims)]
        return covariance, spark.createDataFrame(slopes, "i long, j long, direction int, ds double, dm double")
