"""Exact Gaussian processes with a compactly supported kernel, as tables of strips.

Points farther apart than the kernel's length along one coordinate have covariance zero, so points sorted into strips of that
coordinate have a block-tridiagonal covariance. Spark eliminates every other strip at once, which leaves half as many strips in
the same form: after log2(strips) rounds one is left, and as many rounds back give the solution, the exact log-determinant and
those blocks of the inverse that predictions and gradients need. A strip is a row; no round gathers more than three of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.sources.places import Places
from krigora.sources.store import discard, written

from . import linalg as L

_NODE = "kind string, pos long, n int, d binary, u binary, b binary, logdet double, square double"
_RESULT = "pos long, x binary, s binary, su binary"
#: Places of a strip, beyond which a model that is asked for weights only is made in cells.
WEIGHTS_MOST = 600


def wendland_block(a: np.ndarray, b: np.ndarray, hyper: Sequence[float]) -> np.ndarray:
    """Dense block of the anisotropic Wendland kernel: hyper = [variance, length per dimension]."""
    if not (len(a) and len(b)):
        return np.zeros((len(a), len(b)))
    d = K.distance([a[:, k][:, None] for k in range(a.shape[1])], [b[:, k][None] for k in range(b.shape[1])], hyper[1:], K.NUMPY)
    out, near = np.zeros(d.shape), ~(d >= 1.0)  # most pairs of touching cells are out of reach
    out[near] = hyper[0] * K.wendland(d[near], K.NUMPY)
    return out


def wendland_slopes(a: np.ndarray, b: np.ndarray, hyper: Sequence[float]) -> Iterator[np.ndarray]:
    """Derivatives of ``wendland_block`` by each of ``hyper``."""
    yield wendland_block(a, b, [1.0, *hyper[1:]])
    gaps = [(a[:, k][:, None] - b[:, k][None]) ** 2 for k in range(a.shape[1])]
    d = np.minimum(np.sqrt(sum(g / h**2 for g, h in zip(gaps, hyper[1:], strict=True))), 1.0)
    over_d = -22.0 * (1 - d) ** 7 * (16.0 * d * d + 7.0 * d + 1.0)  # slope of the polynomial divided by d
    for g, h in zip(gaps, hyper[1:], strict=True):
        yield hyper[0] * over_d * -(g / h**3)


def wendland_point_slopes(b: np.ndarray, q: np.ndarray, hyper: Sequence[float]) -> Iterator[np.ndarray]:
    """Derivatives of ``wendland_block(b, q)`` along each coordinate of ``q``."""
    gaps = [(q[:, t][None] - b[:, t][:, None]) / h**2 for t, h in enumerate(hyper[1:])]
    d = np.minimum(np.sqrt(sum((g * h) ** 2 for g, h in zip(gaps, hyper[1:], strict=True))), 1.0)
    over_d = -22.0 * hyper[0] * (1 - d) ** 7 * (16.0 * d * d + 7.0 * d + 1.0)
    for g in gaps:
        yield over_d * g


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


def _block(raw: bytes | None, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(rows, columns) if raw else np.zeros((rows, columns))


def _square(raw: bytes) -> np.ndarray:
    n = int(round((len(raw) / 8) ** 0.5))
    return np.frombuffer(raw, float).reshape(n, n)


def _halve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One round for the strips 2k and 2k + 1: adds what was eliminated to their left, then eliminates 2k + 1.

    Gives the strip 2k as strip k of the next round, what the elimination adds to strip k + 1, and the eliminated strip with
    what the way back needs (kind ``done``: u holds D^-1 U' | D^-1 U, b holds D^-1 b).
    """
    rows = {(r.kind, r.pos): r for r in pdf.itertuples()}
    even = 2 * (int(pdf["pos"].iloc[0]) // 2)
    nodes = []
    for pos in (even, even + 1):
        r = rows.get(("node", pos))
        if r is None:
            nodes.append(None)
            continue
        d, b = _block(r.d, r.n, r.n), np.frombuffer(r.b, float)
        if (left := rows.get(("left", pos))) is not None:
            d, b = d - _block(left.d, r.n, r.n), b - np.frombuffer(left.b, float)
        nodes.append((r.n, d, r.u, b))
    out = []
    (n0, d0, u0, b0), odd = nodes[0], nodes[1]
    if odd is None:
        out.append(("node", even // 2, n0, _pack(d0), None, _pack(b0), 0.0, 0.0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
    n1, d1, u1, b1 = odd
    up, down = _block(u0, n0, n1), np.frombuffer(u1, float).reshape(n1, -1) if u1 and n1 else np.zeros((n1, 0))
    low = L.cholesky(d1)
    inverse = L.inverse(low)
    solved = inverse @ np.concatenate([up.T, down, b1[:, None]], 1)
    e, f, y = solved[:, :n0], solved[:, n0:-1], solved[:, -1]
    out.append(("done", even + 1, n1, _pack(inverse), _pack(solved[:, :-1]), _pack(y), L.logdet(low), float(b1 @ y)))
    out.append(("node", even // 2, n0, _pack(d0 - up @ e), _pack(-up @ f) if down.shape[1] else None, _pack(b0 - up @ y), 0.0, 0.0))
    if down.shape[1]:
        out.append(("left", even // 2 + 1, down.shape[1], _pack(down.T @ f), None, _pack(down.T @ y), 0.0, 0.0))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])


def _restore(done: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """The way back of ``_halve``: results of the strips k and k + 1 of the next round -> those of the strips 2k and 2k + 1."""
    by = {int(r.pos): r for r in kept.itertuples()}
    k = int(kept["key"].iloc[0])
    left, right = by.get(k), by.get(k + 1)
    if left is None:  # the row of strip k + 1 comes here too; without strip k there is nothing to do
        return pd.DataFrame([], columns=["pos", "x", "s", "su"])
    x0, s0 = np.frombuffer(left.x, float), _square(left.s)
    if not len(done):
        return pd.DataFrame([(2 * k, left.x, left.s, None)], columns=["pos", "x", "s", "su"])
    r = done.iloc[0]
    n, n0 = int(r["n"]), len(x0)
    ef = np.frombuffer(r["u"], float).reshape(n, -1) if n else np.zeros((0, n0))
    e, f, inverse, y = ef[:, :n0], ef[:, n0:], _block(r["d"], n, n), np.frombuffer(r["b"], float)
    x, own, toward = y - e @ x0, e @ s0, None
    if f.shape[1]:
        x1, s1, cross = np.frombuffer(right.x, float), _square(right.s), _block(left.su, n0, f.shape[1])
        x = x - f @ x1
        own = own + f @ cross.T
        toward = e @ cross + f @ s1
    s = inverse + own @ e.T + (toward @ f.T if toward is not None else 0.0)
    rows = [(2 * k, left.x, left.s, _pack(-own.T)), (2 * k + 1, _pack(x), _pack((s + s.T) / 2), _pack(-toward) if toward is not None else None)]
    return pd.DataFrame(rows, columns=["pos", "x", "s", "su"])


class Crowded(ValueError):
    """A strip has more points than one task takes."""


def compact_model(points: DataFrame | Places, hyper: Sequence[float], noise: float | None = None, mean: float | None = None, predicts: bool = True, weights_only: bool = False, **strips):
    """A model with ``weights`` and ``predict`` in strips or, where a strip would be too crowded for one task, in cells.

    With ``weights_only`` (no predictions, no slopes) that is over ``WEIGHTS_MOST`` places: several matrices of a strip are one
    row of its tables, and cells have the same weights from rows of points.
    """
    from .cells import CellGaussianProcess

    places = Places.of(points, noise, mean)
    if weights_only:
        predicts, strips = False, {"most": WEIGHTS_MOST} | strips
    try:
        return StripGaussianProcess(places, hyper, predicts=predicts, **strips)
    except Crowded:
        return CellGaussianProcess(places, hyper)


class StripGaussianProcess:
    """An exact GP over ``points`` (pt_id, x, y[, noise_var]) with the Wendland kernel: hyper = [variance, length per dimension].

    ``noise`` is the variance of points without a column of it; the prior mean is a number (the mean of y by default). Points of
    equal coordinates are one place; ``points`` may be places already. Places of one strip meet in one task, so a strip holds ``most`` at most; denser data raise, and ``compact_model`` takes cells for
    them. Halving ends where the strips that are left have ``together`` points or fewer, which one task solves.
    """

    def __init__(self, points: DataFrame | Places, hyper: Sequence[float], noise: float | None = None, mean: float | None = None, most: int = 4000, aim: int = 200, predicts: bool = True, together: int = 2500) -> None:
        self.places = places = Places.of(points, noise, mean)
        self.spark, self.hyper, self.n, dims = places.table.sparkSession, [float(h) for h in hyper], places.n, places.dims
        if len(self.hyper) != dims + 1:
            raise ValueError(f"{len(self.hyper)} hyperparameters for {dims} dimensions")
        ends = places.table.agg(*[f(F.get("x", k)).alias(f"{name}{k}") for k in range(dims) for name, f in (("low", F.min), ("high", F.max))]).first()
        self.mean = places.mean
        spread = [(ends[f"high{k}"] - ends[f"low{k}"]) / self.hyper[k + 1] for k in range(dims)]
        self.axis = int(np.argmax(spread))
        # Strips of twice the length: the points that a query depends on lie in two of them. Without queries, once will do.
        self.low, self.length = float(ends[f"low{self.axis}"]), self.hyper[self.axis + 1]
        self.predicts = predicts
        self.width = max(2.0 if predicts else 1.0, spread[self.axis] * aim / max(places.count, 1)) * self.length
        strip = F.floor((F.get("x", self.axis) - self.low) / self.width)
        rows = places.table.select(strip.alias("strip"), "pt_id", "x", (F.col("y") - self.mean).alias("r"), F.col("noise_var").alias("noise"))
        counts = rows.groupBy("strip").count().agg(F.max("count"), F.max("strip")).first()
        if counts[0] > most:
            raise Crowded(f"a strip holds {counts[0]} places, more than {most}; take shorter lengths, or cells")
        self.strips, self._fullest, self._together = int(counts[1]) + 1, int(counts[0]), together
        self._points = written(rows, "strip-points")
        self._solve()
        self._tables += [places.table] if places is not points else []

    def _solve(self) -> None:
        """Forward rounds, the last strip, and the rounds back."""
        hyper = self.hyper

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own, beyond = (pdf[pdf["next"] == k].sort_values("pt_id") for k in (0, 1))
            x, z = (np.array(p["x"].tolist(), float).reshape(len(p), len(hyper) - 1) for p in (own, beyond))
            if not own["noise"].gt(0).all():
                raise ValueError("noise variances must be positive")
            d = wendland_block(x, x, hyper) + np.diag(own["noise"].to_numpy())
            u = _pack(wendland_block(x, z, hyper)) if len(z) and len(x) else None
            return pd.DataFrame([("node", key[0], len(own), _pack(d), u, _pack(own["r"].to_numpy()), 0.0, 0.0)], columns=[c.split()[0] for c in _NODE.split(", ")])

        # Empty strips are strips of no points, so that neighbours keep their places.
        numbered = self.spark.range(self.strips).select(F.col("id").alias("strip"), F.lit(None).cast("long").alias("pt_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("noise"))
        every = self._points.unionByName(numbered)
        shared = every.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("strip", F.col("strip") - F.col("next")).where("strip >= 0")

        def build_all(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return build(key, pdf[pdf["pt_id"].notna()])

        level = written(shared.groupBy("strip").applyInPandas(build_all, _NODE), "strip-level")
        self._tables = [self._points, level]
        left, levels = self.strips, []
        while left > 1 and left * self._fullest > self._together:
            live = level.where("kind <> 'done'")
            level = written(live.groupBy(F.floor(F.col("pos") / 2)).applyInPandas(_halve, _NODE), "strip-level")
            self._tables.append(level)
            levels.append(level.where("kind = 'done'"))
            left = -(-left // 2)

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            """All strips that are left, as one matrix."""
            nodes = {int(r.pos): r for r in pdf.itertuples() if r.kind == "node"}
            sizes = [int(nodes[k].n) for k in range(len(nodes))]
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
            whole, b = np.zeros((at[-1], at[-1])), np.zeros(at[-1])
            for k, r in nodes.items():
                own = slice(at[k], at[k + 1])
                whole[own, own], b[own] = _block(r.d, r.n, r.n), np.frombuffer(r.b, float)
                if r.u and k + 1 < len(sizes):
                    after = slice(at[k + 1], at[k + 2])
                    whole[own, after] = _block(r.u, r.n, sizes[k + 1])
                    whole[after, own] = whole[own, after].T
            for r in pdf[pdf["kind"] == "left"].itertuples():
                own = slice(at[int(r.pos)], at[int(r.pos) + 1])
                whole[own, own] -= _block(r.d, r.n, r.n)
                b[own] -= np.frombuffer(r.b, float)
            low = L.cholesky(whole) if len(b) else whole
            inverse = L.inverse(low)
            x, out = inverse @ b, []
            for k in range(len(sizes)):
                own, after = slice(at[k], at[k + 1]), slice(at[k + 1], at[k + 2]) if k + 1 < len(sizes) else None
                out.append((k, _pack(x[own]), _pack(inverse[own, own]), _pack(inverse[own, after]) if after else None, L.logdet(low) if k == 0 else 0.0, float(b @ x) if k == 0 else 0.0))
            return pd.DataFrame(out, columns=["pos", "x", "s", "su", "logdet", "square"])

        top = written(level.where("kind <> 'done'").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: finish(pdf), _RESULT + ", logdet double, square double"), "strip-top")
        self._tables.append(top)
        parts = top.select("logdet", "square")
        for done in levels:
            parts = parts.unionByName(done.select("logdet", "square"))
        sums = parts.agg(F.sum("logdet"), F.sum("square")).first()
        self.logdet, self.quadratic = float(sums[0]) + self.places.logdet, float(sums[1]) + self.places.square
        result = top.select("pos", "x", "s", "su")
        for done in reversed(levels):
            sent = result.withColumn("key", F.explode(F.array(F.col("pos"), F.col("pos") - 1))).where("key >= 0")
            keyed = done.withColumn("key", F.floor(F.col("pos") / 2))
            older, result = result, written(keyed.groupBy("key").cogroup(sent.groupBy("key")).applyInPandas(_restore, _RESULT), "strip-result")
            if older.columns and hasattr(older, "folder"):
                discard(older)
        self.result = result
        self._tables += [result] if hasattr(result, "folder") else []

    def log_likelihood(self) -> float:
        return self.places.log_likelihood(self.logdet, self.quadratic)

    def weights(self) -> DataFrame:
        """(i, alpha): the solution of (K + V) alpha = y - mean."""

        def place(pts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": np.sort(pts["pt_id"].to_numpy()), "alpha": np.frombuffer(got["x"].iloc[0], float) if len(got) else []})

        return self.places.weights(self._points.groupBy("strip").cogroup(self.result.groupBy("pos")).applyInPandas(place, "i long, alpha double"))

    def inverse_diagonal(self) -> DataFrame:
        """(i, alpha, inverse): the weights and the diagonal of (K + V)^-1."""

        def place(pts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(pts["pt_id"].to_numpy())
            if not len(ids):
                return pd.DataFrame({"i": [], "alpha": [], "inverse": []})
            return pd.DataFrame({"i": ids, "alpha": np.frombuffer(got["x"].iloc[0], float), "inverse": _square(got["s"].iloc[0]).diagonal()})

        return self.places.inverse_diagonal(self._points.groupBy("strip").cogroup(self.result.groupBy("pos")).applyInPandas(place, "i long, alpha double, inverse double"))

    def discard(self) -> None:
        """Deletes the model's tables; nothing can be asked of it any more."""
        for df in self._tables:
            discard(df)

    def _pairs(self) -> tuple[DataFrame, DataFrame]:
        """Points and results of each strip (next = 0) and of the one after it (next = 1), keyed by the first."""
        both = lambda df, name: df.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", F.col(name) - F.col("next"))
        return both(self._points, "strip"), both(self.result, "pos")

    def predict(self, queries: DataFrame, id_col: str = "pred_id") -> DataFrame:
        """(id, m, v) of every row of ``queries`` (id, x): each meets the two strips within reach, and nothing else."""
        if not self.predicts:
            raise ValueError("the strips of this model are too narrow for predictions; make it with predicts=True")
        hyper, mean, dims = self.hyper, self.mean, len(self.hyper) - 1
        first = F.floor((F.get("x", self.axis) - self.length - self.low) / self.width)
        asked = queries.select(F.col(id_col).alias("pred_id"), "x", F.greatest(F.lit(-2), F.least(first, F.lit(self.strips))).alias("key"))
        pts, res = self._pairs()
        # Many queries of one strip are dealt to several groups, each with the strip's blocks.
        rows = written(asked.withColumn("part", F.pmod(F.xxhash64("pred_id", "x"), F.lit(4096))), "strip-queries")
        crowd = rows.groupBy("key").agg(F.least(F.lit(4096), F.ceil(F.count("*") / 20_000)).alias("parts"))
        rows = rows.join(crowd, "key").withColumn("part", F.col("part") % F.col("parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        pts, res = (df.join(crowd, "key").withColumn("part", each) for df in (pts, res))
        held = pts.groupBy("key", "part", "next").agg(F.sort_array(F.collect_list(F.struct("pt_id", "x"))).alias("pts"))  # one strip's points
        held = held.join(res.select("key", "part", "next", F.col("x").alias("w"), "s", "su"), ["key", "part", "next"])

        def run(ask: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            q = np.array(ask["x"].tolist(), float).reshape(len(ask), dims)
            sides = {int(r.next): r for r in near.itertuples()}
            k, w, blocks = [np.zeros((len(q), 0))], [np.zeros(0)], []
            for side in (0, 1):
                r = sides.get(side)
                x = np.array([p["x"] for p in r.pts], float).reshape(len(r.pts), dims) if r is not None else np.zeros((0, dims))
                k.append(wendland_block(q, x, hyper))
                w.append(np.frombuffer(r.w, float) if r is not None else np.zeros(0))
                blocks.append(_square(r.s) if r is not None else np.zeros((0, 0)))
            n0, n1 = len(blocks[0]), len(blocks[1])
            cross = _block(sides[0].su, n0, n1) if n0 and n1 else np.zeros((n0, n1))
            s = np.block([[blocks[0], cross], [cross.T, blocks[1]]])
            near_k = np.concatenate(k, 1)
            return pd.DataFrame({"pred_id": ask["pred_id"], "m": mean + near_k @ np.concatenate(w), "v": np.maximum(0.0, hyper[0] - ((near_k @ s) * near_k).sum(1))})

        got = rows.groupBy("key", "part").cogroup(held.groupBy("key", "part")).applyInPandas(run, "pred_id long, m double, v double")
        return got.withColumnRenamed("pred_id", id_col)

    def likelihood_gradient(self) -> np.ndarray:
        """Of the log likelihood by each hyperparameter: half of a'dK a - tr(K^-1 dK); dK is zero outside the blocks at hand."""
        hyper, dims = self.hyper, len(self.hyper) - 1

        def slopes(pts: pd.DataFrame, res: pd.DataFrame) -> pd.DataFrame:
            x = {k: np.array(g.sort_values("pt_id")["x"].tolist(), float).reshape(len(g), dims) for k, g in pts.groupby("next")}
            by = {int(r.next): r for r in res.itertuples()}
            out = np.zeros(dims + 1)
            if 0 in by and 0 in x:
                a, s = np.frombuffer(by[0].x, float), _square(by[0].s)
                for k, d in enumerate(wendland_slopes(x[0], x[0], hyper)):
                    out[k] += 0.5 * (a @ d @ a - (s * d).sum())
                if 1 in by and 1 in x and by[0].su:
                    b, cross = np.frombuffer(by[1].x, float), _block(by[0].su, len(x[0]), len(x[1]))
                    for k, d in enumerate(wendland_slopes(x[0], x[1], hyper)):
                        out[k] += a @ d @ b - (cross * d).sum()
            return pd.DataFrame({"k": range(dims + 1), "slope": out})

        pts, res = self._pairs()
        got = pts.where("key >= 0").groupBy("key").cogroup(res.where("key >= 0").groupBy("key")).applyInPandas(slopes, "k int, slope double")
        sums = dict(got.groupBy("k").agg(F.sum("slope")).collect())
        return np.array([sums.get(k, 0.0) for k in range(dims + 1)])

    def point_slopes(self) -> DataFrame:
        """(i, slope): of the log likelihood along every coordinate of each point; targets, noise and mean stay as they are."""
        hyper, dims = self.hyper, len(self.hyper) - 1

        def slopes(pts: pd.DataFrame, res: pd.DataFrame) -> pd.DataFrame:
            pts = {int(k): g.sort_values("pt_id") for k, g in pts.groupby("next")}
            by, got = {int(r.next): r for r in res.itertuples()}, []

            def along(of: int, to: int, inverse: np.ndarray) -> None:
                """Adds what the places of side ``to`` pull on those of side ``of``; ``inverse`` has a row for each of the former."""
                a, b = (np.array(pts[k]["x"].tolist(), float).reshape(len(pts[k]), dims) for k in (of, to))
                own, other = (np.frombuffer(by[k].x, float) for k in (of, to))
                moves = list(wendland_point_slopes(b, a, hyper))
                pull, spread = np.stack([other @ d for d in moves], 1), np.stack([(inverse * d).sum(0) for d in moves], 1)
                got.append(pd.DataFrame({"i": pts[of]["pt_id"].to_numpy(), "alpha": own, "pull": pull.tolist(), "spread": spread.tolist()}))

            if 0 in by and 0 in pts:
                along(0, 0, _square(by[0].s))
                if 1 in by and 1 in pts and by[0].su:
                    cross = _block(by[0].su, len(pts[0]), len(pts[1]))
                    along(0, 1, cross.T)
                    along(1, 0, cross)
            return pd.concat(got) if got else pd.DataFrame({"i": [], "alpha": [], "pull": [], "spread": []})

        pts, res = self._pairs()
        got = pts.where("key >= 0").groupBy("key").cogroup(res.where("key >= 0").groupBy("key")).applyInPandas(slopes, "i long, alpha double, pull array<double>, spread array<double>")
        added = lambda c: F.array(*[F.sum(F.get(c, k)) for k in range(dims)]).alias(c)
        return self.places.slopes(got.groupBy("i").agg(F.min("alpha").alias("alpha"), added("pull"), added("spread")))
