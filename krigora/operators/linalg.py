"""Small dense and sparse linear algebra on what a Spark aggregate has brought to one place, and its Spark counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covariance import mirrored


class NotPositiveDefinite(ValueError):
    """The matrix has no Cholesky factor; the message names the usual causes."""


def cholesky(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise NotPositiveDefinite(f"no Cholesky factor: least diagonal {a.diagonal().min():.3g}, asymmetry {np.abs(a - a.T).max():.3g}; raise the noise or look for repeated points") from e


def forward(low: np.ndarray, b: np.ndarray, block: int = 128) -> np.ndarray:
    """Solves L y = b by blocks of rows."""
    y = np.array(b, float)
    for s in range(0, len(low), block):
        e = min(s + block, len(low))
        y[s:e] = np.linalg.solve(low[s:e, s:e], y[s:e] - low[s:e, :s] @ y[:s])
    return y


def backward(low: np.ndarray, b: np.ndarray, block: int = 128) -> np.ndarray:
    """Solves L' x = b by blocks of rows."""
    x = np.array(b, float)
    for e in range(len(low), 0, -block):
        s = max(0, e - block)
        x[s:e] = np.linalg.solve(low[s:e, s:e].T, x[s:e] - low[e:, s:e].T @ x[e:])
    return x


def solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return backward(low, forward(low, b))


def lower_inverse(low: np.ndarray, block: int = 256) -> np.ndarray:
    """Inverse of a lower triangle, by halves."""
    n = len(low)
    if n <= block:
        return np.linalg.solve(low, np.eye(n)) if n else np.zeros((0, 0))
    h = n // 2
    a, b = lower_inverse(low[:h, :h], block), lower_inverse(low[h:, h:], block)
    return np.block([[a, np.zeros((h, n - h))], [-b @ (low[h:, :h] @ a), b]])


def inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of the matrix whose Cholesky factor is ``low``."""
    w = lower_inverse(low)
    return w.T @ w


def logdet(low: np.ndarray) -> float:
    return float(2 * np.log(low.diagonal()).sum())


def extended(low: np.ndarray, cross: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Factor of [[A, B], [B', D]] from the factor of A: only the new rows are computed."""
    b = forward(low, cross)
    out = np.zeros((len(low) + len(new),) * 2)
    out[: len(low), : len(low)], out[len(low) :, : len(low)] = low, b.T
    out[len(low) :, len(low) :] = cholesky(new - b.T @ b)
    return out


def extended_inverse(inverse: np.ndarray, cross: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Inverse of the bordered matrix from the inverse of the old one."""
    u = inverse @ cross
    s = np.linalg.inv(new - cross.T @ u)
    return np.block([[inverse + u @ s @ u.T, -u @ s], [-s @ u.T, s]])


class Coo:
    """A symmetric sparse matrix as (i, j, v) arrays of its triangle i <= j."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> None:
        off = i != j
        order = np.argsort(np.concatenate([i, j[off]]), kind="stable")
        self.n, self.i = n, np.concatenate([i, j[off]])[order]
        self.j, self.v = np.concatenate([j, i[off]])[order], np.concatenate([v, v[off]])[order]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 2:
            return np.stack([self @ c for c in x.T], 1)
        return np.bincount(self.i, self.v * x[self.j], self.n)

    def diagonal(self) -> np.ndarray:
        on = self.i == self.j
        return np.bincount(self.i[on], self.v[on], self.n)


def block_jacobi(a: Coo, size: int = 64) -> Callable[[np.ndarray], np.ndarray]:
    """Preconditioner of local solves over runs of ``size`` rows."""
    blocks = -(-a.n // size)
    m = np.zeros((blocks, size, size))
    own = a.i // size == a.j // size
    m[a.i[own] // size, a.i[own] % size, a.j[own] % size] = a.v[own]
    spare = np.arange(a.n, blocks * size)
    m[spare // size, spare % size, spare % size] = 1.0
    inverses = np.linalg.inv(m)

    def apply(r: np.ndarray) -> np.ndarray:
        return (inverses @ np.pad(r, (0, blocks * size - a.n)).reshape(blocks, size, 1)).ravel()[: a.n]

    return apply


def conjugate_gradient(a, b: np.ndarray, x0: np.ndarray | None = None, precondition: Callable | None = None, tol: float = 1e-8, most: int = 10_000) -> np.ndarray:
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - a @ x
    z = precondition(r) if precondition else r
    p, rz, stop = z.copy(), r @ z, tol * np.linalg.norm(b)
    for k in range(most + 1):
        if np.linalg.norm(r) <= stop:
            break
        if k == most:
            raise RuntimeError(f"conjugate gradients are at a residual of {np.linalg.norm(r):.3g} after {most} iterations, not at {stop:.3g}")
        ap = a @ p
        step = rz / (p @ ap)
        x += step * p
        r -= step * ap
        z = precondition(r) if precondition else r
        rz, old = r @ z, rz
        p = z + (rz / old) * p
    return x


def minres(a, b: np.ndarray, tol: float = 1e-8, most: int = 10_000) -> np.ndarray:
    """Minimal residual iteration for a symmetric matrix (Lanczos with Givens rotations)."""
    x, beta = np.zeros_like(b), float(np.linalg.norm(b))
    if beta == 0:
        return x
    v_old, v = np.zeros_like(b), b / beta
    w_old, w, eta, bound = np.zeros_like(b), np.zeros_like(b), beta, tol * beta
    c_old, c, s_old, s, b_k = 1.0, 1.0, 0.0, 0.0, 0.0
    for _ in range(most):
        u = a @ v - b_k * v_old
        alpha = float(v @ u)
        u -= alpha * v
        b_next = float(np.linalg.norm(u))
        delta, r2, r3 = c * alpha - c_old * s * b_k, s * alpha + c_old * c * b_k, s_old * b_k
        r1 = float(np.hypot(delta, b_next))
        if r1 == 0:
            return x
        c_old, s_old, c, s = c, s, delta / r1, b_next / r1
        w_old, w = w, (v - r3 * w_old - r2 * w) / r1
        x += c * eta * w
        eta *= -s
        if abs(eta) <= bound or b_next == 0:
            return x
        v_old, v, b_k = v, u / b_next, b_next
    raise RuntimeError(f"the minimal residual iteration is at {abs(eta):.3g} after {most} iterations, not at {bound:.3g}")


def random_logdet(a, n: int, probes: int = 32, degree: int = 30, seed: int = 0) -> tuple[float, float]:
    """Stochastic Lanczos quadrature: estimate of log|A| and the variance of that estimate."""
    rng, got = np.random.default_rng(seed), []
    for _ in range(probes):
        v = rng.choice([-1.0, 1.0], n) / np.sqrt(n)
        basis, alpha, beta, old = [v], [], [], np.zeros(n)
        for k in range(min(degree, n)):
            u = a @ basis[-1] - (beta[-1] if beta else 0.0) * old
            alpha.append(float(basis[-1] @ u))
            u -= alpha[-1] * basis[-1]
            q = np.stack(basis)
            u -= q.T @ (q @ u)
            size = float(np.linalg.norm(u))
            if size < 1e-10 or k == min(degree, n) - 1:
                break
            old = basis[-1]
            beta.append(size)
            basis.append(u / size)
        got.append(quadrature(alpha, beta[: len(alpha) - 1], n))
    return float(np.mean(got)), float(np.var(got, ddof=1) / probes) if probes > 1 else 0.0


def row_products(full: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    """``vectors`` (i, names...) with each column also as ``k_<name>``, the matrix times it; ``full`` has both triangles."""
    side = vectors.select(F.col("i").alias("j"), *names)
    got = full.join(side, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(c)).alias(f"k_{c}") for c in names])
    return vectors.join(got, "i", "left").fillna(0.0, [f"k_{c}" for c in names])


def quadrature(alpha: Sequence[float], beta: Sequence[float], n: int) -> float:
    """n times e1' log(T) e1 of the tridiagonal T from a Lanczos run."""
    w, vec = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
    return n * float((vec[0] ** 2 * np.log(np.maximum(w, 1e-300))).sum())


def spark_random_logdet(half: DataFrame, rows: DataFrame, probes: int = 32, degree: int = 30, seed: int = 0) -> tuple[float, float]:
    """``random_logdet`` with K and the probes as tables: rows (i) of signs by hash, one join and two sums a step for all probes.

    Only the tridiagonal coefficients reach the driver. A probe whose Krylov space is exhausted goes on as zeros.
    """
    from krigora.sources.store import discard, written

    full = written(mirrored(half.select("i", "j", "v")).repartition("i"), "lanczos-matrix")
    n, v, old = rows.count(), [f"v{k}" for k in range(probes)], [f"o{k}" for k in range(probes)]
    sign = lambda k: F.when(F.xxhash64("i", F.lit(seed), F.lit(k)) % 2 == 0, F.lit(n**-0.5)).otherwise(F.lit(-(n**-0.5)))
    state = rows.select("i", *[sign(k).alias(c) for k, c in enumerate(v)], *[F.lit(0.0).alias(c) for c in old])
    alpha, beta, live, before = [[] for _ in v], [[] for _ in v], [True] * probes, None
    for step in range(min(degree, n)):
        u = row_products(full, state, v)
        last = [b[-1] if b and on else 0.0 for b, on in zip(beta, live, strict=True)]
        u = written(u.select("i", *v, *[(F.col(f"k_{c}") - b * F.col(o)).alias(o) for c, o, b in zip(v, old, last, strict=True)]), "lanczos")
        if before is not None:
            discard(before)
        before = u
        a = u.agg(*[F.sum(F.col(c) * F.col(o)) for c, o in zip(v, old, strict=True)]).first()
        rest = [F.col(o) - float(x) * F.col(c) for c, o, x in zip(v, old, a, strict=True)]
        size = [float(x) ** 0.5 for x in u.agg(*[F.sum(r * r) for r in rest]).first()]
        for k in range(probes):
            if live[k]:
                alpha[k].append(float(a[k]))
                live[k] = size[k] >= 1e-10
                if live[k] and step < min(degree, n) - 1:
                    beta[k].append(size[k])
        if not any(live):
            break
        state = u.select("i", *[(r / s if on else F.lit(0.0)).alias(c) for r, s, on, c in zip(rest, size, live, v, strict=True)], *[F.col(c).alias(o) for c, o in zip(v, old, strict=True)])
    got = [quadrature(x, y, n) for x, y in zip(alpha, beta, strict=True)]
    return float(np.mean(got)), float(np.var(got, ddof=1) / probes) if probes > 1 else 0.0


def spark_block_inverses(half: DataFrame, blocks: DataFrame) -> DataFrame:
    """Triangle i <= j of the inverses of the diagonal blocks of ``half``; blocks: (i, block) with few rows each."""
    own = half.join(blocks, "i").join(blocks.select(F.col("i").alias("j"), F.col("block").alias("other")), "j").where(F.col("block") == F.col("other"))

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"].to_numpy())
        a, b = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        m = np.zeros((len(ids), len(ids)))
        m[a, b] = m[b, a] = pdf["v"].to_numpy()
        low = forward(cholesky(m), np.eye(len(ids)))
        r, c = np.triu_indices(len(ids))
        return pd.DataFrame({"i": ids[r], "j": ids[c], "v": (low.T @ low)[r, c]})

    return own.select("i", "j", "v", "block").groupBy("block").applyInPandas(invert, half.select("i", "j", "v").schema)


def spark_conjugate_gradient(half: DataFrame, rhs: DataFrame, tol: float = 1e-8, most: int = 10_000, blocks: DataFrame | None = None) -> DataFrame:
    """(i, v) solution of K x = rhs with K and all vectors as tables: for systems no single machine holds.

    Each iteration is one matrix-vector join and two sums, and one more join if ``blocks`` (i, block) gives a block-Jacobi
    preconditioner; state is written to the shared folder so lineage stays short. Raises if ``tol`` is not met.
    """
    from krigora.sources.store import discard, written

    inverse = written(mirrored(spark_block_inverses(half, blocks)).repartition("i"), "cg-blocks") if blocks is not None else None
    full = written(mirrored(half.select("i", "j", "v")).repartition("i"), "cg-matrix")

    def conditioned(rows: DataFrame) -> DataFrame:
        """Adds z, the preconditioner times r."""
        if inverse is None:
            return rows.withColumn("z", F.col("r"))
        return row_products(inverse, rows, ["r"]).withColumnRenamed("k_r", "z")

    def sums(rows: DataFrame) -> tuple[float, float]:
        return tuple(float(c or 0.0) for c in rows.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("z"))).first())

    held = written(conditioned(rhs.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.lit(0.0).alias("p"))), "cg")
    rr, rz = sums(held)
    stop, turn, left = tol * tol * rr, 0.0, most
    while rr > stop:
        if not left:
            raise RuntimeError(f"conjugate gradients are at {(rr / stop) ** 0.5 * tol:.3g} of the right side after {most} iterations, not at {tol:g}")
        left -= 1
        state = held.select("i", "x", "r", (F.col("z") + turn * F.col("p")).alias("p"))
        both = written(row_products(full, state, ["p"]), "cg")
        discard(held)
        bend = float(both.agg(F.sum(F.col("p") * F.col("k_p"))).first()[0])
        if not bend > 0:
            raise NotPositiveDefinite(f"p'Kp is {bend:.3g} in conjugate gradients")
        moved = both.select("i", (F.col("x") + rz / bend * F.col("p")).alias("x"), (F.col("r") - rz / bend * F.col("k_p")).alias("r"), "p")
        held = written(conditioned(moved), "cg")
        discard(both)
        old = rz
        rr, rz = sums(held)
        turn = rz / old
    return held.select("i", F.col("x").alias("v"))
