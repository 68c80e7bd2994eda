"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Each table rotates the unit vectors by three rounds of random signs and a Hadamard transform and hashes to the nearest signed
axis, twice over; a vector also enters the buckets of its next-best axes. Vectors that share a bucket propose each other by
their sketches (signs of random projections), and every proposed pair is verified once by its cosine in double precision, so
that proposals never run together into groups. Only where a bucket proposes more pairs than a fixed number for each of its
rows (near copies in numbers) are its groups compared as a whole: their pairs are no rows, and a large group is dealt to pairs
of its blocks. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shuffle_partitions, written
from .components import components
from .simhash import in_buckets, joined, mixed, without_crowds

#: Words of a sketch, and proposed pairs for each row of a bucket up to which pairs are verified one by one.
WORDS, PAIRS_A_ROW = 4, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        v = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probes(units: np.ndarray, table: int, hashes: int, n_probes: int, seed: int = 8) -> np.ndarray:
    """Bucket numbers of each row in one table: the best ``n_probes`` combinations of signed axes over ``hashes`` rotations."""
    n = 1 << max(1, (units.shape[1] - 1).bit_length())
    x = np.zeros((len(units), n))
    x[:, : units.shape[1]] = units
    keys, costs = np.zeros((len(units), 1), np.int64), np.zeros((len(units), 1))
    for k in range(hashes):
        rng = np.random.default_rng([seed, table, k])
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], n))
        near = min(3, n)
        axis = np.argpartition(-np.abs(y), near - 1, axis=1)[:, :near]
        value = np.take_along_axis(y, axis, 1)
        top = np.abs(value).max(1, keepdims=True)
        code, cost = 2 * axis + (value < 0), (top - np.abs(value)) ** 2
        keys = (keys[:, :, None] * (2 * n) + code[:, None, :]).reshape(len(units), -1)
        costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(units), -1)
    best = np.argsort(costs, axis=1, kind="stable")[:, :n_probes]
    return np.take_along_axis(keys, best, 1)


def classes(rows: DataFrame) -> DataFrame:
    """rep (the smallest id), members, vector of every distinct usable vector of ``rows`` (vec_id, vector)."""
    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(3), "vector").alias("h2"))
    return keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("vector").alias("vector"))


def sketches(units: np.ndarray, seed: int = 9) -> np.ndarray:
    """Words of signs of random projections of each row; of b bits, vectors at an angle of t differ in b t / pi on average."""
    planes = np.random.default_rng(seed).normal(size=(units.shape[1], 64 * WORDS))
    return np.packbits(units @ planes > 0, axis=1, bitorder="little").view("<u8")


def sketch_limit(threshold: float) -> int:
    """Bits in which at most 1 % of pairs at the threshold differ more."""
    differ = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    bits = 64 * WORDS
    return int(np.ceil(bits * differ + 2.33 * np.sqrt(bits * differ * (1 - differ)) + 0.5))


def _propose(limit: int):
    """Arrow batches (bucket, node, words), sorted by bucket -> (u, v, dense): pairs whose sketches differ in ``limit`` bits or fewer;
    in buckets with too many of them each node's component's first, and dense."""

    def pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        n, found, total, label = len(fp), [], 0, np.arange(len(fp))
        for s in range(0, n, 256):
            near = np.bitwise_count(fp[s : s + 256, None] ^ fp[None, s:]).sum(2, dtype=np.int16) <= limit
            i, j = np.nonzero(near)
            i, j = i[i < j] + s, j[i < j] + s
            total += len(i)
            label = joined(label, i, j)
            if total <= PAIRS_A_ROW * n:
                found.append((i, j))
        if total > PAIRS_A_ROW * n:
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at], True
        return (*(np.concatenate(c) for c in zip(*found, strict=True)), False)

    def solve(rows: np.ndarray, keys: int) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero((rows[:keys, 1:] != rows[:keys, :-1]).any(0)) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([start, [rows.shape[1]]]))
        node, fp = rows[keys], np.ascontiguousarray(rows[keys + 1 :].T).view(np.uint64)
        us, vs, dense = [], [], []
        for n in range(2, 9):  # small buckets, all of a size at once
            at = start[size == n][:, None] + np.arange(n)
            for i in range(n):
                for j in range(i + 1, n):
                    near = np.bitwise_count(fp[at[:, i]] ^ fp[at[:, j]]).sum(1, dtype=np.int64) <= limit
                    us.append(node[at[near, i]])
                    vs.append(node[at[near, j]])
                    dense.append(np.zeros(len(us[-1]), bool))
        for a, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            i, j, many = pairs(fp[a : a + n])
            us.append(node[a + i])
            vs.append(node[a + j])
            dense.append(np.full(len(i), many))
        if us and sum(map(len, us)):
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.concatenate(dense))], names=["u", "v", "dense"])

    return in_buckets(solve, WORDS)


def _verify(threshold: float):
    """Arrow batches (u, v, mu, mv, a, b) -> (u, v, n) both ways for pairs of vectors with cosine >= ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if not p.num_rows:
                continue
            cosine = (_units(p.column(4), p.num_rows) * _units(p.column(5), p.num_rows)).sum(1)
            u, v, mu, mv = (p.column(k).to_numpy()[cosine >= threshold] for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((u, v), (v, u), (mv, mu))], names=["u", "v", "n"])

    return run

def _units(column: pa.Array, rows: int) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_NAMES = [f"w{k}" for k in range(WORDS)]


def _deal(tables: int, hashes: int, n_probes: int):
    """Arrow batches (rep, vector) -> (bucket, node, words) for every bucket that a vector probes; buckets are numbered across tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _units(part.column(1), part.num_rows)
                rows = np.stack([part.column(0).to_numpy(), *sketches(x).view(np.int64).T])
                for t in range(tables):
                    keys = probes(x, t, hashes, n_probes)
                    bucket = mixed(keys.ravel().view(np.uint64) * np.uint64(2 * tables + 1) + np.uint64(t)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket, *np.repeat(rows, keys.shape[1], axis=1))], names=["bucket", "node", *_NAMES])

    return run


def search_plan(n: int, dim: int, threshold: float, recall: float, n_probes: int) -> tuple[int, int]:
    """(tables, hashes): hashes so that a bucket of unrelated vectors stays small, tables so that a pair at the threshold meets
    in some table with probability ``recall``. The chance of meeting in one table is measured on random pairs at the threshold."""
    hashes = max(1, round(np.log(max(n, 16) / 8) / np.log(2.0 * max(2, dim))))
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b
    ka, kb = probes(a, 0, hashes, n_probes), probes(b, 0, hashes, n_probes)
    meet = float((ka[:, :, None] == kb[:, None, :]).any((1, 2)).mean())
    return int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(meet, 1e-3), 0.999)))), hashes


def _cell_links(threshold: float):
    """Arrow batches (cell, side, rep, members, vector), sorted by cell -> (u, v, n): for a class u, the members of the classes of
    this cell that it links with, and a class v of its component.

    A cell's rows of side 1 meet those of side 2, rows of side 0 meet each other, so every pair of a group meets in one cell.
    """

    def solve(side: np.ndarray, reps: np.ndarray, members: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = vectors.astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n, label = np.zeros(len(x), np.int64), np.arange(len(x))
        first, second = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(x)),) * 2
        for s in range(0, len(first), 512):
            rows = first[s : s + 512]
            i, j = np.nonzero(x[rows] @ x[second].T >= threshold)
            i, j = rows[i], second[j]
            i, j = (i, j) if side.any() else (i[i < j], j[i < j])
            np.add.at(n, i, members[j])
            np.add.at(n, j, members[i])
            label = joined(label, i, j)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[label[at]]), pa.array(n[at])], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell, side, reps, members = (b.column(k).to_numpy() for k in range(4))
            rows = (cell, side, reps, members, b.column(4).flatten().to_numpy().reshape(b.num_rows, -1))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(cell[1:] != cell[:-1]) + 1):
                if held and held[-1][0][-1] != cell[part[0]]:
                    yield from solve(*(np.concatenate(c) for c in list(zip(*held, strict=True))[1:]))
                    held = []
                held.append(tuple(r[part] for r in rows))
        if held:
            yield from solve(*(np.concatenate(c) for c in list(zip(*held, strict=True))[1:]))

    return run


def proposals(own: DataFrame, n: int, tables: int, hashes: int, threshold: float, n_probes: int = 3, bucket_rows: int = 32_768) -> DataFrame:
    """(u, v, dense): what the buckets of the ``n`` classes ``own`` (rep, vector) propose, each pair once."""
    deal = lambda some: in_arrow(some, _deal(tables, hashes, n_probes), "bucket long, node long, " + ", ".join(f"{w} long" for w in _NAMES))
    dealt = without_crowds(own.select("rep", "vector"), n, deal, bucket_rows)
    ready = dealt.repartition(4 * shuffle_partitions(own.sparkSession), "bucket").sortWithinPartitions("bucket")
    return in_arrow(ready, _propose(sketch_limit(threshold)), "u long, v long, dense boolean").distinct()


def links(distinct: DataFrame, threshold: float = 0.9, recall: float = 0.995, n_probes: int = 3, block_rows: int = 2000, bucket_rows: int = 32_768, plan: tuple[int, int] | None = None) -> DataFrame:
    """(u, v, n) rows for classes (rep, members, vector): n sums to the members of all classes that have cosine >= ``threshold``
    with u; the pairs (u, v) connect the components.

    Buckets hold sketches, not vectors. A proposed pair is a row and meets its two vectors once, whatever tables proposed it;
    buckets give ``PAIRS_A_ROW`` pairs a row at most, else their groups go to cells of at most two blocks of ``block_rows``
    classes, where all of a group is compared and no pair is a row. A pair inside a group is not verified besides.
    """
    spark, parts = distinct.sparkSession, shuffle_partitions(distinct.sparkSession)
    lengths = [(r["dim"], r["n"]) for r in distinct.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").collect()]
    out = None
    for dim, n in lengths:  # vectors of another length have no cosine with these
        tables, hashes = plan or search_plan(n, dim, threshold, recall, n_probes)
        own = distinct.where(F.size("vector") == dim).select("rep", "members", "vector")
        proposed = written(proposals(own, n, tables, hashes, threshold, n_probes, bucket_rows), "vector-proposals")
        groups = written(components(proposed.where("dense").select("u", "v")), "vector-groups")
        pairs = proposed.where("NOT dense").select("u", "v")
        for end in ("u", "v"):
            pairs = pairs.join(groups.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root")), F.col(end) == F.col(f"{end}_node"), "left").drop(f"{end}_node")
        pairs = pairs.where("u_root IS NULL OR v_root IS NULL OR u_root <> v_root").select("u", "v")
        at = lambda end, name: own.select(F.col("rep").alias(end), F.col("members").alias(f"m{end}"), F.col("vector").alias(name))
        met = pairs.join(at("u", "a"), "u").join(at("v", "b"), "v").select("u", "v", "mu", "mv", "a", "b")
        found = in_arrow(met, _verify(threshold), "u long, v long, n long")
        out = found if out is None else out.unionByName(found)
        sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        member = groups.join(sizes, "root").select(F.col("node").alias("rep"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
        met = member.join(own, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cell = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        ready = met.select(cell.alias("cell"), side.alias("side"), "rep", "members", "vector").repartition(4 * parts, "cell").sortWithinPartitions("cell")
        out = out.unionByName(in_arrow(ready, _cell_links(threshold), "u long, v long, n long"))
    return out if out is not None else spark.createDataFrame([], "u long, v long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, **search) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors link with each
    other; links to a class of equal vectors count all its members. Vectors of different lengths never link (one search per length that occurs). Rows with equal
    ids are one vector each; a row with a null id links with nothing. Ties don't arise; very long vectors are one row each.
    An empty table gives no rows; extra columns are ignored.
    """
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda v: F.when(v == 0, F.abs(v)).otherwise(v)).alias("vector"))
    rows = rows.withColumn("fine", F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    good = rows.where("fine").select("vec_id", "vector")
    distinct = written(classes(good), "vector-classes")
    found = written(links(distinct, threshold, **search), "vector-links")
    degree = found.groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(found.select("u", "v"))
    solved = distinct.join(degree, F.col("rep") == F.col("u"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    solved = solved.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    done = good.select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(3), "vector").alias("h2")).join(solved, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
