"""Vector code compression: codebooks of vector parts, learned and applied over a trie of the distinct parts.

A vector is cut into equal parts. The distinct parts of each place, with how often they occur, are sorted: neighbours share
their first dimensions, so they are the leaves of a trie. The traversal goes depth first: it takes one subtree of the first
dimension's values after the other, carries the distances from a prefix to all entries down to the longer prefixes (each prefix is
added up once, whatever number of parts begins with it), and the leaves take the nearest entry and add their weights to its
sums. Spark holds the distinct parts; a round is one job over them that brings home a few sums an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shuffle_partitions, written

#: Whole components are clipped to this size either way, far beyond any embedding, so that squared distances fit 64 bits.
MOST = 1 << 24
#: Leaves of the subtrees that are taken at once, so that the distances on the way stay small.
LEAVES = 4096
#: Labels whose sums are broadcast; more of them are joined.
BROADCAST_LABELS = 100_000


class Trie:
    """The lexicographic trie over ``parts`` (sorted, distinct rows): for each depth, the node of a leaf and the nodes' parents."""

    def __init__(self, parts: np.ndarray) -> None:
        self.parts = parts
        n, dims = parts.shape
        changes = np.zeros((n, dims), bool)
        changes[:1] = True
        if n > 1:
            changes[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
        self.starts = [np.flatnonzero(changes[:, k]) for k in range(dims)]  # the first leaf below each node of depth k

    def nodes(self) -> int:
        return sum(map(len, self.starts))

    def subtrees(self, leaves: int = LEAVES) -> Iterator[tuple[int, int]]:
        """Leaf ranges of runs of whole subtrees of the root, in order, of about ``leaves`` leaves; a larger subtree is one run cut
        where its own children begin (a prefix is then added up once for each cut)."""
        n, at = len(self.parts), 0
        while at < n:
            end = min(at + leaves, n)
            for starts in self.starts if end < n else []:
                k = int(np.searchsorted(starts, end, "right")) - 1
                if starts[k] > at:
                    end = int(starts[k])
                    break
            yield at, end
            at = end

    def distances(self, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, end, squared distances of these leaves to all ``entries``), depth first."""
        for first, end in self.subtrees():
            held = np.zeros((1, len(entries)), np.int64)
            heads = np.array([first])
            for k, starts in enumerate(self.starts):
                lo, hi = np.searchsorted(starts, [first, end])
                nodes = starts[lo:hi]
                if not len(nodes) or nodes[0] != first:
                    nodes = np.concatenate([[first], nodes])  # a prefix that began in the run before
                parent = np.searchsorted(heads, nodes, "right") - 1
                step = self.parts[nodes, k][:, None] - entries[:, k]
                held = held[parent] + step * step
                heads = nodes
            yield first, end, held


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equal ones) and its squared distance for sorted, distinct parts."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for first, end, d in Trie(parts).distances(entries):
        code[first:end] = d.argmin(1)
        error[first:end] = d[np.arange(end - first), code[first:end]]
    return code, error


def _lists(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _round(books: list[np.ndarray]):
    """Arrow batches (place, part, n), sorted -> (place, entry, n, sums): what the parts of each entry add up to in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for b in batches:
            place, parts, n = b.column(0).to_numpy(), _lists(b.column(1), b.num_rows), b.column(2).to_numpy()
            for p in np.unique(place):
                at = np.flatnonzero(place == p)
                code, weight = assign(parts[at], books[p])[0], n[at]
                np.add.at(sums[p], code, np.concatenate([weight[:, None], parts[at] * weight[:, None]], 1))
        place, entry = (np.concatenate(c) for c in zip(*[(np.full(len(s), p), np.arange(len(s))) for p, s in enumerate(sums)], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(entry), pa.array(list(np.concatenate(sums)))], names=["place", "entry", "sums"])

    return run


def _encode(books: list[np.ndarray]):
    """Arrow batches (vec_id, label, vector) -> (vec_id, label, code, error); a batch makes a trie of its own distinct parts for
    every place, so a vector needs no join with what its parts have got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, dims = _lists(b.column(2), b.num_rows), books[0].shape[1]
            error, codes = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, len(books)), np.uint8)
            for p, entries in enumerate(books):
                parts, inverse = np.unique(x[:, p * dims : (p + 1) * dims], axis=0, return_inverse=True)
                code, off = assign(parts, entries)
                codes[:, p] = code[inverse.ravel()]
                error += off[inverse.ravel()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vector of whole numbers) of the usable rows and the length of a part."""
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).where(F.coalesce(fine, F.lit(False)))
    dims = max(1, -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts))
    whole = F.transform("vector", lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(F.lit(scale) * v.cast("double")).cast("double"))).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(parts * dims) - F.size("vector")))
    return written(rows.select("vec_id", "label", padded.alias("vector")), "whole-vectors"), dims


def distinct_parts(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """(place, part, n) of all vectors, in lexicographic order from file to file."""
    each = rows.select(F.posexplode(F.array(*[F.slice("vector", p * dims + 1, dims) for p in range(parts)])).alias("place", "part"))
    counted = each.groupBy("place", "part").agg(F.count("*").alias("n"))
    return written(counted.repartitionByRange(shuffle_partitions(rows.sparkSession), "place", "part").sortWithinPartitions("place", "part"), "distinct-parts")


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector.

    Components x become floor(scale * x). A place's codebook starts as the parts of the ``entries`` smallest ids (rows repeated
    under one id by their vector, null ids last; all, if fewer) and takes ``rounds`` of assignment to the nearest entry (squared
    distance, ties to the first) and of moving every entry to the floor of its parts' mean; unused entries stay. ``code`` has
    two hex digits a part, ``error`` sums the squared distances, ``label_error`` the errors of all rows of a label, null ones
    together.

    Rows whose vector is null or has null or non-finite components are left out. Vectors shorter than the longest, or than a
    multiple of ``parts``, count as ending in zeros; an empty one is all zeros. Components beyond 2**24 either way are clipped.
    Repeated rows get equal results. An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"a code has two hex digits: 1 to 256 entries, not {entries}")
    spark = vectors.sparkSession
    rows, dims = whole_vectors(vectors, id_col, label_col, vector_col, scale, parts)
    first = np.array([r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()], np.int64).reshape(-1, parts * dims)
    books = [first[:, p * dims : (p + 1) * dims].copy() for p in range(parts)]
    distinct = distinct_parts(rows, parts, dims)
    for _ in range(rounds if len(first) else 0):
        got = in_arrow(distinct, _round(books), "place long, entry long, sums array<long>")
        sums = got.groupBy("place", "entry").agg(*[F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(dims + 1)])
        for r in sums.where("s0 > 0").collect():  # one row an entry
            books[r["place"]][r["entry"]] = [r[f"s{k}"] // r["s0"] for k in range(1, dims + 1)]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    coded = written(in_arrow(rows, _encode(books), "vec_id long, label long, code string, error long"), "vector-codes")
    total = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if total.count() <= BROADCAST_LABELS:
        both = coded.join(F.broadcast(total), F.col("label").eqNullSafe(F.col("of")))
    else:  # a label may hold a third of the rows
        salted = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        both = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(64)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other: parts meet the codebook of the round before, each entry becomes the floor of its mean."""
    sql = f"""WITH RECURSIVE r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM r, range({parts}) t(p)),
c AS (SELECT 0 AS it, p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
  UNION ALL SELECT it + 1, p, e, c FROM (
    WITH d AS (SELECT c.it, x.p, vec_id, x, c.e, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c.c[k]) ** 2))::BIGINT AS d FROM x JOIN c ON c.p = x.p AND c.it < {rounds}),
    n AS (SELECT it, p, x, e FROM d QUALIFY row_number() OVER (PARTITION BY p, vec_id ORDER BY d, e) = 1),
    m AS (SELECT p, e, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS m FROM n, range(1, 1 + (SELECT max(len(x)) FROM x)) t(k) GROUP BY p, e, k),
    g AS (SELECT p, e, list(m ORDER BY k) AS c FROM m GROUP BY p, e)
    SELECT c.it, c.p, c.e, coalesce(g.c, c.c) AS c FROM c LEFT JOIN g ON g.p = c.p AND g.e = c.e WHERE c.it < {rounds})),
f AS (SELECT p, e, c FROM c WHERE it = {rounds}),
d AS (SELECT vec_id, x.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) ** 2))::BIGINT AS d FROM x JOIN f ON f.p = x.p),
n AS (SELECT vec_id, p, e, d FROM d QUALIFY row_number() OVER (PARTITION BY p, vec_id ORDER BY d, e) = 1),
v AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM f)
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r ON r.vec_id = v.vec_id, h"""
    return sql


ORACLE = _oracle()
