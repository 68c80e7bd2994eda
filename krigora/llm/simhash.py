"""SimHash near-duplicates through a hierarchical index in Gray order.

``near_duplicates`` links fingerprints of 64 bits within two bits. Two such fingerprints agree in at least one of three blocks,
so Spark deals every distinct fingerprint to three buckets, each of the leading bits of one block, as many bits as leave a few
thousand fingerprints to a bucket. In a bucket the fingerprints are sorted by Gray rank; runs of them form the nodes of a tree,
a node holding the bits that all below it share and its parent does not. A query adds up its differences from the root down
and drops a whole node when they exceed the limit. Crowded buckets are dealt again by more bits.

``similar_texts`` finds texts that are alike by the Jaccard similarity of their shingles, which few equal bits don't cover: two
words of fingerprint per text are dealt to tables of sampled bits, the same index proposes what lies within a wide limit, and
the proposals are held against the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_arrow, shuffle_partitions, text_bytes, written
from .components import components

_FAN = 8
#: Most fingerprints (24 bytes each) that are broadcast; beyond it their rows are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words whose hashes a task keeps.
MOST_WORDS = 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of lower-cased ``shingle``-word shingles, repeats counted; 0 without words, all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = np.concatenate([[0], ends[:-1]]), ends - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(first[: len(words) - k + 1].tolist(), last[k - 1 :].tolist(), strict=True)], np.uint64)
    return int(_majority(h)[0])


def _majority(h: np.ndarray) -> np.ndarray:
    """Word whose bits are set in more than half of ``h``; ``h`` may have a column per word."""
    h = h.reshape(len(h), -1)
    ones = np.zeros(64 * h.shape[1], np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(np.ascontiguousarray(h[i : i + (1 << 15)]).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long. A null text counts as empty."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b):
                fps = np.fromiter((fingerprint(t, shingle) for t in _texts(part.column(1))), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return in_arrow(picked, run, picked.select("doc_id").schema.add("fp", "long"))


def _texts(column: pa.Array) -> list[bytes]:
    data, off = text_bytes(column)
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Tree over fingerprints (one or more 64-bit words a row) in Gray order; a level's node covers ``_FAN`` nodes below it.

    ``visited`` counts the nodes that were looked at, ``pruned`` the fingerprints below nodes that were dropped whole.
    """

    def __init__(self, fps: np.ndarray) -> None:
        fps = fps.reshape(len(fps), -1)
        self.order = np.lexsort([gray_rank(w) for w in reversed(fps.T)])
        self.fps = fps[self.order]
        self.visited = self.pruned = 0
        ands, ors = [self.fps], [self.fps]
        while len(ands[-1]) > 1:
            at = np.arange(0, len(ands[-1]), _FAN)
            ands.append(np.bitwise_and.reduceat(ands[-1], at))
            ors.append(np.bitwise_or.reduceat(ors[-1], at))
        # own: the bits that a node's members share and its parent's do not; bits: their values.
        self.own, self.bits, above = [], [], None
        for a, o in zip(reversed(ands), reversed(ors), strict=True):
            same = ~(a ^ o)
            own = same if above is None else same & ~np.repeat(above, _FAN, axis=0)[: len(a)]
            self.own.append(own)
            self.bits.append(a & own)
            above = same

    def links(self, limit: int, queries: np.ndarray | None = None, step: int = 2048, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions that differ in at most ``limit`` bits, a bounded number at a time.

        Without ``queries`` every pair (i < j) comes once; else the pairs of the positions in ``queries`` with all others.
        """
        asked = np.arange(len(self.fps)) if queries is None else queries
        for i in range(0, len(asked), step):
            q = asked[i : i + step]
            yield from self._walk(q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), 0, limit, queries is None, most)

    def _walk(self, q: np.ndarray, node: np.ndarray, acc: np.ndarray, depth: int, limit: int, half: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        acc = acc + np.bitwise_count((self.fps[q] ^ self.bits[depth][node]) & self.own[depth][node]).sum(1, dtype=np.int64)
        width = _FAN ** (len(self.own) - 1 - depth)
        keep = acc <= limit
        self.visited += len(q)
        self.pruned += width * int((~keep).sum())
        if half:
            keep &= (node + 1) * width - 1 > q
        q, node, acc = q[keep], node[keep], acc[keep]
        if depth == len(self.own) - 1:
            if len(q):
                yield q, node
            return
        below = len(self.own[depth + 1])
        step = max(1, most // _FAN)
        for i in range(0, len(q), step):
            part = slice(i, i + step)
            child = (node[part][:, None] * _FAN + np.arange(_FAN)).ravel()
            real = child < below
            yield from self._walk(np.repeat(q[part], _FAN)[real], child[real], np.repeat(acc[part], _FAN)[real], depth + 1, limit, half, most)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (the least position) after the links (i, j)."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while ((nxt := label[label]) != label).any():
            label = nxt


def bucket_roots(fps: np.ndarray, limit: int, leaders: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints of a bucket: their order in the index and, for each place, the place of its component's first.

    A few leaders first gather what lies within the limit of them; the rows outside the largest set so found then ask the
    index for all their links. Every link between two sets has an end outside the largest, so none is missed, while a large
    group of near copies isn't taken pair by pair.
    """
    index = GrayIndex(fps)
    f, label = index.fps, np.arange(len(fps))
    free = np.ones(len(f), bool)
    for _ in range(leaders if len(f) > 64 else 0):
        rest = np.flatnonzero(free)
        if not len(rest):
            break
        near = np.flatnonzero(np.bitwise_count(f ^ f[rest[0]]).sum(1, dtype=np.int64) <= limit)
        free[near] = False
        label = joined(label, near, np.full(len(near), rest[0]))
    counts = np.bincount(label, minlength=len(f))
    outside = np.flatnonzero(label != counts.argmax()) if counts.max() > 1 else None
    for i, j in index.links(limit, outside):
        label = joined(label, i, j)
    return index.order, label


def in_buckets(solve, words: int):
    """Arrow batches (bucket columns..., node, words), sorted by bucket -> what ``solve(rows, keys)`` makes of whole buckets: rows
    are the columns, the first ``keys`` of them tell the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in b.columns])
            keys = len(rows) - 1 - words
            other = np.flatnonzero((rows[:keys] != rows[:keys, -1:]).any(0))
            cut = int(other[-1] + 1) if len(other) else 0  # rows of the last bucket may go on in the next batch
            if tail and not (tail[-1][:keys, -1] == rows[:keys, 0]).all():
                yield from solve(np.concatenate(tail, 1), keys)
                tail = []
            if cut:
                yield from solve(np.concatenate([*tail, rows[:, :cut]], 1), keys)
                tail = []
            tail.append(rows[:, cut:])
        if tail:
            yield from solve(np.concatenate(tail, 1), len(tail[0]) - 1 - words)

    return run


def index_links(limit: int, words: int):
    """Arrow batches (bucket columns..., node, words), sorted by bucket -> (u, v): links of each node to its component's first."""

    def solve(rows: np.ndarray, keys: int) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        edge = np.flatnonzero((rows[:keys, 1:] != rows[:keys, :-1]).any(0)) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([start, [rows.shape[1]]]))
        node, fp = rows[keys], rows[keys + 1 :].T.view(np.uint64) if words == 1 else np.ascontiguousarray(rows[keys + 1 :].T).view(np.uint64)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, _FAN + 1):  # one leaf of the tree: compared as it is
            at = start[size == n][:, None] + np.arange(n)
            for i, j in combinations(range(n), 2):
                near = np.bitwise_count(fp[at[:, i]] ^ fp[at[:, j]]).sum(1, dtype=np.int64) <= limit
                us.append(node[at[near, i]])
                vs.append(node[at[near, j]])
        for a, n in zip(start[size > _FAN].tolist(), size[size > _FAN].tolist(), strict=True):
            order, label = bucket_roots(fp[a : a + n], limit)
            linked = np.flatnonzero(label != np.arange(n))
            us.append(node[a + order[linked]])
            vs.append(node[a + order[label[linked]]])
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return in_buckets(solve, words)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _thirds(bits: list[int]) -> list[list[int]]:
    return [bits[len(bits) * k // 3 : len(bits) * (k + 1) // 3] for k in range(3)]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _refinements(lead: int) -> list[dict[int, list[int]]]:
    """Masks by level, each with those that deal a crowded bucket of it anew without losing a pair within two bits: the leading
    bits of a block, the whole block, then the block and a third of the other bits, and so on."""
    every = list(range(64))
    blocks = [(b[:lead], b) for b in _thirds(every)]
    levels = [{0: [_mask(a) for a, _ in blocks]}, {_mask(a): [_mask(b)] for a, b in blocks}]
    fixed = [b for _, b in blocks]
    for _ in range(2):
        finer = [(f, [f + t for t in _thirds([b for b in every if b not in f])]) for f in fixed]
        levels.append({_mask(f): [_mask(g) for g in more] for f, more in finer})
        fixed = [g for _, more in finer for g in more]
    return levels


def _dealt(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row (mask, key, fp) under the finer masks of its own."""
    finer = F.lit(None).cast("array<long>")
    for mask, more in masks.items():
        finer = F.when(F.col("mask") == mask, F.array(*[F.lit(m) for m in more])).otherwise(finer)
    return rows.select("fp", F.explode(finer).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def fingerprint_links(distinct: DataFrame, limit: int = 2, bucket_rows: int = 32_768, mean_rows: int = 2048) -> DataFrame:
    """(u, v) links that connect all fingerprints of ``distinct`` (fp) within ``limit`` (2 at most) bits, at most a bucket's size each.

    Buckets with more than ``bucket_rows`` fingerprints are dealt anew, three times at most; those that are still larger after
    that share 54 bits or so and are solved as they are (at most 2**10 fingerprints can).
    """
    assert limit <= 2, "one of three blocks agrees only up to two differing bits"
    lead = int(np.clip(np.ceil(np.log2(max(1, distinct.count()) / mean_rows)), 1, 21))
    first, *levels = _refinements(lead)
    rows = _dealt(distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), first)
    out = None
    for masks in levels:
        crowded = written(rows.groupBy("mask", "key").count().where(F.col("count") > bucket_rows).select("mask", "key"), "hot-buckets")
        n = crowded.count()
        if not n:
            break
        side = F.broadcast(crowded) if n <= 20_000 else crowded
        calm = rows.join(side, ["mask", "key"], "left_anti")
        out = calm if out is None else out.unionByName(calm)
        rows = _dealt(rows.join(side, ["mask", "key"]), masks)
    rows = rows if out is None else out.unionByName(rows)
    ready = rows.select("mask", "key", F.col("fp").alias("node"), "fp").repartition(shuffle_partitions(distinct.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
    return in_arrow(ready, index_links(limit, 1), "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", **buckets) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``limit`` bits) of every row.

    Equal fingerprints are one node, so copies cost nothing beyond their rows. A null or empty text has fingerprint 0 and links
    like any other; very long texts are hashed whole. Null ids never name a component; one of nothing but null ids has a null
    component_id. Ties don't arise (components don't hang on an order); repeated rows get equal results. An empty table gives
    no rows; extra columns are ignored, whatever their names.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct.select("fp"), limit, **buckets))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted-fingerprints")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(firsts, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# --- texts alike by the Jaccard similarity of their shingles


def shingle_hashes(text: bytes, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased ``shingle``-word shingles (all words, if fewer; none: no hash).

    ``known`` keeps the hashes of words that were met before."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w, 5)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h ^ w[j : j + len(h)])
    return np.unique(h)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Two words: the majority bits of the hashes and of a second hash of each; zeros without shingles."""
    return _majority(np.stack([hashes, mixed(hashes)], 1)) if len(hashes) else np.zeros(2, np.uint64)


def wide_plan(n: int, similarity: float, recall: float = 0.98, mean_rows: int = 64) -> tuple[int, int, int]:
    """(tables, bits of each, limit): bits so that about ``mean_rows`` unrelated texts share a bucket; tables so that texts at the
    threshold share one with probability ``recall``; and the bits of 128 in which at most 1 % of such texts differ more."""
    cosine = 2 * similarity / (1 + similarity)  # of two sets of one size at this Jaccard similarity
    differ = float(np.arccos(cosine) / np.pi)
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / mean_rows)), 4, 24))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - differ) ** bits)))
    return tables, bits, int(np.ceil(128 * differ + 2.33 * np.sqrt(128 * differ * (1 - differ))))


def _wide_buckets(tables: int, bits: int):
    """(node, w0, w1) -> (bucket, node, w0, w1) for each table: the bits at its own sampled places."""
    rng = np.random.default_rng(10)
    places = [rng.choice(128, bits, replace=False) for _ in range(tables)]
    power = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                words = np.stack([part.column(k).to_numpy() for k in (1, 2)], 1)
                on = np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for t, p in enumerate(places):
                    yield pa.RecordBatch.from_arrays([pa.array(on[:, p] @ power + (t << 32)), *part.columns], names=["bucket", "node", "w0", "w1"])

    return run


def _alike(similarity: float):
    """Arrow batches (cell, side, node, hashes), sorted by cell -> (u, v): links of nodes to the first of their component.

    Rows of side 1 meet those of side 2, rows of side 0 each other. All pairs are counted through their shared hashes at once.
    """

    def solve(side: list, node: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, keep = np.unique(node, return_index=True)
        side, node, sets = np.array(side)[keep], node[keep], [sets[k] for k in keep.tolist()]
        n = len(node)
        if n < 2:
            return
        size = np.fromiter(map(len, sets), np.int64, n)
        _, slot = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        label = np.arange(n)
        ends = np.cumsum(size)
        for s in range(0, n, 256):  # a stripe of rows against all
            e = min(s + 256, n)
            own = slice(int(ends[s] - size[s]), int(ends[e - 1]))
            order = np.argsort(slot[own], kind="stable")
            held, who = slot[own][order], owner[own][order] - s
            lo, hi = np.searchsorted(held, slot, "left"), np.searchsorted(held, slot, "right")
            shared = np.zeros((e - s) * n, np.int64)
            for at in range(0, len(slot), 1 << 12):  # at most 2**20 shared places at a time
                a, z = lo[at : at + (1 << 12)], hi[at : at + (1 << 12)]
                times = z - a
                mine = who[np.repeat(a - np.cumsum(times) + times, times) + np.arange(times.sum())]
                shared += np.bincount(mine * n + np.repeat(owner[at : at + (1 << 12)], times), minlength=len(shared))
            shared = shared.reshape(e - s, n)
            near = shared >= similarity * (size[s:e, None] + size[None] - shared) - 1e-9
            near &= (side[s:e, None] == 0) | (side[s:e, None] != side[None])
            i, j = np.nonzero(near)
            label = joined(label, i + s, j)
        linked = np.flatnonzero(label != np.arange(n))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, node, sets = None, [], [], []
        for b in batches:
            for c, s, k, h in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c != cell and cell is not None:
                    yield from solve(side, np.array(node), sets)
                    side, node, sets = [], [], []
                cell = c
                side.append(s)
                node.append(k)
                sets.append(np.frombuffer(h, "<u8"))
        if cell is not None:
            yield from solve(side, np.array(node), sets)

    return run


def without_crowds(nodes: DataFrame, n: int, deal, bucket_rows: int = 32_768, rate: int = 64) -> DataFrame:
    """``deal(nodes)``, rows (bucket, node, words...), where a bucket that crowds a task is dealt to pairs of its blocks.

    Whether it does is told from every ``rate``-th node (by hash), which changes how rows are dealt, not what meets.
    """
    dealt = deal(nodes)
    if n <= bucket_rows:
        return dealt
    sample = deal(nodes.where(F.pmod(F.xxhash64(F.col(nodes.columns[0]), F.lit(3)), F.lit(rate)) == 0))
    counted = sample.groupBy("bucket").count().where(F.col("count") > 0.6 * bucket_rows / rate)
    crowded = written(counted.select("bucket", F.ceil(F.col("count") * rate / bucket_rows).alias("blocks")), "crowded-buckets")
    k = crowded.count()
    if not k:
        return dealt
    met = dealt.join(F.broadcast(crowded) if k <= 100_000 else crowded, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(pair).alias("bucket"), *dealt.columns[1:])


def similar_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98, block_rows: int = 512, bucket_rows: int = 32_768) -> DataFrame:
    """doc_id, a, b (hashes of the text) and component_id of every row: the smallest doc_id reachable over texts whose distinct
    ``shingle``-word shingles (lower-cased; all words, if fewer) have a Jaccard similarity of ``similarity`` or more.

    Texts of one wide fingerprint are one node (two texts at the threshold share all 128 bits once in a billion times). The index
    proposes what lies within ``wide_plan``'s limit, which leaves out about 3 % of pairs right at the threshold; every proposed
    group is then compared by its shingles, in cells of at most two blocks of ``block_rows`` texts, so no group is one task's. Null and empty texts have no shingles and are copies of each other; very long texts count whole.
    Null ids never name a component. Repeated rows get equal results; an empty table gives no rows; extra columns are ignored.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"))
    names = ["doc_id", "a", "b", "w0", "w1"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for part in by_bytes(b):
                if len(known) > MOST_WORDS:
                    known.clear()
                w = np.array([wide_fingerprint(shingle_hashes(t, shingle, known)) for t in _texts(part.column(3))], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(w[:, 0]), pa.array(w[:, 1])], names=names)

    rows = written(in_arrow(picked, hashed, picked.drop("text").schema.add("w0", "long").add("w1", "long")), "wide-fingerprints")
    nodes = rows.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "a", "b")).alias("first"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    n = nodes.count()
    tables, bits, limit = wide_plan(n, similarity, recall)
    dealt = without_crowds(nodes.select("node", "w0", "w1"), n, lambda some: in_arrow(some, _wide_buckets(tables, bits), "bucket long, node long, w0 long, w1 long"), bucket_rows)
    proposed = in_arrow(dealt.repartition(4 * parts, "bucket").sortWithinPartitions("bucket"), index_links(limit, 2), "u long, v long")
    groups = written(components(proposed), "wide-groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    member = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    member = member.join(nodes.select("node", "first.*"), "node").select("node", "root", "block", "blocks", F.col("doc_id").alias("first_id"), F.col("a").alias("first_a"), F.col("b").alias("first_b"))
    member = written(member, "wide-members")
    side = F.broadcast(member) if member.count() <= BROADCAST_ROWS // 4 else member
    texts = picked.join(side, (F.col("a") == F.col("first_a")) & (F.col("b") == F.col("first_b")) & F.col("doc_id").eqNullSafe(F.col("first_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for part in by_bytes(b):
                if len(known) > MOST_WORDS:
                    known.clear()
                h = [shingle_hashes(t, shingle, known).astype("<u8").tobytes() for t in _texts(part.column(4))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(h, pa.binary())], names=["node", "root", "block", "blocks", "hashes"])

    held = in_arrow(texts.select("node", "root", "block", "blocks", "text"), sets, "node long, root long, block long, blocks long, hashes binary")
    # Every two blocks of a group meet in one cell, and each block meets itself in one.
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    which = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    ready = met.select(cell.alias("cell"), which.alias("side"), "node", "hashes").repartition(4 * parts, "cell").sortWithinPartitions("cell")
    links = in_arrow(ready, _alike(similarity), "u long, v long")
    rooted = nodes.join(components(links).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("w0", "w1", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "wide-rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(firsts, "root").select("w0", "w1", "component_id"), ["w0", "w1"]).select("doc_id", "a", "b", "component_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """Rows of ``docs`` without those whose group of near copies (``similar_texts``) has a smaller id.

    Rows repeated under one id stay as they are. The ids that go are broadcast while they are few; beyond that (1,000,000
    rows) the rows are shuffled to meet them. Column names of ``docs`` don't matter, nor do extra columns.
    """
    marked = similar_texts(docs, similarity, shingle, id_col, text_col, **search)
    gone = written(marked.where("doc_id <> component_id").select("doc_id", "a", "b").distinct(), "near-copies")
    names = ["_gone_id", "_gone_a", "_gone_b"]
    side = gone.toDF(*names)
    side = F.broadcast(side) if gone.count() <= BROADCAST_ROWS else side
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    on = (F.col("row").getField(id_col) == F.col(names[0])) & (F.xxhash64(text) == F.col(names[1])) & (F.xxhash64(F.lit(7), text) == F.col(names[2]))
    return docs.select(F.struct("*").alias("row")).join(side, on, "left_anti").select("row.*")
