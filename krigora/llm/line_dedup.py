"""Line dedup: documents probe a sharded minimal perfect hash over the repeated lines' hashes.

One pass hashes every long line to 128 bits and Spark counts the documents of each hash. Hashes that reach the threshold are
dealt to shards of bounded size; each shard becomes a minimal perfect hash (levels of bit arrays, a rank per block) that
indexes arrays of a 64-bit fingerprint, the count and the largest doc_id. In a second pass the documents' line hashes go to the
shards and probe the arrays; no line text is joined or shuffled. Lines so frequent that they would crowd one shard are few; they
have a small index of the same kind that goes to every task, and they are decided where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import in_arrow, shuffle_partitions, written

#: Most lines of the index that goes to every task.
HOT_LINES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    for m, s in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys: a key's level is the first whose bit it alone claimed."""

    def __init__(self, words: list[np.ndarray], ranks: np.ndarray) -> None:
        self.words, self.ranks = words, ranks  # per level 64-bit words; ones before each word over all levels
        self.first = np.cumsum([0] + [len(w) for w in words])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        left, words, level = np.arange(len(a)), [], 0
        while len(left):
            n = max(64, -(-2 * len(left) // 64) * 64)
            at = (_mix(a[left], b[left], level) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("keys are not distinct")
        ones = np.bitwise_count(np.concatenate(words)).astype(np.int64) if words else np.zeros(0, np.int64)
        return cls(words, np.cumsum(ones) - ones)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key from 0; -1 for some keys that are not in the set, any slot for the others."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, w in enumerate(self.words):
            at = (_mix(a[left], b[left], level) % np.uint64(64 * len(w))).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (w[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[self.first[level] + word] + below)[hit]
            left = left[~hit]
        return out


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; linear in the line, however many blanks it holds."""
    return F.translate(F.btrim(line, F.lit(" \t\n\v\f\r")), _UPPER, _LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """id, mark, pos, a, b: every line of ``rows`` (id, mark, text) whose key is long enough, as two 64-bit hashes."""
    parts = rows.where(F.length("text") >= min_chars).select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = parts.where(F.length("line") >= min_chars).select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("id", "mark", "pos", *_hashes(F.col("key")))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the lines of a shard: the perfect hash's bit arrays and the arrays that it indexes."""
    a, b = pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64)
    index = PerfectHash.build(a, b)
    order = np.argsort(index.slots(a, b))
    last = pdf["last"].to_numpy(np.int64, na_value=np.iinfo(np.int64).min)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "levels": [[w.tobytes() for w in index.words]], "prints": [b[order].tobytes()], "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()], "lasts": [last[order].tobytes()]})


class LineIndex:
    """The perfect hash with its arrays: a second hash of each key to tell strangers, and the largest doc_id that holds it."""

    def __init__(self, words: list[np.ndarray], prints: np.ndarray, lasts: np.ndarray) -> None:
        ones = np.bitwise_count(np.concatenate(words)).astype(np.int64) if words else np.zeros(0, np.int64)
        self.index, self.prints, self.lasts = PerfectHash(words, np.cumsum(ones) - ones), prints, lasts

    def probe(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and which of them are held by another id last."""
        known, drop = np.zeros(len(a), bool), np.zeros(len(a), bool)
        if not len(self.prints):
            return known, drop
        slot = self.index.slots(a.view(np.uint64), b.view(np.uint64))
        at = np.flatnonzero(slot >= 0)
        at = at[self.prints[slot[at]] == b.view(np.uint64)[at]]
        known[at] = True
        drop[at] = self.lasts[slot[at]] != ids[at]
        return known, drop


def _line_index(row) -> LineIndex:
    return LineIndex([np.frombuffer(w, "<u8") for w in row["levels"]], np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["lasts"], np.int64))


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``left`` (line hashes of one shard) whose line is dropped by the arrays in ``right`` or was decided before."""
    out = left["decided"].to_numpy(bool).copy()
    if len(left) and len(right):
        out |= _line_index(right.iloc[0]).probe(left["a"].to_numpy(), left["b"].to_numpy(), left["id"].to_numpy())[1]
    return left.loc[out, ["id", "mark", "pos"]]


def _decide(hot: LineIndex, shards: int):
    """Arrow batches (id, mark, pos, a, b) -> (shard, id, mark, pos, a, b, decided): lines that the hot index knows are dropped
    or left out here, dropped ones dealt evenly; the others go to the shard of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mark, pos, a, b = (c.to_numpy() for c in batch.columns)
            known, drop = hot.probe(a, b, ids)
            stay = ~known | drop
            shard = np.where(drop, shards + (mark ^ pos) % shards, a % shards)[stay]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array(x[stay]) for x in (ids, mark, pos, a, b)), pa.array(drop[stay])], names=["shard", "id", "mark", "pos", "a", "b", "decided"])

    return run


def repeated_lines(rows: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, int]:
    """(a, b, n, last) of every line key in at least ``min_docs`` rows, and how many keys there are in all rows."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= min_chars), line_key))
    once = rows.where(F.length("text") >= min_chars).select("id", F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    seen = Observation()
    counted = once.select("id", *_hashes(F.col("key"))).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    many = written(counted.observe(seen, F.sum("n").alias("lines")).where(F.col("n") >= min_docs), "repeated-lines")
    return many, seen.get["lines"] or 0


def dropped_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """id, mark, drops (line numbers) of the rows (id, mark, text) that lose lines."""
    many, lines = repeated_lines(rows, min_docs, min_chars)
    total = many.agg(F.sum("n")).first()[0] or 0
    # A hot line is in total / HOT_LINES rows or more, total in all: so at most HOT_LINES lines are (40 bytes each).
    bound = max(1000, total // HOT_LINES)
    found = many.where(F.col("n") >= bound).withColumn("shard", F.lit(0).cast("long")).toPandas()
    hot = _line_index(_build(found).iloc[0]) if len(found) else LineIndex([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shards = max(8 * shuffle_partitions(rows.sparkSession), -(-lines // 250_000))
    shard = F.pmod(F.col("a"), F.lit(shards))
    arrays = many.where(F.col("n") < bound).select(shard.alias("shard"), "a", "b", "n", "last").groupBy("shard").applyInPandas(_build, "shard long, levels array<binary>, prints binary, counts binary, lasts binary")
    arrays = written(arrays, "line-index")
    probes = in_arrow(_lines(rows, min_chars), _decide(hot, shards), "shard long, id long, mark long, pos int, a long, b long, decided boolean")
    dropped = probes.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInPandas(_probe, "id long, mark long, pos int")
    return dropped.groupBy("id", "mark").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays) of every row, and ``row`` (all columns as they came) with ``with_row``.

    A text is split at \\n (null or empty: one empty line). Lines whose key (ASCII white space stripped at both ends, A-Z
    lower-cased) has ``min_chars`` code points or more and is in ``min_docs`` rows or more go, except in rows with the largest
    doc_id that holds it; within such a row all of them stay. The others stay as they are, joined by \\n. A text without
    dropped lines is returned unchanged, a null one as null. Every row is a document, repeated rows too; a null id counts as
    the smallest. Very long texts are taken whole. Extra columns are ignored unless ``with_row``, whatever their names. An empty
    table gives no rows.
    """
    lowest = -(1 << 63)
    rows = docs.select((F.struct("*") if with_row else F.struct(F.col(id_col), F.col(text_col))).alias("row"))
    doc_id, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col)
    rows = rows.withColumn("id", F.coalesce(doc_id, F.lit(lowest))).withColumn("mark", F.xxhash64("id", text))
    gone = dropped_lines(rows.select("id", "mark", text.alias("text")), min_docs, min_chars).withColumnsRenamed({"id": "gone_id", "mark": "gone_mark"})
    lines = F.split(text, "\n", -1)
    stay = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drops"), lambda i: F.get(lines, i)), "\n")
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    return joined.select(*["row"] * with_row, doc_id.alias("doc_id"), F.coalesce(F.size(lines), F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drops").isNull(), text).otherwise(stay).alias("text"))


ORACLE = r"""
WITH l AS (SELECT doc_id, u.i AS i, u.line AS line, lower_az AS key FROM (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)) u,
    LATERAL (SELECT translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (k.key IS NOT NULL AND l.doc_id <> k.last) AS dropped FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
