"""Language ID: the nearest of several centroids per language, in TF-IDF space of character n-grams.

Document frequencies are counted over all rows to learn from. A bounded sample per language is clustered into a few centroids
by spherical k-means; a text takes the language of the centroid with the largest cosine, and is rejected as foreign when it
lies farther from that centroid than nearly all of the centroid's own texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, in_arrow, with_arrow

SLOTS = 2048
_WORD = re.compile(r"[^\W\d_]+")
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str, slots: int = SLOTS) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of the lower-cased text, all but letters counting as one blank."""
    code = np.frombuffer((" " + " ".join(_WORD.findall(text.lower())) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, gram = np.zeros(slots, np.int64), np.zeros(len(code), np.uint64)
    shift = np.uint64(64 - (slots - 1).bit_length())
    for n in range(3):
        if len(code) <= n:
            break
        gram = (gram[: len(code) - n] if n else gram) * np.uint64(1_000_003) + code[n:]
        out += np.bincount(((gram + np.uint64(n + 1)) * _MULT[n] >> shift).astype(np.int64), minlength=slots)
    return out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log(1 + count) * idf."""
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    reach: np.ndarray  # largest distance (1 - cosine) that a centroid accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language ("und" for a text without letters or a model without languages), score, whether it was rejected."""
        lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), 256):
            rows = [i for i in range(at, min(at + 256, len(texts))) if has_letter(texts[i])]
            if not rows or not self.langs:
                continue
            cosine = tf_idf(np.stack([gram_counts(texts[i]) for i in rows]), self.idf) @ self.centroids.T
            best = cosine.argmax(1)
            top = cosine[np.arange(len(rows)), best].astype(float)
            for i, k in zip(rows, best.tolist(), strict=True):
                lang[i] = self.langs[k]
            score[rows] = np.clip(top, 0, 1)
            out[rows] = 1 - top > self.reach[best]
        return lang, score, out


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first centroids; fewer centroids when there are fewer distinct rows."""
    picked = [int(np.argmax(rows @ rows.mean(0)))]
    near = rows @ rows[picked[0]]
    while len(picked) < min(k, len(rows)) and near.min() < 1 - 1e-5:
        picked.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[picked[-1]])
    c = rows[picked]
    for _ in range(rounds):
        own = (rows @ c.T).argmax(1)
        new = np.stack([rows[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", k: int = 4, most_rows: int = 4000, least_rows: int = 64) -> CentroidModel:
    """Learns from the rows of ``docs`` with text and language.

    Document frequencies come from all of them. About ``most_rows`` rows in all, spread evenly over the languages but at least
    ``least_rows`` of each, chosen by a hash of id and text, go to the driver as n-gram counts (8 kB each) for clustering; rows
    with one id, text and language count once. The model holds up to ``k`` centroids of 8 kB per language, so it grows with the
    number of languages only.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("hash"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for part in by_bytes(b):
                for t in part.column(0).to_pylist():
                    df += gram_counts(t) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, SLOTS), pa.int32()), pa.array(np.concatenate([[n], df]))], names=["slot", "n"])

    got = dict(in_arrow(rows.select("text"), frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect())
    total = got.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + got.get(j, 0))) + 0.05 for j in range(SLOTS)], np.float32)
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return CentroidModel(idf, np.zeros((0, SLOTS), np.float32), [], np.zeros(0))
    each = max(least_rows, most_rows // len(sizes))
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(float(each / r["count"]))) for r in sizes))
    unit = F.pmod(F.xxhash64("hash", F.lit(6)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = rows.where(unit < F.element_at(share, F.col("lang"))).dropDuplicates(["id", "lang", "hash"])
    sample = with_arrow(chosen, lambda b: [pa.array([gram_counts(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()], pa.binary())], "grams binary", drop=("text",)).toPandas()
    sample = sample.sort_values(["lang", "id", "hash"], kind="stable")
    centroids, langs, reach = [], [], []
    for lang, part in sample.groupby("lang", sort=True):
        v = tf_idf(np.stack([np.frombuffer(g, np.int32) for g in part["grams"]]), idf)
        c = k_means(v, k)
        cosine = v @ c.T
        own = cosine.argmax(1)
        for j in range(len(c)):
            far = 1 - cosine[own == j, j]
            centroids.append(c[j])
            langs.append(lang)
            reach.append(min(1.0, 1.25 * float(np.quantile(far, 0.995)) + 0.02) if len(far) else 0.0)
    return CentroidModel(idf, np.stack(centroids) if centroids else np.zeros((0, SLOTS), np.float32), langs, np.array(reach))


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected of every row.

    A null text or one without letters is "und" with score 0 and rejected. Very short texts get the nearest language all the
    same, most often rejected; very long ones are taken whole. Of equal cosines the first centroid (by language) counts.
    Repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))

    def add(part: pa.RecordBatch) -> list[pa.Array]:
        lang, score, rejected = model.predict(part.column(2).to_pylist())
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_arrow(rows, add, "lang_pred string, score double, rejected boolean", drop=("text",))
