"""Quality rules: a document's character classes and common words against those of its language, by Jensen-Shannon distance.

The references are counted over all rows: the words of each language (tasks count them in bounded portions, Spark adds the
portions up), then totals of the commonest ones and of the character classes. A document is rejected when its
squared distance exceeds a margin plus what sampling alone would give a text of its length; short texts are not judged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_bytes, in_arrow, text_bytes, with_arrow

_PUNCTUATION = b".,;:!?"
_SPACE_BYTES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Distinct words that a task counts before it hands the counts on.
_MOST_COUNTED = 200_000


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 9)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[list(b" \t")], kind[list(b"\n\r\x0b\x0c")] = 3, 4
    kind[list(b".,;:?'\"()-")], kind[list(_SYMBOLS)], kind[ord("!")] = 5, 6, 10
    kind[0xC0:], kind[0x80:0xC0] = 7, 8  # first and further bytes of a non-ASCII character
    return kind


_CLASS = _byte_classes()
N_CLASSES = 11


def common_words(raw: bytes) -> Counter:
    return Counter(raw.lower().translate(None, _PUNCTUATION).split())


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES)


def repeated_window_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in some ``window``-word run found twice or more, the first included (64-bit hashes of the runs)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    run = np.zeros(n, np.uint64)
    for k in range(window):
        run = (run ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    order = np.sort(run)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(run, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_stats(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    solid = raw.translate(None, _SPACE_BYTES)
    b = np.frombuffer(solid, np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE_BYTES)]
    return len(words), int(((b & 0xC0) != 0x80).sum()), len(solid) - len(solid.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words)


def js_distance_squared(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits (the distance is its root)."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> float:
        on = a > 0
        return float((a[on] * np.log2(a[on] / m[on])).sum())

    return max(0.0, (kl(p) + kl(q)) / 2)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    for b in batches:
        for part in by_bytes(b):
            data, off = text_bytes(part.column(1))
            raw = data.tobytes()
            for lang, lo, hi in zip(part.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                yield lang, raw[lo:hi]


def language_references(docs: DataFrame, lang_col: str, text_col: str, n_words: int) -> dict[str, tuple[dict[bytes, int], np.ndarray, np.ndarray]]:
    """Per language: its common words by slot, their shares of all words (the last slot: the others), shares of the classes.

    Two passes over all rows with a language; all counts are exact. What reaches the driver is one small vector per language
    (about 2 kB), so the references grow with the number of languages only.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def portion(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        got = [(lang, w.decode("utf-8", "replace"), n) for lang, c in seen.items() for w, n in c.items() if w.strip(_SYMBOLS)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got, strict=True)], names=["lang", "word", "n"])
        seen.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        held = 0
        for lang, raw in _texts(batches):
            c = seen[lang]
            held -= len(c)
            c.update(common_words(raw))
            held += len(c)
            if held > _MOST_COUNTED:
                yield from portion(seen)
                held = 0
        yield from portion(seen)

    words = in_arrow(rows, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = words.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= n_words)
    slots: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in top.select("lang", "word", "k").collect():  # n_words rows a language
        slots[r.lang][r.word.encode()] = r.k - 1
    slots = dict(slots)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(n_words + 1 + N_CLASSES, np.int64) for lang in slots}
        for lang, raw in _texts(batches):
            if lang in sums:
                sums[lang] += _histogram(raw, slots[lang], n_words)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["lang", "k", "n"])

    sums = {lang: np.zeros(n_words + 1 + N_CLASSES) for lang in slots}
    for r in in_arrow(rows, total, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():
        sums[r.lang][r.k] = r.n
    return {lang: (slots[lang], v[: n_words + 1] / max(1, v[: n_words + 1].sum()), v[n_words + 1 :] / max(1, v[n_words + 1 :].sum())) for lang, v in sums.items()}


def _histogram(raw: bytes, slots: dict[bytes, int], n_words: int) -> np.ndarray:
    """Counts of the common words, of the other words, of the character classes."""
    c = common_words(raw)
    out = np.zeros(n_words + 1 + N_CLASSES, np.int64)
    for w, k in slots.items():
        if n := c.get(w):
            out[k] = n
    out[n_words] = c.total() - out[:n_words].sum()
    out[n_words + 1 :] = class_counts(raw)
    return out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_words: int = 30, word_margin: float = 0.045, class_margin: float = 0.06,
    min_words: int = 20, keep_row: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, word_jsd, class_jsd
    (and ``row``, all columns as they came, with ``keep_row``).

    Base rule: fewer than 20 words or over 30 % of the words in repeated 8-word windows. Verdict: squared distances to the
    reference of the row's language at most the margin plus bins / (8 ln 2 * words), the divergence that sampling gives a text
    of its length. Texts under ``min_words`` words, and all texts when no language is known, are not judged (distances null).
    A null language takes the nearest reference (ties: the first by name). A null or empty text has no words and fails the base
    rule; very long texts are taken whole. Repeated rows get equal results; extra columns are ignored; an empty table gives no
    rows.
    """
    refs = language_references(docs, lang_col, text_col, n_words)

    def judge(raw: bytes, lang: str | None, n: int) -> tuple[float | None, float | None, bool]:
        if n < min_words or not refs:
            return None, None, True
        best = None
        for name in [lang] if lang in refs else sorted(refs):
            slots, words, classes = refs[name]
            h = _histogram(raw, slots, n_words).astype(float)
            w, c = h[: n_words + 1], h[n_words + 1 :]
            d = js_distance_squared(w / max(1.0, w.sum()), words), js_distance_squared(c / max(1.0, c.sum()), classes)
            best = d if best is None or d < best else best
        noise = 1 / (8 * np.log(2) * n)
        return float(np.sqrt(best[0])), float(np.sqrt(best[1])), bool(best[0] <= word_margin + (n_words + 1) * noise and best[1] <= class_margin + N_CLASSES * noise)

    def add(part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        if keep_row:  # the text is in the row already
            row = part.column(0)
            part = pa.RecordBatch.from_arrays([row.field(lang_at).cast(pa.string()), row.field(text_at)], names=["lang", "text"])
        for lang, raw in _texts([part.select(["lang", "text"])]):
            stats = base_stats(raw)
            failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
            w, c, fine = judge(raw, lang, stats[0])
            out.append((*stats, failed, fine and not failed, w, c))
        cols = list(zip(*out, strict=True)) or [()] * 9
        return [pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2, strict=True)]

    lang_at, text_at = docs.columns.index(lang_col), docs.columns.index(text_col)
    plain = [F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")]
    rows = docs.select(*([F.struct("*").alias("row")] if keep_row else []), F.col(id_col).alias("doc_id"), *([] if keep_row else plain))
    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, word_jsd double, class_jsd double"
    return with_arrow(rows, add, columns, drop=("lang", "text"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns."""
    return quality_rules(docs, keep_row=True, **options).where("kept").select("row.*")
