"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

The base patterns are certain and always stay. Looser patterns propose further spans; regex, gazetteer and context labelers
vote on every span. Spark counts the vote patterns of the whole corpus (a small table, as votes are few), EM on those counts
estimates how often each labeler is right without any labels. A logistic model over votes, shape, length and hashed neighbours
is trained on the resulting probabilities, on a bounded sample of the spans, and decides on the proposed ones. A number that
fails the checks of its kind (a card's checksum, an address's parts) is never proposed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, in_arrow, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "structure", "gazetteer", "context", "counter_context", "boundary")

#: The patterns of the base rule; the bounds that follow [0-9] only spare useless retries.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY = re.compile(r"[0-9@]")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")

#: Spans that only the method may add.
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\]|\{at\})[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}|\.)[ ]?[A-Za-z0-9-]{1,63})+", re.I)
_DIGITS = re.compile(r"[0-9]+")
_LOOSE_PHONE = re.compile(r"(?<![\w+.(-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")

#: Gazetteers and context words, and how the digits of a card are grouped.
_CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
_TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk it eu us ch at be nl pl pt se".split())
_DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
_CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "appel", "llame"),
}
_COUNTER = ("version", "isbn", "token", "order", "invoice", "serial", "section", "release", "license")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base rule, and matches of its patterns that fail its checks."""
    good, failed = [(s, 0, e) for s, e in emails(text)], []
    for m in _IP.finditer(text):
        (good if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")) else failed).append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) >= 14:
                (good if len(digits) <= 19 and luhn(digits) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            (good if 10 <= n <= 15 else failed).append((m.start(), 3, m.end()))
    return sorted(good), failed


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """A vote (1 personal, -1 not, 0 none) of each labeler."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        structure, gazetteer = 1, 1 if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in _TOP_DOMAINS else 0
    elif kind == 1:
        parts = span.split(".")
        structure = 1 if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if len(parts[0]) == 1 or parts[0] == "0" * len(parts[0]) else 1
    elif kind == 2:
        structure, gazetteer = 1 if luhn(digits) else -1, 1 if digits[:1] in ("2", "3", "4", "5", "6") else 0
    else:
        structure, gazetteer = 1 if 10 <= len(digits) <= 15 else -1, 1 if span[0] == "+" and digits.startswith(_DIAL_CODES) else 0
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-4:]
    context = 1 if any(w.startswith(c) for w in before for c in _CONTEXT[KINDS[kind]]) else 0
    counter = -1 if any(w.startswith(c) for w in before for c in _COUNTER) else 0
    beside = (text[start - 1 : start] or " ") + (text[end : end + 1] or " ")
    boundary = -1 if any(c.isalnum() or c in "_=\"" for c in beside) else 1
    return (1 if base else 0, structure, gazetteer, context, counter, boundary)


def inner_spans(text: str, start: int, kind: int, end: int) -> Iterator[tuple[int, int, int]]:
    """What a match that failed may hold, where numbers stand side by side: the longest phone number that begins it and ends
    before a space, and the cards among its groups of digits (one group, or grouped as cards are)."""
    runs = [(m.start(), m.end()) for m in _DIGITS.finditer(text, start, end)]
    if kind == 3:
        n, best = 0, None
        for s, e in runs:
            n += e - s
            if n > 15:
                break
            if n >= 10 and text[e : e + 1] == " ":
                best = e
        if best and best < end:
            yield start, 3, best
    elif kind == 2:
        k = 0
        while k < len(runs):
            wide = next((g for g in _CARD_GROUPS if tuple(e - s for s, e in runs[k : k + len(g)]) == g), (0,))
            n = sum(wide) or runs[k][1] - runs[k][0]
            s, e = runs[k][0], runs[k + len(wide) - 1][1]
            if 14 <= n <= 19 and (s, e) != (start, end) and luhn(text[s:e].replace(" ", "").replace("-", "")):
                yield s, 2, e
                k += len(wide)
            else:
                k += 1


def proposed_spans(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans beside the base ones, which they don't overlap; among themselves the leftmost stays."""
    more = []
    for f in failed:
        inner = list(inner_spans(text, *f))
        more += inner or [f] * (f[1] == 3)
    if "at" in text or "AT" in text or "At" in text:
        more += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)] if any(b in text for b in "([{") else []
    more += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text)]
    out, taken = [], sorted((s, e) for s, _, e in base)
    ends, k, last = 0, 0, 0
    for s, kind, e in sorted(more):
        while k < len(taken) and taken[k][0] < e:
            ends = max(ends, taken[k][1])
            k += 1
        if s >= max(ends, last):
            out.append((s, kind, e))
            last = e
    return out


#: Hashed features of a span (and how many of them): the two words before, the word after, its shape, its length, its kind.
_SLOTS, _WIDTH = 256, 6


def span_features(text: str, start: int, kind: int, end: int) -> list[int]:
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-2:]
    after = re.findall(r"[^\W\d_]+", text[end : end + 24].lower())[:1]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", text[start:end])))
    marks = [f"b{w}" for w in before] + ["-"] * (2 - len(before)) + [f"a{w}" for w in after] + ["-"] * (1 - len(after))
    return [zlib.crc32(f"{kind}:{m}".encode()) % _SLOTS for m in (*marks, f"s{shape}", f"l{min(end - start, 40) // 2}", "k")]


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> np.ndarray:
    """Probability that a span with each vote pattern is personal: EM for two hidden classes, per-class vote frequencies.

    ``patterns``: (kind, votes, count). Starts from the vote balance; each labeler's frequencies are smoothed towards a
    labeler that is right three times out of four.
    """
    if not patterns:
        return np.zeros(0)
    v, n = np.array([p[1] for p in patterns]), np.array([p[2] for p in patterns], float)
    q = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    guess = np.array([[0.1, 0.3, 0.6], [0.6, 0.3, 0.1]])  # frequencies of -1, 0, 1 given personal / not
    for _ in range(rounds):
        share = (q @ n + 1) / (n.sum() + 2)
        log = np.zeros((2, len(n)))
        for c, w in enumerate((q * n, (1 - q) * n)):
            log[c] = np.log(share if c == 0 else 1 - share)
            for j in range(v.shape[1]):
                f = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + 0.02 * (n.sum() + 50) * guess[c]
                log[c] += np.log(f / f.sum())[v[:, j] + 1]
        q = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return q


def train_span_classifier(patterns: list[tuple[int, tuple[int, ...], int]], codes: np.ndarray, features: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model for the EM probabilities of ``patterns``, from spans (vote codes and hashed features).

    The columns are one per labeler and vote, kind, and feature slot; hashed features are damped more than votes.
    """
    q = {_code(k, v): p for (k, v, _), p in zip(patterns, estimate(patterns), strict=True)}
    x = np.stack([span_inputs(c, f) for c, f in zip(codes.tolist(), features.tolist(), strict=True)])
    y = np.array([q[c] for c in codes.tolist()])
    _, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    weight = 1 / np.sqrt(n)[at]  # a frequent pattern shouldn't drown the others
    weight /= weight.sum()
    damp = np.r_[np.full(x.shape[1] - _SLOTS, 1e-4), np.full(_SLOTS, 3e-3)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + damp * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(damp + 1e-6)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def span_inputs(code: int, features: list[int]) -> np.ndarray:
    slots = np.zeros(_SLOTS)
    slots[features] = 1
    return np.concatenate([_inputs(*_decode(code)), slots])


def _inputs(kind: int, vote: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(2 * len(LABELERS) + len(KINDS))
    for j, v in enumerate(vote):
        if v:
            x[2 * j + (v > 0)] = 1
    x[2 * len(LABELERS) + kind] = 1
    return x


def _code(kind: int, vote: tuple[int, ...]) -> int:
    c = kind
    for v in vote:
        c = 3 * c + v + 1
    return c


def _decode(c: int) -> tuple[int, tuple[int, ...]]:
    vote = []
    for _ in LABELERS:
        vote.append(c % 3 - 1)
        c //= 3
    return c, tuple(reversed(vote))


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def labeled_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, starts, kinds, ends, codes (votes), is_base and features (``_WIDTH`` a span) of the spans of every row."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = picked.select("doc_id").schema
    for name in ("starts", "kinds", "ends", "codes", "is_base", "features"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b):
                rows: list[list[list[int]]] = [[], [], [], [], [], []]
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base, failed = base_spans(text) if _ANY.search(text) else ([], [])
                    more = proposed_spans(text, base, failed)
                    spans = [(*s, 1) for s in base] + [(*s, 0) for s in more]
                    codes = [_code(k, votes(text, s, k, e, bool(f))) for s, k, e, f in spans]
                    for out, got in zip(rows, ([x[0] for x in spans], [x[1] for x in spans], [x[2] for x in spans], codes, [x[3] for x in spans], [h for s, k, e, _ in spans for h in span_features(text, s, k, e)]), strict=True):
                        out.append(got)
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(r, pa.list_(pa.int32())) for r in rows], names=["doc_id", "starts", "kinds", "ends", "codes", "is_base", "features"])

    return in_arrow(picked, run, schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, most_spans: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added of every row.

    Spans are kind:start:end in code points, end exclusive, ordered by start and kind. A null or empty text has none (the digest
    of an empty list); very long texts are taken whole. About ``most_spans`` spans, chosen by a hash of their place, train the
    classifier; the labelers' reliabilities come from all. Where proposals overlap the leftmost stays. Repeated rows get equal
    results; extra columns are ignored; an empty table gives no rows.
    """
    found = written(labeled_spans(docs, id_col, text_col), "pii-spans")
    # At most kinds * 3 ** labelers patterns.
    counted = found.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()
    patterns = [(*_decode(r["code"]), r["count"]) for r in counted]
    weights, share = None, min(1.0, most_spans / max(1, sum(n for _, _, n in patterns)))
    if patterns:
        each = found.select("starts", "ends", "features", F.posexplode("codes").alias("k", "code"))
        unit = F.pmod(F.xxhash64("starts", "ends", "k"), F.lit(1 << 30)) / F.lit(1 << 30)
        sample = each.where(unit < share).select("code", F.slice("features", F.col("k") * _WIDTH + 1, F.lit(_WIDTH)).alias("features")).toPandas()
        if len(sample):
            sample = sample.assign(order=sample["features"].map(tuple)).sort_values(["code", "order"])
            weights = train_span_classifier(patterns, sample["code"].to_numpy(), np.stack(sample["features"].to_list()))
    cut = float(np.log(threshold / (1 - threshold)))
    schema = found.select("doc_id").schema
    for name in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, texts, added = [], [], [], []
            for starts, kinds, ends, codes, flags, features in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
                spans = list(zip(starts, kinds, ends, strict=True))
                base = [s for s, f in zip(spans, flags, strict=True) if f]
                fits = lambda k: weights is not None and span_inputs(codes[k], features[_WIDTH * k : _WIDTH * (k + 1)]) @ weights >= cut  # noqa: B023, E731
                more = [s for k, s in enumerate(spans) if not flags[k] and fits(k)]
                counts.append([sum(k == j for _, k, _ in base) for j in range(4)])
                digests.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                texts.append(_digest(base + more))
                added.append(len(more))
            columns = [pa.array([c[j] for c in counts], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64())], names=schema.names)

    return in_arrow(found, run, schema)
