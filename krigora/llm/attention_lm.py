"""Language-model scores of texts: a causal self-attention model in NumPy over subword ids, beside a word model.

The model predicts the next subword's class (a frequent id is a class of its own, the others share classes by frequency) by one
layer of self-attention with learned weights of distances; within a class an id has its smoothed share of the corpus. Words
and, through them, subwords are counted over all training texts; the attention is trained on every id of them, by rounds in which
every task takes steps from the same weights on texts of its own and Spark averages what they have reached. Texts are scored in
overlapping windows, as they are learned: each has the ids before its own as context, scores its own ids alone, and many windows
go through one masked product. Texts are encoded once, into a table of ids that training and scoring read.
"""

from __future__ import annotations

import ctypes
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from contextlib import suppress
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, in_arrow, text_bytes, written

#: Ids before a window's own ones, and own ids of a window: as many, so that a window is two blocks of ids that follow each other.
CONTEXT, OWN = 16, 16
LENGTH = CONTEXT + OWN
#: Width of the model; classes, and how many of them hold one id; ids with a vector of their own.
WIDTH, CLASSES, SINGLE, VECTORS = 8, 64, 48, 2048
BEGIN, PAD, ROWS = VECTORS + CLASSES, VECTORS + CLASSES + 1, VECTORS + CLASSES + 2
#: Windows of a step; windows that are put in random order together; the least steps of a task in a round.
STEP_WINDOWS, MIXED_WINDOWS, LEAST_STEPS = 256, 1 << 13, 40
#: Sixteenths of the training texts that each round takes: every text is in one round, and the first rounds are short.
ROUNDS = (1, 4, 11)
#: At most so many words, of at most so many bytes, are in the table that every task has; the others' counts are joined.
HOT_WORDS, HOT_BYTES = 100_000, 64
#: Words that a task remembers.
MOST_WORDS = 250_000
_SLICES = 16


def _words(column: pa.Array) -> list[list[bytes]]:
    """Words of each row, A-Z lower-cased: bytes split at ASCII white space, which no other character's UTF-8 contains."""
    data, off = text_bytes(column)
    raw = data.tobytes().lower()
    return [raw[s:e].split() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts; the empty word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for part in by_bytes(b, 4 << 20):
                n.update(chain.from_iterable(_words(part.column(0))))
                n[b""] += part.num_rows
                if len(n) > MOST_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()))], names=["word", "n"])
                    n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return in_arrow(texts, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Subwords:
    """Words to the ids of a public byte-level vocabulary; remembers words up to a bound.

    New words are encoded together, as one text with a space before each, and told apart by their bytes: the pattern never
    joins what a space parts. Words with other white space inside are encoded one by one. The id past the vocabulary ends a text.
    """

    def __init__(self, vocabulary: tuple[str, str], hot: dict[bytes, int] | None = None) -> None:
        import base64

        import tiktoken

        path, pattern = vocabulary
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end, self.hot = max(ranks.values()) + 1, hot or {}
        self.size, self.bytes = self.end + 1, np.zeros(self.end + 1, np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = defaultdict(itertools.count(1).__next__, {b"": 0})  # a word that is new gets the next number
        self.names = [b""]
        self.first, self.length, self.ids = np.array([0]), np.array([1]), np.array([self.end])
        self.count = np.array([self.hot.get(b"", -1)])

    def _forget(self) -> None:
        """Only frequent words stay."""
        keep = np.flatnonzero(self.count >= 0)
        names, count, ids, length = [self.names[k] for k in keep[keep > 0].tolist()], self.count, self.expand(keep), self.length[keep]
        self._clear()
        if len(names) < MOST_WORDS // 2:
            self.names += names
            self.slot = defaultdict(itertools.count(len(self.names)).__next__, zip(self.names, range(len(self.names)), strict=True))
            self.count = np.concatenate([self.count, count[keep[keep > 0]]])
            ids, length = (ids, length) if 0 in keep else (np.concatenate([[self.end], ids]), np.concatenate([[1], length]))
            self.ids, self.length, self.first = ids, length, np.cumsum(length) - length

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        text, sizes, alone = b" ".join(words).decode(), np.fromiter(map(len, words), np.int64, len(words)), []
        if " ".join(text.split()) != text:  # other white space
            texts = text.split(" ")
            alone = [k for k, t in enumerate(texts) if len(t.split()) != 1]
            for k in alone:
                texts[k], sizes[k] = "x", 1  # a stand-in, replaced below
            text = " ".join(texts)
        ids = np.array(self.encoding.encode_ordinary(" " + text), np.int64)
        of = np.searchsorted(np.cumsum(sizes + 1), np.cumsum(self.bytes[ids]) - 1, "right")
        length = np.bincount(of, minlength=len(words))
        if alone:
            parts = np.split(ids, np.cumsum(length)[:-1])
            for k in alone:
                parts[k] = np.array(self.encoding.encode_ordinary(" " + words[k].decode()), np.int64)
            ids, length = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, length

    def slots(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words of all texts, each text closed by slot 0, and the texts' offsets."""
        if len(self.slot) > MOST_WORDS:
            self._forget()
        known, sizes = len(self.slot), np.fromiter(map(len, words), np.int64, len(words))
        off = np.concatenate([[0], np.cumsum(sizes + 1)])
        inner = np.ones(off[-1], bool)
        inner[off[1:] - 1] = False
        out = np.zeros(off[-1], np.int64)
        out[inner] = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        new = list(islice(self.slot, known, None))
        for s in range(0, len(new), 50_000):
            some = new[s : s + 50_000]
            ids, length = self._encoded(some)
            self.names += some
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, ids])
            self.count = np.concatenate([self.count, np.fromiter((self.hot.get(w, -1) for w in some), np.int64, len(some))])
        return out, off

    def expand(self, slots: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        n = self.length[slots]
        return self.ids[np.repeat(self.first[slots] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def subword_counts(words: DataFrame, vocabulary: tuple[str, str]) -> np.ndarray:
    """How often each id occurs in the texts that ``words`` (word, n) counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(vocabulary)
        total = np.zeros(sub.size, np.int64)
        for b in batches:
            slots, _ = sub.slots([b.column(0).to_pylist()])
            slots = slots[:-1]
            total += np.bincount(sub.expand(slots), np.repeat(b.column(1).to_numpy(), sub.length[slots]), sub.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = in_arrow(words, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the tokenizer's ids
    out = np.zeros(Subwords(vocabulary).size, np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


class Vocabulary:
    """Class, input row and log share within its class of each id, from the corpus counts."""

    def __init__(self, counts: np.ndarray) -> None:
        order, n = np.lexsort([np.arange(len(counts)), -counts]), len(counts)
        self.classes, self.rows = np.zeros(n, np.int16), np.zeros(n, np.int16)
        mass = np.cumsum(counts[order[SINGLE:]] + 1.0)
        rest = SINGLE + np.minimum((mass / mass[-1] * (CLASSES - SINGLE)).astype(int), CLASSES - SINGLE - 1) if n > SINGLE else np.zeros(0, int)
        self.classes[order] = np.concatenate([np.arange(min(n, SINGLE)), rest])
        self.rows[order] = np.where(np.arange(n) < VECTORS, np.arange(n), VECTORS + self.classes[order])
        weight = counts + 1.0
        self.share = np.log(weight / np.bincount(self.classes, weight, CLASSES)[self.classes])
        size = np.bincount(self.classes, weight, CLASSES)
        self.level = np.log(np.maximum(size, 1e-9) / size.sum())


# --- the model

_SHAPES = {"e": (ROWS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "u": (WIDTH, CLASSES), "o": (WIDTH, CLASSES), "b": (CLASSES,), "d": (LENGTH,)}
_DISTANCE = CONTEXT + np.arange(OWN)[:, None] - np.arange(LENGTH)[None]
_VISIBLE, _AHEAD = _DISTANCE >= 0, np.maximum(_DISTANCE, 0)
_BLOCKED = np.float32(-1e9)
#: Where an input row's slopes are among all of ``e``.
_PLACES = np.arange(ROWS * WIDTH).reshape(ROWS, WIDTH)


def first_weights(level: np.ndarray, seed: int = 13) -> dict[str, np.ndarray]:
    """Small random weights around the classes' own frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(size=s) * (0.3 if k in "eqkv" else 0.1)).astype(np.float32) for k, s in _SHAPES.items()}
    w["b"], w["d"] = level.astype(np.float32), np.zeros(LENGTH, np.float32)
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    return _views(x.astype(np.float32))


def _views(x: np.ndarray) -> dict[str, np.ndarray]:
    """The weights in ``x``, not copied."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s), at + n
    return out


def _cap(z: np.ndarray) -> None:
    """At most 60 from here on, so that no exponential overflows; that is looked up first, as it is rare."""
    if z.size and z.max() > 60:
        np.minimum(z, 60, out=z)


def _keep_memory() -> None:
    """Arrays of a step are taken from memory that the process keeps, instead of asking the system for it each time."""
    with suppress(OSError, AttributeError):
        c = ctypes.CDLL(None)
        c.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


class _Tables:
    """What the weights make of each input row, so that a window takes rows of tables instead of products of its own.

    Columns of ones and of what blocks padding spare passes over the windows: of the queries and keys, they block; of the values, their
    product is the sum of the weights; of ``x`` (the row, one, room for what attention brings), they add ``b``.
    """

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        kind = w["e"].dtype.type
        self.x = np.ones((ROWS, 2 * WIDTH + 1), kind)
        self.x[:, :WIDTH] = w["e"]
        q, kv = np.zeros((WIDTH + 1, WIDTH + 1), kind), np.zeros((WIDTH + 1, 2 * WIDTH + 2), kind)
        q[:WIDTH, :WIDTH], kv[:WIDTH, :WIDTH], kv[:WIDTH, WIDTH + 1 : -1] = w["q"] * kind(WIDTH**-0.5), w["k"], w["v"]
        q[-1, -1] = kv[-1, -1] = 1
        self.q, self.kv = self.x[:, : WIDTH + 1] @ q, self.x[:, : WIDTH + 1] @ kv
        self.kv[PAD, WIDTH] = _BLOCKED
        self.ubo = np.concatenate([w["u"], w["b"][None], w["o"]])
        self.distance = np.where(_VISIBLE, w["d"][_AHEAD], kind(_BLOCKED))
        self.ones = np.ones(CLASSES, kind)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows ``rows``: queries, keys, values and weights of attention, their sums, what classes are read from, the classes' levels."""
        own = rows[:, CONTEXT:]
        q, kv = np.take(self.q, own, 0, mode="clip"), np.take(self.kv, rows, 0, mode="clip")
        k, v = kv[..., : WIDTH + 1], kv[..., WIDTH + 1 :]
        a = q @ k.transpose(0, 2, 1)
        a += self.distance
        _cap(a)
        np.exp(a, out=a)
        o = (a @ v).reshape(-1, WIDTH + 1)
        total, xo = np.maximum(o[:, WIDTH:], a.dtype.type(1e-30)), np.take(self.x, own.ravel(), 0, mode="clip")
        np.divide(o[:, :WIDTH], total, out=xo[:, WIDTH + 1 :])
        z = xo @ self.ubo
        _cap(z)
        return q, k, v, a, total, xo, z


def loss_and_slopes(w: dict[str, np.ndarray], rows: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the classes ``targets`` (windows, OWN; -1: none) after the inputs ``rows`` (windows, LENGTH), and its slopes."""
    kind, windows, rows, tables = w["e"].dtype.type, len(rows), rows.astype(np.int64), _Tables(w)
    q, k, v, a, total, xo, z = tables.forward(rows)
    target = targets.ravel().astype(np.int64)
    valid, at = target >= 0, np.arange(0, z.size, CLASSES) + np.maximum(target, 0)
    share, levels = valid / kind(max(1, int(valid.sum()))), z.ravel()
    hit = levels[at]
    np.exp(z, out=z)
    sums = np.maximum(z @ tables.ones, kind(1e-30))
    loss = float(((np.log(sums) - hit) * share).sum())
    # The slopes by the levels are z times ``scale``, which is left to what they are multiplied with: that has fewer columns.
    levels[at] -= sums
    scale = (share / sums).astype(kind)[:, None]
    gubo, dxo = (xo * scale).T @ z, z @ tables.ubo.T
    dxo *= scale
    g = {"u": gubo[:WIDTH], "b": gubo[WIDTH], "o": gubo[WIDTH + 1 :]}
    do = np.empty((len(z), WIDTH + 1), kind)
    np.divide(dxo[:, WIDTH + 1 :], total, out=do[:, :WIDTH])
    np.negative(np.einsum("ij,ij->i", do[:, :WIDTH], xo[:, WIDTH + 1 :]), out=do[:, WIDTH])
    do = do.reshape(windows, OWN, -1)
    dkv = np.empty((windows, LENGTH, 2 * WIDTH), kind)
    np.matmul(a.transpose(0, 2, 1), do[..., :WIDTH], out=dkv[..., WIDTH:])
    ds = do @ v.transpose(0, 2, 1)
    ds *= a
    np.matmul(ds.transpose(0, 2, 1), q[..., :WIDTH], out=dkv[..., :WIDTH])
    dq = (ds @ k[..., :WIDTH]).reshape(-1, WIDTH) * kind(WIDTH**-0.5)
    by_distance = (np.ones(windows, kind) @ ds.reshape(windows, -1)).reshape(OWN, LENGTH) * _VISIBLE
    g["d"] = np.bincount(_AHEAD.ravel(), by_distance.ravel(), LENGTH).astype(kind)
    ids, dkv = rows.ravel(), dkv.reshape(-1, 2 * WIDTH)
    gkv = np.take(w["e"], ids, 0, mode="clip").T @ dkv
    g["q"], g["k"], g["v"] = xo[:, :WIDTH].T @ dq, gkv[:, :WIDTH], gkv[:, WIDTH:]
    dx = (dkv @ np.concatenate([w["k"], w["v"]], 1).T).reshape(windows, LENGTH, WIDTH)
    dx[:, CONTEXT:] += (dxo[:, :WIDTH] + dq @ w["q"].T).reshape(windows, OWN, WIDTH)
    g["e"] = np.bincount(np.take(_PLACES, ids, 0, mode="clip").ravel(), dx.ravel(), ROWS * WIDTH).reshape(ROWS, WIDTH).astype(kind)
    return loss, g


def train_steps(w: dict[str, np.ndarray], parts: Iterator[tuple[np.ndarray, np.ndarray]], seed: Sequence[int], rate: float) -> tuple[dict[str, np.ndarray], int]:
    """Adam over all windows (rows, targets) of ``parts``, each once, in random order among ``MIXED_WINDOWS`` or more, and how many
    they were; fewer windows than ``LEAST_STEPS`` steps take are gone over again."""
    rng, x, windows, t = np.random.default_rng(seed), flat(w), 0, 0
    m, s, now = np.zeros_like(x), np.zeros_like(x), _views(x)

    def step(rows: np.ndarray, targets: np.ndarray) -> None:
        nonlocal t
        g = flat(loss_and_slopes(now, rows, targets)[1])
        new = np.float32([0.1, 0.01] if t else [1, 1])  # the first step's slopes count in full
        m[:] += new[0] * (g - m)
        s[:] += new[1] * (g * g - s)
        x[:] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-7))
        t += 1

    rows, targets, ended = np.zeros((0, LENGTH), np.int16), np.zeros((0, OWN), np.int16), False
    while not ended:
        got, n = [(rows, targets)], len(rows)
        while n < MIXED_WINDOWS and not ended:
            part = next(parts, None)
            ended = part is None
            if part is not None:
                got.append(part)
                n, windows = n + len(part[0]), windows + len(part[0])
        rows, targets = (np.concatenate(c) for c in zip(*got, strict=True))
        order = rng.permutation(n)
        rows, targets, whole = rows[order], targets[order], n if ended else n - n % STEP_WINDOWS
        for at in range(0, whole, STEP_WINDOWS):
            step(rows[at : at + STEP_WINDOWS], targets[at : at + STEP_WINDOWS])
        if not ended:
            rows, targets = rows[whole:], targets[whole:]
    while 0 < t < LEAST_STEPS and n:
        order = rng.permutation(n)
        for at in range(0, n, STEP_WINDOWS):
            if t < LEAST_STEPS:
                step(rows[order[at : at + STEP_WINDOWS]], targets[order[at : at + STEP_WINDOWS]])
    return unflat(x), windows


def _padded(ids: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ids: inputs (windows, LENGTH), places of the own ids in ``ids`` (windows, OWN; -1: none) and the
    text of each window."""
    n = np.diff(off)
    windows = -(-n // OWN)
    text = np.repeat(np.arange(len(n)), windows)
    number = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    # Blocks of OWN places, those of a text after one of padding: a window is a block and the next.
    blocks = windows + (n > 0)
    start = (np.cumsum(blocks) - blocks + 1) * OWN
    at = np.arange(len(ids)) + np.repeat(start - off[:-1], n)
    inputs, places = np.full((int(blocks.sum()), OWN), PAD, np.int16), np.full((int(blocks.sum()), OWN), -1)
    if len(ids):
        inputs.ravel()[at] = vocabulary.rows[np.concatenate([ids[:1], ids[:-1]])]
        inputs.ravel()[start[n > 0]] = BEGIN
        places.ravel()[at] = np.arange(len(ids))
    block = number + (start // OWN - 1)[text]
    return np.concatenate([inputs[block], inputs[block + 1]], 1), places[block + 1], text, number


class Scorer:
    """The forward pass with trained weights, many windows at once."""

    def __init__(self, w: dict[str, np.ndarray], vocabulary: Vocabulary) -> None:
        self.vocabulary, self.tables = vocabulary, _Tables(w)

    def log10(self, ids: np.ndarray, off: np.ndarray, at_once: int = 256) -> np.ndarray:
        """log10 probability of each text of ids."""
        vocabulary, out = self.vocabulary, np.zeros(len(off) - 1)
        out += np.add.reduceat(np.append(vocabulary.share[ids], 0.0), off[:-1]) * (np.diff(off) > 0) if len(out) else 0.0
        for first, end in _runs(off):
            some = ids[off[first] : off[end]]
            rows, own, text, _ = _padded(some, off[first : end + 1] - off[first], vocabulary)
            classes, got = np.append(vocabulary.classes[some], 0).astype(np.int64), np.zeros(len(rows))
            for s in range(0, len(rows), at_once):
                places = own[s : s + at_once]
                z = self.tables.forward(rows[s : s + at_once].astype(np.int64))[-1]
                hit = z.ravel()[np.arange(0, z.size, CLASSES) + classes[places.ravel()]]
                np.exp(z, out=z)
                hit -= np.log(z @ self.tables.ones)
                got[s : s + at_once] = (hit.reshape(places.shape) * (places >= 0)).sum(1, dtype=float)
            out[first:end] += np.bincount(text, got, end - first)
        return out / np.log(10)


def _runs(off: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Texts of about ``most`` ids together."""
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end
        at = end


def text_ids(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's texts, one after the other, and the texts' offsets, from a binary column of them."""
    raw, off = text_bytes(batch.column(column))
    kind = _id_type(size)
    return np.frombuffer(raw.tobytes(), kind).astype(np.int64), off // np.dtype(kind).itemsize


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def training_windows(ids: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, targets) of all windows of texts of ids: every id is the target of one, after what the scorer sees before it."""
    for first, end in _runs(off):
        some = ids[off[first] : off[end]]
        rows, own, _, _ = _padded(some, off[first : end + 1] - off[first], vocabulary)
        yield rows, np.append(vocabulary.classes[some], np.int16(-1))[own]  # a place of -1 is the last


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: Sequence[int] = ROUNDS, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Rounds of steps in every task from common weights, which are averaged by their windows, over all of ``texts`` (row, ids).

    Each round takes its share of the texts by a hash of ``row``; the rounds' shares are all texts, each once.
    """
    spark, w = texts.sparkSession, first_weights(vocabulary.level)
    ends = np.cumsum(rounds).tolist()
    size, bucket = len(vocabulary.classes), F.pmod(F.xxhash64("row"), F.lit(ends[-1]))
    for turn, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
        sent = spark.sparkContext.broadcast((w, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            _keep_memory()
            (w, vocabulary), task = sent.value, TaskContext.get().partitionId()
            parts = chain.from_iterable(training_windows(*text_ids(part, 0, size), vocabulary) for b in batches for part in by_bytes(b, 4 << 20))
            w, windows = train_steps(w, parts, [13, turn, task], rate / (1 + turn))
            if not windows:
                return
            x = flat(w).astype(float) * windows
            parts = np.array_split(np.append(x, windows), _SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES)), pa.array(np.full(_SLICES, task % 16)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "salt", "x"])

        def total(rows: pa.Table) -> pa.Table:
            x = sum(np.frombuffer(raw.as_buffer(), float) for raw in rows["x"])
            return pa.table({"part": rows["part"][:1], "salt": pa.array([0]), "x": pa.array([x.tobytes()], pa.binary())})

        schema = "part long, salt long, x binary"
        got = in_arrow(texts.where((bucket >= start) & (bucket < end)).select("ids"), run, schema).groupBy("part", "salt").applyInArrow(total, schema).groupBy("part").applyInArrow(total, schema).collect()
        if got:
            x = np.concatenate([np.frombuffer(r["x"], float) for r in sorted(got, key=lambda r: r["part"])])
            w = unflat(x[:-1] / x[-1])
    return w


def score_texts(docs: DataFrame, tokenizer: tuple[str, str], held_out: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` are scored only; all others are learned from too (a null id
    is in fold 0). Tokens are the words (A-Z lower-cased, split at ASCII white space) and one end a text. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over the tokens, with their counts c in all N training tokens, V of them distinct; ``n_known``
    tokens have c > 0. ``score`` is the attention model's log10 probability of the text's subword ids and its end.

    A null text is empty: an end alone. Very long texts are counted and scored whole; repeated rows are texts each and get
    equal results. Without training rows the counts are zero and the model is even. An empty table gives no rows; extra columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learned = picked.where(fold("doc_id", folds) != held_out)
    words = written(word_counts(learned.select("text")), "word-counts")
    total, distinct = (int(v or 0) for v in words.agg(F.sum("n"), F.count("*")).first())
    # Words by quarters of the binary logarithm of their count, a few hundred rows: the most frequent HOT_WORDS or fewer are hot.
    level, hot_words, bound = F.floor(4 * F.log2("n")), 0, None
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        hot_words += r["count"]
        if hot_words > HOT_WORDS:
            break
        bound = r["level"]
    is_hot = (F.length("word") == 0) | (F.lit(bound is not None) & (level >= F.lit(bound or 0)) & (F.length("word") <= HOT_BYTES))
    hot = {bytes(r["word"]): r["n"] for r in words.where(is_hot).collect()}
    vocabulary = Vocabulary(subword_counts(words, tokenizer))
    sent = spark.sparkContext.broadcast(hot)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, at = Subwords(tokenizer, sent.value), TaskContext.get().partitionId() << 33
        kind = np.dtype(_id_type(sub.size))
        for b in batches:
            for part in by_bytes(b, 4 << 20):
                slots, off = sub.slots(_words(part.column(1)))
                c, starts = sub.count[slots], off[:-1]
                logs = np.add.reduceat(np.log10(np.maximum(c, 0) + 1.0), starts) if len(starts) else np.zeros(0)
                known = np.add.reduceat((c > 0).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
                # Words that are not in the table: (row, slot) and how often, for the join.
                far = np.flatnonzero((c < 0) & (slots > 0))
                pairs, times = np.unique(np.searchsorted(off, far, "right") * (1 << 32) + slots[far], return_counts=True)
                of, names = (pairs >> 32) - 1, [sub.names[k] for k in (pairs & 0xFFFFFFFF).tolist()]
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"]))
                ends = np.concatenate([[0], np.cumsum(sub.length[slots])[off[1:] - 1]]) * kind.itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(sub.expand(slots).astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(part.num_rows)), part.column(0), pa.array(np.diff(off)), pa.array(known), pa.array(logs), rare, ids], names=["row", "doc_id", "n_tokens", "known", "logs", "rare", "ids"])
                at += part.num_rows

    numbered = written(in_arrow(picked, encode, "row long, doc_id long, n_tokens long, known long, logs double, rare array<struct<word:binary,times:long>>, ids binary"), "lm-ids")
    model = spark.sparkContext.broadcast((vocabulary, train(numbered.where(fold("doc_id", folds) != held_out), vocabulary)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        vocabulary, weights = model.value
        scorer = Scorer(weights, vocabulary)
        for b in batches:
            for part in by_bytes(b, 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer.log10(*text_ids(part, part.num_columns - 1, len(vocabulary.classes))))], names=["row", "doc_id", "n_tokens", "known", "logs", "score"])

    scored = written(in_arrow(numbered.select("row", "doc_id", "n_tokens", "known", "logs", "ids"), score, "row long, doc_id long, n_tokens long, known long, logs double, score double"), "lm-scores")
    each = numbered.select(F.col("row").alias("of"), F.explode("rare").alias("w")).select("of", "w.word", "w.times")
    counts = words.where(~is_hot).withColumnRenamed("word", "counted")
    more = each.join(counts, F.col("word") == F.col("counted")).groupBy("of").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    both = scored.join(more, F.col("row") == F.col("of"), "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return both.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
