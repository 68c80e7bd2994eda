"""Packing tokenised documents into sequences: swap-based local search between underfull bins.

Pieces are dealt by hash to groups of bounded size. In a group, bins are filled one after the other as the pieces come; then
underfull bins exchange pieces (move, one for one, two for one), each exchange raising the sum of squared fills, until as many
bins are empty as can be or no exchange is left; in the latter case best-fit decreasing is tried as a start too. Bins that stay underfull give their pieces back, and fewer groups pack those
again, as long as that leaves fewer of them.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, in_arrow, text_bytes, written

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Latin letters: one token run for the vocabulary's splitter, so a boundary lies before ASCII punctuation (but for the
#: apostrophe, which may join), and nothing to normalise but their case.
_BEFORE_MARK = re.compile(rb"(?:(?<=[A-Za-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))(?=[!-&(-/:-@\[-`{-~])")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes the UTF-8 bytes of the lower-case Latin letters: bytes without a printable
    character of their own get the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in [*range(97, 123), *range(0xDF, 0x100)]}


_BYTE_LETTERS = _byte_letters()
_WORDS: dict[str, _WordIds] = {}


class _WordIds:
    """Token ids by word: white space always ends a token in this kind of vocabulary, so words tokenise alone.

    So does the place between an ASCII letter and the punctuation after it, and capitals are lowered by the tokenizer anyway;
    texts that may hold a special token (with "<|") are left as they are. The table keeps its most used words when it is full.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.code: dict[bytes, int] = {}
        self.flat, self.at, self.n, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain, model = [_LATIN.fullmatch(t) is not None for t in texts], self.tokenizer.model
        other = iter([e.ids for e in self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False)])
        # A word of letters is one run for the vocabulary's model; the steps before it would only cost time.
        got = [[x.id for x in model.tokenize(t.lower().translate(_BYTE_LETTERS))] if p else next(other) for t, p in zip(texts, plain, strict=True)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self.code.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
        self.n = np.concatenate([self.n, lens])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum()))])

    def shrink(self, to: int) -> None:
        """Keeps the ``to`` most used words."""
        if len(self.code) <= to:
            return
        keep = np.sort(np.argpartition(-self.used, to)[:to])
        names = list(self.code)
        self.code = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat = self.flat[_runs(self.at[keep], self.n[keep])]
        self.n, self.used = self.n[keep], self.used[keep] // 2
        self.at = np.cumsum(self.n) - self.n

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        split = [(t if b"<|" in t else _BEFORE_MARK.sub(b" ", t).lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.code) > self.most:
            self.shrink(self.most // 2)
        if new := set(words).difference(self.code):
            self._add(list(new))
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        self.used += np.bincount(codes, minlength=len(self.used))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        lens = self.n[codes]
        return self.flat[_runs(self.at[codes], lens)], np.concatenate([[0], np.cumsum(lens)])[ends]


def _runs(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids`` with ``keep_ids``): each row's token ids plus ``end_id``, cut at ``length``.

    ``tokenizer`` is the path of a word-level BPE file on every worker. A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, _WordIds(tokenizer))
        for b in batches:
            for part in by_bytes(b, 4 << 20):
                data, off = text_bytes(part.column(1))
                raw, out, kept = data.tobytes(), [], []
                flat, ends = words.ids([raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                for doc, lo, hi in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), length)):
                        cut = ids[at : at + length]
                        out.append((doc, k, at, len(cut), zlib.crc32(cut.tobytes())))
                        if keep_ids:
                            kept.append(cut.tolist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + ([pa.array(kept, pa.list_(pa.int64()))] if keep_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
        words.shrink(100_000)  # what the worker's next task starts with

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _PIECE + ", ids array<long>" * keep_ids)


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(room + 1)]  # bins by the room they have left
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            left = rooms[k]
            b = open_at[left].pop()
            if not open_at[left]:
                rooms.pop(k)
        else:
            b, left = len(bins), room
            bins.append([])
        bins[b].append(i)
        left -= n
        if left:
            if not open_at[left]:
                insort(rooms, left)
            open_at[left].append(b)
    return bins


def next_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins filled one after the other in the order of the pieces."""
    bins: list[list[int]] = []
    left = -1
    for i, n in enumerate(lengths.tolist()):
        if n > left:
            bins.append([])
            left = room
        bins[-1].append(i)
        left -= n
    return bins


def swap_search(bins: list[list[int]], lengths: np.ndarray, room: int, donors: int = 64, log: list[int] | None = None) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills grows; bins that end empty are left out.

    The emptiest bins give (at first ``donors`` or as many as the room left could empty): each fuller bin, the fullest first,
    takes a piece of theirs that fits (move), or gives one or two of its own for a longer one that still fits. All exchanges
    move fill from an emptier to a fuller bin, so squared fill rises each time. When a sweep changes nothing four times as many
    bins give, until all do. Ends when no fewer bins could hold the pieces, or after a sweep of all bins without an exchange.
    ``log`` gets the number of pieces given back in each exchange (0: a move).
    """
    n = [int(x) for x in lengths]
    need = -(-sum(n[i] for b in bins for i in b) // room)
    while True:
        bins = [b for b in bins if b]
        fill = [sum(n[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if fill[b] < room), key=lambda b: fill[b])
        if len(under) < 2 or len(bins) <= need:
            break
        width = max(donors, sum(room - fill[b] for b in under) // room + 8)
        givers = set(under[:width])
        home = {i: b for b in givers for i in bins[b]}
        pool = sorted((n[i], i) for i in home)
        changed = False

        def exchange(taker: int, give: list[int], item: tuple[int, int]) -> None:
            del pool[bisect_left(pool, item)]
            giver = home.pop(item[1])
            bins[giver].remove(item[1])
            bins[taker].append(item[1])
            for g in give:
                bins[taker].remove(g)
                bins[giver].append(g)
                home[g] = giver
                insort(pool, (n[g], g))
            d = item[0] - sum(n[g] for g in give)
            fill[taker] += d
            fill[giver] -= d
            if log is not None:
                log.append(len(give))

        for t in reversed(under):
            if t in givers:  # from now on it takes
                for i in bins[t]:
                    del pool[bisect_left(pool, (n[i], i))]
            while fill[t] < room and pool:
                slack, best = room - fill[t], None
                for given, give in _gives(bins[t], n):
                    k = bisect_right(pool, (given + slack, 1 << 62)) - 1
                    # Givers that have become fuller than the taker are no gain.
                    while k >= 0 and pool[k][0] > given and fill[home[pool[k][1]]] > fill[t]:
                        k -= 1
                    if k >= 0 and pool[k][0] > given and (best is None or pool[k][0] - given > best[0]):
                        best = (pool[k][0] - given, give, pool[k])
                        if best[0] == slack:
                            break
                if best is None:
                    break
                exchange(t, best[1], best[2])
                changed = True
        if not changed:
            if width >= len(under):
                break
            donors = 4 * width
    return bins


def _gives(own: list[int], n: list[int]) -> Iterator[tuple[int, list[int]]]:
    """What a bin can give: nothing, one piece of each length, two pieces of each two lengths; with their tokens."""
    yield 0, []
    once: dict[int, int] = {}
    twice: dict[int, int] = {}
    for i in own:
        (twice if n[i] in once else once)[n[i]] = i
    each = list(once.items())
    for a, i in each:
        yield a, [i]
    for x, (a, i) in enumerate(each):
        if a in twice:
            yield 2 * a, [i, twice[a]]
        for b, j in each[x + 1 :]:
            yield a + b, [i, j]


def _pack_group(length: int, slack: int, last: bool, id_base: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        lens = pdf["length"].to_numpy()
        bins = swap_search(next_fit(lens, length), lens, length)
        if len(bins) > -(-lens.sum() // length):  # a better start may leave the exchanges fewer bins
            bins = min(bins, swap_search(best_fit(lens, length), lens, length), key=len)
        seq, offset, done = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, b in enumerate(bins):
            at = np.cumsum(lens[b])
            seq[b], offset[b], done[b] = k, at - lens[b], last or at[-1] >= length - slack
        return pdf.assign(sequence_id=id_base + (pdf["part"].to_numpy() << 32) + seq, offset=offset, done=done)

    return pack


def pack(pieces: DataFrame, length: int = 4096, group_rows: int = 20_000, slack: int = 4) -> DataFrame:
    """Rows of ``pieces`` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    Every sequence holds at most ``length`` tokens at gapless offsets. Pieces of full length are sequences as they are. A group
    packs about ``group_rows`` pieces; sequences that lack more than ``slack`` tokens are packed anew with those of other
    groups, until one group holds them all or a round frees less than a tenth of them; that round's are kept as they are. An
    empty table gives no rows; equal rows (null ids too) are packed one by one and dealt to groups by a number of their own.
    """
    rows = written(pieces.withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.lit(0).cast("long")), "pack-pieces")
    schema = rows.drop("part", "uid").schema
    packed_schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("done", T.BooleanType())])
    out = rows.where(F.col("length") >= length).select(*schema.names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, before = rows.where(F.col("length") < length), None
    for k in count():
        n = rest.count()
        groups, last = max(1, -(-n // group_rows)), n <= group_rows or (before is not None and n > 0.9 * before)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "uid"), F.lit(groups)))
        packed = dealt.groupBy("part").applyInPandas(_pack_group(length, slack, last, k << 56), packed_schema)
        packed = written(packed, "pack-round")
        out = out.unionByName(packed.where("done").select(*schema.names, "sequence_id", "offset"))
        if last:
            return out
        rest, before = packed.where("NOT done").select(*rows.columns), n


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as sequences of at most ``length`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``length`` are cut, whatever their length. A null or empty text is the end id alone; null ids
    are kept; ties go by the order in which rows were numbered; repeated rows are packed each; extra columns are ignored; an
    empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, length, end_id, id_col, text_col), length, **options)
