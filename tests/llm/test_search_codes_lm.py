"""Hard negatives, vector codes and language-model scores against brute force, on odd rows and on held-out texts."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("krigora.llm")
from krigora.llm import attention_lm, hard_negatives, queries, vector_codes
from krigora.llm.queries import byte_vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<double>, vector string, score int, block int, of int, place int"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def _clusters(n, dims, centres, noise, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))


def _brute_negatives(rows, one_in=50, positives=5, negatives=3):
    good = [(i, l, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, l, v) in enumerate(good):
        if i % one_in:
            continue
        scored = sorted((-int(v @ w), j, m == l, k) for k, (j, m, w) in enumerate(good) if len(w) == len(v) and k != a)
        for s, j, _, _ in [x for x in scored if x[2]][:positives]:
            found = [x for x in scored if not x[2] and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_hard_negatives(spark, monkeypatch, spread):
    """Clusters with more anchors than a block and more blocks than a wave holds; copies, ties and repeated rows among them."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "WAVE_BLOCKS", 2)
    x = _clusters(1500, 8, 12, spread)
    x[300:420] = x[300]
    rows = [(k, int(k * 7919 % 4), v.tolist()) for k, v in enumerate(x)] + [(100, 0, x[7].tolist()), (150, 2, x[150].tolist()), (150, 2, x[150].tolist())]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(_vectors(spark, rows).repartition(3)).collect())
    assert got == _brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (50, 1, [0.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.1]), (3, 2, [0.6, 0.3]), (3, 2, [0.6, 0.3]), (4, None, [0.7, 0.1]), (None, 2, [0.7, 0.1]), (5, 2, None), (6, 2, []), (7, 2, [0.7, None]), (8, 2, [0.7, float("nan")]), (9, 2, [float("inf"), 0.7]), (10, 2, [0.7]), (11, 2, [0.7, 0.1, 0.0]), (100, 3, [0.7, 0.1, 0.2]), (150, 1, [-1.0, 0.0]), (-50, 1, [0.5, 0.5])]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(_vectors(spark, rows)).collect())
    assert got == _brute_negatives(rows) and {r[0] for r in got} >= {0, -50} and any(r[0] == 0 and r[3] == 3 and r[2] == 3 for r in got)
    assert hard_negatives.hard_negatives(_vectors(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(_vectors(spark, [(None, None, None)] * 3)).collect() == []


def test_anchor_tree_prunes():
    """The tree is the shortest one, and along it most candidates of tight clusters are never scored."""
    x = np.floor(256 * _clusters(200, 16, 10, 0.02))
    order, parent, edge = hard_negatives.shortest_tree(x)
    assert sorted(order) == list(range(200)) and (parent[1:] < np.arange(1, 200)).all() and parent[0] == -1
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, length = [0], 0.0
    while len(inside) < 200:
        out = np.setdiff1d(np.arange(200), inside)
        part = d[np.ix_(inside, out)]
        length += part.min()
        inside.append(out[np.unravel_index(part.argmin(), part.shape)[1]])
    assert abs(edge.sum() - length) < 1e-6 * length
    raw = {"number": 0, "n": 200, "dim": 16, "ids": np.arange(200).tobytes(), "labels": np.zeros(200, np.int64).tobytes(), "vectors": x[order].tobytes(), "parents": parent.tobytes(), "edges": edge.tobytes()}
    block = hard_negatives.Block(raw, np.full((200, 1), -hard_negatives.LOWEST), np.full(200, hard_negatives.LOWEST), np.full(200, 1 << 62))
    c = np.floor(256 * _clusters(4000, 16, 10, 0.02))
    for s in range(0, 4000, 500):
        block.scan(np.arange(s, s + 500), np.zeros(500, np.int64), c[s : s + 500], True, 3)
    assert block.scored < 0.45 * 200 * 4000
    for k in range(200):
        s = c @ block.vectors[k]
        first = np.lexsort([np.arange(4000), -s])[:3]
        assert block.kept[k][1].tolist() == first.tolist() and block.kept[k][0].tolist() == s[first].astype(int).tolist()


def _brute_codes(rows, parts=8, entries=16, rounds=6):
    good = sorted(((i is None, i or 0, tuple(v), l) for i, l, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)))
    dims = max(1, -(-max(len(g[2]) for g in good) // parts))
    x = np.array([[*np.clip(np.floor(4096 * np.array(g[2], float)), -vector_codes.MOST, vector_codes.MOST).astype(int), *[0] * (parts * dims - len(g[2]))] for g in good], np.int64)
    code, error, books = np.zeros((len(x), parts), int), np.zeros(len(x), np.int64), []
    for p in range(parts):
        y = x[:, p * dims : (p + 1) * dims]
        c = y[:entries].copy()
        for r in range(rounds + 1):
            d = ((y[:, None] - c[None]) ** 2).sum(2)
            at = d.argmin(1)
            if r < rounds:
                for e in range(len(c)):
                    if (at == e).any():
                        c[e] = [int(v) // int((at == e).sum()) for v in y[at == e].sum(0)]
        code[:, p] = at
        error += d.min(1)
        books.append(c)
    total = Counter()
    for g, e in zip(good, error, strict=True):
        total[g[3]] += int(e)
    return sorted(((None if g[0] else g[1]) is None, g[1], "".join(f"{c:02x}" for c in k), int(e), total[g[3]]) for g, k, e in zip(good, code, error, strict=True))


@pytest.mark.parametrize("kind", ["clusters", "odd"])
def test_vector_codes(spark, monkeypatch, kind):
    if kind == "clusters":
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
        x = _clusters(700, 16, 9, 0.1)
        x[100:300] = x[100]
        rows = [(k, k % 5 if k % 6 else None, v.tolist()) for k, v in enumerate(x)]
    else:
        rows = [(1, 1, [0.5] * 9), (2, None, [0.25, -0.5]), (2, 3, [1e30, -1e30]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [float("nan")]), (6, 1, []), (None, None, [0.1, 0.2]), (1, 1, [0.5] * 9)]
    got = vector_codes.compress(_vectors(spark, rows).repartition(3)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == _brute_codes(rows)
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert vector_codes.compress(_vectors(spark, [])).collect() == [] and vector_codes.compress(_vectors(spark, [(1, 1, None)])).collect() == []


def test_trie_shares_prefixes():
    """Distances along the trie are those of the parts, whatever runs its subtrees are taken in; a shared prefix is one node."""
    rng = np.random.default_rng(2)
    parts = np.unique(rng.integers(-2, 3, (3000, 5)), axis=0)
    trie, entries = vector_codes.Trie(parts), rng.integers(-3, 4, (7, 5))
    assert trie.nodes() == sum(len(np.unique(parts[:, : k + 1], axis=0)) for k in range(5)) < 0.5 * parts.size
    want = ((parts[:, None] - entries[None]) ** 2).sum(2)
    for leaves in (1, 10, 700, 10**6):
        trie.subtrees.__func__.__defaults__ = (leaves,)
        got = list(trie.distances(entries))
        assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]] and (np.concatenate([g[2] for g in got]) == want).all()
    trie.subtrees.__func__.__defaults__ = (vector_codes.LEAVES,)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _brute_base(docs):
    words = {k: [w.lower() for w in WORD.findall((t or "").encode())] + [b""] for k, (_, t) in enumerate(docs)}
    count = Counter(w for k, (i, _) in enumerate(docs) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in words[k])
    n, v = sum(count.values()), len(count)
    return sorted((i or 0, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words[k]), sum(count[w] > 0 for w in words[k]), n, round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words[k]), 6)) for k, (i, _) in enumerate(docs))


def _base(got):
    return sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("hot", [100_000, 50])
def test_word_model(spark, monkeypatch, hot):
    """The words' scores, with nearly all words in the table of hot ones and with nearly none."""
    monkeypatch.setattr(attention_lm, "HOT_WORDS", hot)
    monkeypatch.setattr(attention_lm, "MOST_WORDS", 3000)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_attention_lm(spark, SF).collect()
    assert _base(got) == _brute_base(docs) and all(np.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_attention_is_better_than_frequencies(spark):
    """On held-out texts the attention model gives a subword at least 0.15 decimal orders more than the subwords' own shares."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    score = {r.doc_id: r.score for r in queries.op13_attention_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs["doc_id"]]
    sub, total = attention_lm.Subwords(byte_vocabulary()), Counter()
    ids = [sub.expand(sub.slots(attention_lm._words(pa.array([t])))[0]) for t in docs["text"]]
    for x, h in zip(ids, held, strict=True):
        if not h:
            total.update(x.tolist())
    n = sum(total.values()) + sub.size
    plain = {d: float(sum(np.log10((total[i] + 1) / n) for i in x.tolist())) for d, x, h in zip(docs["doc_id"], ids, held, strict=True) if h}
    size = sum(len(x) for x, h in zip(ids, held, strict=True) if h)
    assert score.keys() == plain.keys() and (sum(score.values()) - sum(plain.values())) / size > 0.15


def test_slopes_and_windows():
    """Slopes against differences; the scorer against the plain forward pass; every id scored once, probabilities summing to one."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 500, 7000)
    voc = attention_lm.Vocabulary(counts)
    assert np.allclose(np.bincount(voc.classes, np.exp(voc.share), attention_lm.CLASSES), 1) and voc.classes.max() == attention_lm.CLASSES - 1
    w = {k: x.astype(np.float64) for k, x in attention_lm.first_weights(voc.level).items()}
    ids = rng.integers(0, 7000, 100)
    off = np.array([0, 1, 18, 50, 51, 100])
    rows, own, text, _ = attention_lm._padded(ids, off, voc)
    assert sorted(own[own >= 0].tolist()) == list(range(100)) and text.tolist() == [0, 1, 1, 2, 2, 3, 4, 4, 4, 4]
    assert (rows[0] == [attention_lm.PAD] * 16 + [attention_lm.BEGIN] + [attention_lm.PAD] * 15).all() and rows[2][:16].tolist() == [attention_lm.BEGIN, *voc.rows[ids[1:16]]]
    targets = np.where(own >= 0, voc.classes[ids[np.maximum(own, 0)]], -1)
    loss, g = attention_lm.loss_and_slopes(w, rows, targets)
    for k in w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w[k].shape) if k != "e" else (rows[3, 20], rng.integers(0, attention_lm.WIDTH))
            step = {n: x.copy() for n, x in w.items()}
            step[k][at] += 1e-5
            up = attention_lm.loss_and_slopes(step, rows, targets)[0]
            step[k][at] -= 2e-5
            assert abs((up - attention_lm.loss_and_slopes(step, rows, targets)[0]) / 2e-5 - g[k][at]) < 1e-5, k
    w = {k: x.astype(np.float32) for k, x in w.items()}
    got = attention_lm.Scorer(w, voc).log10(ids, off, at_once=3)
    assert abs(got.sum() * np.log(10) - (voc.share[ids].sum() - 100 * loss)) < 1e-3
    each = [attention_lm.Scorer(w, voc).log10(ids[a:z], np.array([0, z - a]))[0] for a, z in zip(off[:-1], off[1:], strict=True)]
    assert np.allclose(got, each, atol=1e-4)
    # All continuations of a text have probabilities that sum to one.
    tails = np.concatenate([np.append(ids[1:18], k) for k in range(7000)])
    more = attention_lm.Scorer(w, voc).log10(tails, np.arange(0, len(tails) + 1, 18))
    assert abs((10 ** (more - got[1])).sum() - 1) < 1e-3


def test_every_training_id_is_learned(spark, monkeypatch):
    """Over all rounds and tasks each id of the training texts is a target once, after all that the scorer sees before it."""
    seen = spark.sparkContext.accumulator(0)
    steps = attention_lm.train_steps

    def counted(w, parts, seed, rate):
        def tell():
            for rows, targets in parts:
                seen.add(int((targets >= 0).sum()))
                yield rows, targets

        return steps(w, tell(), seed, rate)

    monkeypatch.setattr(attention_lm, "train_steps", counted)
    docs = [(k, " ".join(f"word{(k * j) % 89}" for j in range(k % 300))) for k in range(400)]
    attention_lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), byte_vocabulary()).count()
    sub = attention_lm.Subwords(byte_vocabulary())
    want = [len(sub.expand(sub.slots(attention_lm._words(pa.array([t])))[0])) for k, t in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    assert seen.value == sum(want)


def test_windows_are_the_scorers():
    rng = np.random.default_rng(8)
    voc, ids, off = attention_lm.Vocabulary(rng.integers(0, 500, 7000)), rng.integers(0, 7000, 1000), np.array([0, 1, 1, 400, 417, 1000])
    (got,) = attention_lm.training_windows(ids, off, voc)
    rows, own, _, _ = attention_lm._padded(ids, off, voc)
    assert (got[0] == rows).all() and sorted(own[own >= 0].tolist()) == list(range(1000)) and (got[1][own >= 0] == voc.classes[ids[own[own >= 0]]]).all() and (got[1][own < 0] == -1).all()
    w, n = attention_lm.train_steps(attention_lm.first_weights(voc.level), iter([got, got]), [1], 0.01)
    assert n == 2 * len(rows) and attention_lm.loss_and_slopes(w, rows, got[1].astype(int))[0] < attention_lm.loss_and_slopes(attention_lm.first_weights(voc.level), rows, got[1].astype(int))[0]
    assert attention_lm.train_steps(w, iter([]), [1], 0.01)[1] == 0


def test_windows_by_blocks():
    """Windows laid out by blocks against each place's own definition; inputs have two bytes, as eight cost training its passes."""
    rng = np.random.default_rng(9)
    voc, off = attention_lm.Vocabulary(rng.integers(0, 500, 7000)), np.array([0, 0, 1, 17, 17, 49, 300, 300])
    ids = rng.integers(0, 7000, 300)
    rows, own, text, number = attention_lm._padded(ids, off, voc)
    assert rows.dtype == np.int16 and len(rows) == sum(-(-n // attention_lm.OWN) for n in np.diff(off))
    for w in range(len(rows)):
        start, n = off[text[w]], off[text[w] + 1] - off[text[w]]
        for k in range(attention_lm.LENGTH):
            place = number[w] * attention_lm.OWN + k - attention_lm.CONTEXT
            inside = 0 <= place < n
            assert rows[w, k] == (attention_lm.PAD if not inside else voc.rows[ids[start + place - 1]] if place else attention_lm.BEGIN)
            assert k < attention_lm.CONTEXT or own[w, k - attention_lm.CONTEXT] == (start + place if inside else -1)


def test_words_encoded_together():
    """What a word is encoded as does not hang on the words that it is encoded with; white space of other kinds included."""
    import tiktoken

    words = ["the", "dog's", "x" * 3000, "été", "\u3000", "a\u3000", "\u3000b", "12,34", "\u2003\u2003", "'s", "…", "\x1c", "<|endoftext|>"]
    sub = attention_lm.Subwords(byte_vocabulary())
    plain = tiktoken.Encoding("t", pat_str=byte_vocabulary()[1], mergeable_ranks=sub.encoding._mergeable_ranks, special_tokens={})
    slots, off = sub.slots([[w.encode() for w in words], [], [words[0].encode()]])
    assert off.tolist() == [0, len(words) + 1, len(words) + 2, len(words) + 4]
    for w, s in zip(words, slots, strict=False):
        assert sub.expand(np.array([s])).tolist() == plain.encode_ordinary(" " + w)
    assert sub.expand(slots[-3:]).tolist() == [sub.end, *plain.encode_ordinary(" the"), sub.end]


def test_odd_texts(spark):
    long = " ".join(f"Word{k % 977}" for k in range(50_000))
    rows = [(1, "The cat, the CAT"), (2, None), (3, ""), (4, long), (None, "the dog"), (5, " \t\n\x0b "), (6, "x" * 200_000), (7, "the the the"), (7, "the the the"), (8, "　 été ퟿"), (9, "<|endoftext|> end"), (1000, "unseen words")]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, word string, n int, row int")
    got = attention_lm.score_texts(df, byte_vocabulary()).collect()
    assert _base(got) == _brute_base(rows) and all(np.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 5)}) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert attention_lm.score_texts(df.limit(0), byte_vocabulary()).collect() == []
    held = attention_lm.score_texts(df.where("doc_id = 2"), byte_vocabulary(), held_out=int(zlib.crc32(b"2") % 7)).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in held] == [(True, 0, 0, 0.0)]
