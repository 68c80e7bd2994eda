"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random

import pytest

pytest.importorskip("krigora.llm")
from krigora.llm import embedding_dedup, gam_quality, hilbert, langid, line_dedup, mixing, packing, pii, quality_rules, simhash
from krigora.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, part int, size int, fp string, key string, _gone int, node int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z", 4, 5) for r in rows], SCHEMA)


def _rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and"]
    long = " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(60_000))
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(1, text(50), "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", "a", 9), (None, text(30), "de", None, 7), (5, " \t\n\x0b ", None, "a", 1), (6, "\n\n", "en", "b", 2), (7, "123 456 !!", "en", "c", 3)]
    same = (8, text(40) + "\n" + "A shared line that is long enough to be counted twice.", "en", "a", 4)
    return rows + [same] * 3 + [(10 + i, same[1], "en", "a", 4) for i in range(6)]


OPERATORS = {
    "gam": lambda s, d: gam_quality.classify(d, s.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (8, 1), (8, None)], "doc_id long, quality int")),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "rules_kept": lambda s, d: quality_rules.kept_rows(d),
    "hilbert": lambda s, d: hilbert.hilbert_shards(d),
    "packing": lambda s, d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json"), group_rows=4),
    "mix_plan": lambda s, d: mixing.mix_plan(d),
    "mix": lambda s, d: mixing.mix(d),
    "langid": lambda s, d: langid.identify(d, langid.fit(d)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "lines_row": lambda s, d: line_dedup.dedup_lines(d, with_row=True).select("row.*"),
    "pii": lambda s, d: pii.find_personal_data(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash_kept": lambda s, d: simhash.keep_first(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = _rows()
    got = OPERATORS[name](spark, _docs(spark, rows)).collect()
    if name in ("gam", "rules", "hilbert", "mix_plan", "langid", "lines", "lines_row", "pii", "simhash"):
        assert len(got) == len(rows)
    if name == "hilbert":
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    if name == "lines":
        dropped = {r.doc_id: r.n_dropped for r in got}
        assert dropped[15] == 0 and all(dropped[i] == 1 or dropped[i] == 2 for i in (8, 10, 14))
        assert [r.n_lines for r in got if r.doc_id == 2] == [1] and [r.n_lines for r in got if r.doc_id == 6] == [3]
    if name == "simhash":
        comp = {r.doc_id: r.component_id for r in got}
        assert comp[2] == comp[3] == comp[5] == comp[6] == 2 and comp[15] == 8
    if name == "simhash_kept":
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 4, 7, 8, 8, 8]
    if name == "langid":
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 5, 6, 7))
    if name == "packing":
        fill = {}
        for r in got:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert max(fill.values()) <= 4096
        assert len([r for r in got if r.doc_id == 8]) == 3
    if name == "mix_plan":
        assert all(0 <= r.taken <= 2 * r.size for r in got)
    if name in ("rules_kept", "lines_row", "simhash_kept", "mix"):
        assert [f.name for f in OPERATORS[name](spark, _docs(spark, rows)).schema] == _docs(spark, rows).columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, _docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["gam", "rules", "hilbert", "mix_plan", "langid", "lines", "pii", "simhash", "packing"])
def test_all_null(spark, name):
    got = OPERATORS[name](spark, _docs(spark, [(None, None, None, None, None)] * 3)).collect()
    assert len(got) == 3


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, []), (9, [-1.0, 0.0, -0.0]), (10, [-1.0, -0.0, 0.0]), (11, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, vector string, rep long")
    got = {}
    for r in embedding_dedup.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] and got[3] == [(3, 1, False)] * 2
    assert got[9] == [(1, 9, True)] and got[10] == [(1, 9, False)]
    assert all(got[k] == [(0, k, True)] for k in (4, 5, 6, 7, 8, 11)) and got[None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_lines_of_blanks(spark):
    """A line of 1,000,000 blanks is nothing special, at its ends or within; ids repeated with other texts are rows each."""
    shared = "A shared line that is long enough to be counted as one."
    blank = " \t\r\x0b\x0c" * 200_000
    rows = [(i, f"{blank}{shared.upper()}{blank}\n{i}x{blank}y", "en", "a", 1) for i in range(5)] + [(4, shared, "en", "a", 1), (4, "other", "en", "a", 1)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.text)) for r in line_dedup.dedup_lines(_docs(spark, rows)).collect())
    assert got == [(i, 2, 1, 1_000_003) for i in range(4)] + [(4, 1, 0, 5), (4, 1, 0, len(shared)), (4, 2, 0, 2 * len(blank) + len(shared) + 1 + 1_000_003)]


@pytest.mark.parametrize("rows", [_rows(), [], [(None, None, None, None, None)] * 2])
def test_pipeline_stages(spark, tmp_path, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = _docs(spark, rows)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == _docs(spark, []).columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()
    assert sum(r.piece == 0 for r in packed) == spark.read.parquet(f"{tmp_path}/documents.parquet").count()
    _docs(spark, rows).write.parquet(f"{tmp_path}/in/documents.parquet")
    again = pipeline.run(spark, f"{tmp_path}/in").collect()
    assert sorted((r.doc_id or 0, r.piece) for r in again) == sorted((r.doc_id or 0, r.piece) for r in packed)
