"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing of sources, packing.

Every stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents`` (and whatever other columns came with them); the last returns one row per packed piece. An empty table goes
through all stages and gives no rows; very long texts are taken whole everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krigora.llm import line_dedup, mixing, packing, quality_rules, simhash
from krigora.llm.common import table, written
from krigora.llm.queries import tokenizer_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or diverge from their language go.

    A null or empty text has no words and goes; a null language is judged by the nearest reference; repeated rows fare alike.
    """
    return quality_rules.kept_rows(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for their last document; ``n_chars`` follows a text that changed.

    A null text stays null; a null id counts as the smallest; all rows of the largest id that holds a line keep it.
    """
    got = line_dedup.dedup_lines(docs, with_row=True)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, changed).otherwise(F.col("row.n_chars")))
    return got.select(row.alias("row")).select("row.*")


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.

    Null ids stay and never stand for a group; rows repeated under the id that stays all stay; texts without words are copies.
    """
    return simhash.keep_first(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it, in whole documents.

    A null source is a source; documents without words stay once; repeated rows share a key and so fare alike.
    """
    return mixing.mix(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset; null texts are the end id alone, repeated rows packed each."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _quality),
    ("line_dedup", _lines),
    ("simhash_near_dedup", _near_copies),
    ("source_mixing", _mix),
    ("best_fit_packing", _pack),
]

#: Neither the token ids nor the fingerprints can be had in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
