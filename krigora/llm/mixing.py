"""Mixing sources to target weights: hash-random keys, range prefix sums, an exact cut per source.

Every document gets a random key (the md5 of its id and a seed). Within a source the keys are dealt to ranges by their
leading digits; word totals of the ranges are summed by Spark, prefix sums over the ranges find the one range where the
source's budget ends, and only that range is sorted row by row to find the cut key. A document below the cut is taken once
more than a document above it, so whole epochs repeat when the target exceeds the source. No document is shuffled: ranges
and cuts are small tables, however large a single source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import running_total, shuffle_partitions, with_arrow, word_counts, written

#: Most rows of the table of cuts that are broadcast; with more sources the join shuffles.
BROADCAST_SOURCES = 20_000


def random_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) -> plus ``target``: water filling of ``share`` of all words by weight.

    Sources by code point, null last, get the weights in turn. A target stops at ``epochs`` times its source's size; what
    is cut off goes to the others by weight, so the level is the first at which the remaining sources stay below their stop.
    The table has one row per source, ranked in ranges of the name; the windows that find the level run in one task over the
    numbers of the sources (a few million at most).
    """
    named = sizes.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1))
    place = running_total(named, ["last", "source"], "one")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = place.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(epochs)).alias("stop"))
    order = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("at"))).over(whole)
    leveled = ranked.select("*", level.alias("level"), F.row_number().over(order).alias("at")).withColumn("first", first)
    return leveled.withColumn("level", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole)).select(
        "source", "source_size", F.when(F.col("at") < F.col("first"), F.col("stop")).otherwise(F.least("stop", F.col("level") * F.col("w"))).alias("target")
    )


def source_cuts(sized: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, key, size) rows -> per source: source_size, target, whole epochs, the cut key, words left for it and its size."""
    spark = sized.sparkSession
    digits = 1
    while 16**digits < max(4 * shuffle_partitions(spark), 64) and digits < 6:
        digits += 1
    part = F.substring("key", 1, digits)
    ranges = written(sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")), "mix-ranges")
    goals = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), share, epochs, weights)
    goals = written(
        goals.withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size")),
        "mix-goals",
    )
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("before", before).alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    # One range per source holds its cut; the rest of them lie wholly below or above.
    edge = placed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("r.source", "part", "before", "rest")
    keys = sized.alias("k").join(edge.alias("e"), F.col("k.source").eqNullSafe(F.col("e.source")) & (part == F.col("e.part"))).groupBy("e.source", "e.part", "e.before", "e.rest", "k.key").agg(F.sum("k.size").alias("unit"))
    start = F.col("before") + F.coalesce(F.sum("unit").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = keys.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("unit"))).select("source", F.col("key").alias("cut"), (F.col("rest") - F.col("start")).alias("left"), "unit")
    return written(goals.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "g.source_size", "g.target", F.col("g.whole").cast("long").alias("whole"), "c.cut", "c.left", "c.unit"), "mix-cuts")


def _taken(size: Column, key: Column, split: bool) -> Column:
    """Words the mix takes of a document; rows of one key (repeated rows) share what is left in proportion."""
    at_cut = F.floor(F.col("left") * size / F.greatest("unit", F.lit(1))) if split else F.when(2 * F.col("left") >= F.col("unit"), size).otherwise(0)
    return (F.col("whole") * size + F.when(F.col("cut").isNull() | (key > F.col("cut")), 0).when(key < F.col("cut"), size).otherwise(at_cut)).cast("long")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    side = cuts.withColumnRenamed("source", "cut_source")
    if cuts.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("cut_source")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    Size: words ``[^\\x20\\x09-\\x0D]+`` (null or empty text: 0, taken 0). A null source is a source of its own. The document
    at the cut gives a part of its words, so a source's taken words equal its rounded target. Repeated rows share a key and
    divide what is left at the cut. An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = with_arrow(rows, lambda b: [_pa(word_counts(b.column(2)))], "size long", drop=("text",))
    sized = written(rows.withColumn("key", random_key(F.col("doc_id"), seed)), "mix-sizes")
    return _with_cuts(sized, source_cuts(sized, **targets)).select("doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("key"), True).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **targets) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as it is taken.

    Documents stay whole: the one at a source's cut is taken if at least half of it fits. Documents without words take no
    budget and stay once. A null source is a source of its own; rows of one key (repeated rows, null ids) fare alike. Very long
    texts count whole; an empty table gives no rows. Columns and their names are those of ``docs``.
    """
    at = docs.columns.index(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    rows = with_arrow(rows, lambda b: [_pa(word_counts(b.column(0).field(at)))], "size long").withColumn("key", random_key(F.col("doc_id"), seed))
    sized = written(rows.select("source", "key", "size"), "mix-sizes")
    times = F.when(F.col("size") == 0, 1).otherwise((_taken(F.col("size"), F.col("key"), False) / F.col("size")).cast("int"))
    return _with_cuts(rows, source_cuts(sized, **targets)).where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")


def _pa(values):
    import pyarrow as pa

    return pa.array(values, pa.int64())


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS stop FROM s),
l AS (SELECT *, row_number() OVER o AS pos,
             ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r WINDOW o AS (ORDER BY stop / w, source NULLS LAST)),
f AS (SELECT min(pos) AS first FROM l WHERE level * w <= stop),
v AS (SELECT level AS lvl FROM l, f WHERE pos = first),
t AS (SELECT source, source_size, CASE WHEN pos < first THEN stop ELSE least(stop, lvl * w) END AS target FROM l, f, v),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
p AS (SELECT d.*, g.source_size, g.target, g.whole, g.budget - g.whole * g.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
