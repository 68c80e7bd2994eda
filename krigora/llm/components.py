"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written


def _with_least(links: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """``links`` (u, v), at most ``n`` rows, with ``m``, the least v of each u.

    Nodes with very many links (at most as many as fit into 4 x partitions shares of all rows) are joined by broadcast, so
    that the centre of a star is no hot key.
    """
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "c")
    if n <= most:  # no node can have more
        return links.join(low.drop("n"), F.col("u") == F.col("c")).select("u", "v", "m")
    low, bound = written(low, "least-links"), max(most, n // (4 * shuffle_partitions(links.sparkSession)))
    hot, rest = F.broadcast(low.where(F.col("n") > bound).drop("n")), low.where(F.col("n") <= bound).drop("n")
    crowded = links.join(hot, F.col("u") == F.col("c")).select("u", "v", "m")
    other = links.join(hot, F.col("u") == F.col("c"), "left_anti").join(rest, F.col("u") == F.col("c")).select("u", "v", "m")
    return crowded.unionByName(other)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, root): the smallest node reachable, for every node that has a link.

    Each round joins the links with a per-node minimum, so no task gathers a node's neighbours; the link table never grows
    beyond its first size and every round is written to the shared folder, where the round before it is deleted.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    n, seen = edges.count(), None
    for _ in range(most_rounds if n else 0):
        both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        stars = _with_least(large, 2 * n)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.distinct(), "links")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if not n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        raise RuntimeError(f"links are not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
