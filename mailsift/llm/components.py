"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.sources.scratch import land


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in the links ``a, b``; the smallest id names it.

    Each round points every node to its neighbour of lowest rank, if lower than its own,
    follows the pointers twice, and merges nodes that point to the same one. Ranks are ids
    and fresh hashes by turns: the first collapse a star around its smallest id at once,
    the second shrink chains of any numbering by a constant factor, so rounds grow with
    the logarithm of the longest chain. Rounds are joins and aggregations of tables in the
    shared folder; a node with very many links is counted up inside tasks first. Repeated
    links and links of an id to itself do no harm.
    """
    edges = land(links.select("a", "b").filter("a <> b").distinct(), "edges")
    ids = _both(links.select("a", "b")).select(F.col("a").alias("id")).distinct()
    labels = land(ids.withColumn("root", F.col("id")), "labels")
    turn = 0
    while not edges.isEmpty():
        roots = land(_roots(edges, turn), "roots")
        renamed = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
        labels = land(
            labels.join(renamed, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "labels"
        )
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        merged = edges.join(a, "a").join(b, "b").filter("root_a <> root_b")
        lower, upper = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        edges = land(merged.select(lower.alias("a"), upper.alias("b")).distinct(), "edges")
        turn += 1
    names = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(names, "root").select("id", "component")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _roots(edges: DataFrame, turn: int) -> DataFrame:
    """``node, root``: where two steps along lowest-ranked neighbours lead."""

    def ranked(column: str):
        rank = F.xxhash64(F.col(column), F.lit(turn)) if turn % 2 else F.lit(0)
        return F.struct(rank.alias("rank"), F.col(column).alias("id"))

    nearest = _both(edges).groupBy("a").agg(F.min(ranked("b")).alias("best"))
    steps = land(nearest.select(F.col("a").alias("node"), F.least("best", ranked("a"))["id"].alias("next")), "steps")
    following = steps.select(F.col("node").alias("next"), F.col("next").alias("root"))
    return steps.join(following, "next").select("node", "root")
