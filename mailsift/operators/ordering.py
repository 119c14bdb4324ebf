"""Exact ranks, positions and neighbours without one task holding a whole group.

A single window over a class, a file or a conversation would put it into one task. Here
rows are first counted in narrow buckets; only the small count tables are ordered as a
whole, and ranks are taken inside one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions.hashing import hash_bucket, seed_hash
from mailsift.sources.scratch import land


def class_totals(df: DataFrame, label: str) -> DataFrame:
    """``g, n``: rows per class."""
    return df.groupBy(F.col(label).alias("g")).agg(F.count("*").alias("n"))


def cutoffs(df: DataFrame, ranks: DataFrame, label: str | None, key: str, seed: int) -> DataFrame:
    """``g, rank, h, k, tied``: hash and key at each wanted rank of each class, in seeded order.

    ``ranks`` has a row ``g, rank`` for each rank wanted (from 1 to the class size; ``g`` is
    null for the only class where there is no ``label``). Reads only label and key: one pass
    counts 65,536 hash buckets per class and finds the bucket of each rank, a second ranks
    the rows of just those buckets. No class is sorted as a whole.
    """
    group = F.col(label) if label else F.lit(None).cast("string")
    rows = df.select(group.alias("g"), F.col(key).alias("k"), seed_hash(seed, key).alias("h"))
    rows = rows.withColumn("bucket", hash_bucket(F.col("h")))
    running = Window.partitionBy("g").orderBy("bucket")
    counts = (
        rows.groupBy("g", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    wanted = ranks.select(F.col("g").alias("cg"), "rank").distinct()
    within = (
        F.col("g").eqNullSafe(F.col("cg"))
        & (F.col("rank") > F.col("upto") - F.col("n"))
        & (F.col("rank") <= F.col("upto"))
    )
    local = (F.col("rank") - F.col("upto") + F.col("n")).alias("local")
    cuts = land(counts.join(wanted, within).select("cg", F.col("bucket").alias("cbucket"), "rank", local), "cuts")

    in_bucket = Window.partitionBy("g", "bucket").orderBy("h", "k")
    next_key = F.lead(F.struct("h", "k")).over(in_bucket)
    here = F.col("g").eqNullSafe(F.col("cg")) & (F.col("bucket") == F.col("cbucket"))
    ranked = (
        rows.join(cuts.select("cg", "cbucket").distinct(), here, "left_semi")
        .withColumn("place", F.row_number().over(in_bucket))
        .withColumn("tied", F.coalesce(next_key == F.struct("h", "k"), F.lit(False)))
    )
    found = ranked.join(cuts, here & (F.col("place") == F.col("local")))
    return found.select("g", "rank", "h", "k", "tied")


def rank_cutoffs(
    df: DataFrame, ranks: Mapping, label: str | None, key: str, seed: int
) -> dict[tuple, tuple[str, object]]:
    """``cutoffs`` for the few ranks a caller names, by ``(class, rank)``.

    ``key`` must be unique, or a cut could fall between equal rows; that is checked.
    """
    wanted = [(value, r) for value, group in ranks.items() for r in sorted(set(group))]
    if not wanted:
        return {}
    kind = df.schema[label].dataType if label else T.StringType()
    table = _small_table(df.sparkSession, wanted, g=kind, rank=T.LongType())
    found = cutoffs(df, table, label, key, seed).collect()
    if any(row.tied for row in found):
        raise ValueError(_TIED.format(key))
    return {(row.g, row.rank): (row.h, row.k) for row in found}


_TIED = "'{}' is not unique, so rows cannot be drawn by it"


def check_untied(cuts: DataFrame, tied: str, key: str) -> None:
    """Make sure that no written cutoff falls between equal rows."""
    if not cuts.filter(tied).isEmpty():
        raise ValueError(_TIED.format(key))


def _small_table(spark: SparkSession, rows: list[tuple], **types: T.DataType) -> DataFrame:
    """A driver-side table of a few rows, planned as a local relation."""
    schema = T.StructType([T.StructField(name, kind) for name, kind in types.items()])
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(column) for column in zip(*rows)], names=list(types)), schema
    )


def up_to(cutoff: tuple[str, object], hashed: Column, key: str) -> Column:
    """True for rows at or before a cutoff in seeded hash order."""
    h, k = cutoff
    return (hashed < h) | ((hashed == h) & (F.col(key) <= F.lit(k)))


def with_position(df: DataFrame, key: str, seed: int, name: str = "index") -> DataFrame:
    """Number the rows 0, 1, 2, … in seeded hash order, bucket by bucket in parallel."""
    h, b, start = "__hash", "__bucket", "__start"
    hashed = df.withColumn(h, seed_hash(seed, key)).withColumn(b, hash_bucket(F.col(h)))
    # At most 65,536 rows, whatever the table holds.
    starts = (
        df.select(hash_bucket(seed_hash(seed, key)).alias(b))
        .groupBy(b)
        .agg(F.count("*").alias("n"))
        .select(b, (F.sum("n").over(Window.orderBy(b)) - F.col("n")).alias(start))
    )
    rank = F.row_number().over(Window.partitionBy(b).orderBy(h, key))
    return (
        hashed.withColumn(name, rank - 1)
        .join(F.broadcast(starts), b)
        .withColumn(name, F.col(name) + F.col(start))
        .drop(h, b, start)
    )


def with_neighbours(
    df: DataFrame, group: str, order: str, value: str, chunk: int = 4096
) -> DataFrame:
    """Add ``previous`` and ``next`` of a column within a group, and the group's ends.

    ``order`` is a whole number, unique within its group. Groups are worked on in chunks
    of the order range, so a group of any size is spread over many tasks; a narrow table
    with one row per chunk carries values across chunk borders.
    """
    # A missing group is a group like any other: told by a flag, as nulls never join.
    c, edge, own = "__chunk", "__edge", ["__missing", "__group"]
    chunked = df.withColumns(
        {
            c: F.expr(f"`{order}` div {chunk}"),
            "__missing": F.col(group).isNull(),
            "__group": F.coalesce(F.col(group).cast("string"), F.lit("")),
        }
    )
    inside = Window.partitionBy(*own, c).orderBy(order)
    # Wrapped, so that a missing neighbour differs from a neighbour without a value.
    cell = F.struct(F.col(value).alias("v"))
    local = chunked.withColumn("__prev", F.lag(cell).over(inside)).withColumn(
        "__next", F.lead(cell).over(inside)
    )
    across = Window.partitionBy(*own).orderBy(c)
    edges = (
        chunked.groupBy(*own, c)
        .agg(F.min_by(cell, order).alias("first"), F.max_by(cell, order).alias("last"))
        .select(
            *own,
            c,
            F.struct(
                F.lag("last").over(across).alias("before"),
                F.lead("first").over(across).alias("after"),
            ).alias(edge),
        )
    )
    before = F.coalesce(F.col("__prev"), F.col(f"{edge}.before"))
    after = F.coalesce(F.col("__next"), F.col(f"{edge}.after"))
    # Joined on the window's own keys, so the wide side is not shuffled again.
    return (
        local.join(edges, [*own, c], "left")
        .withColumn("previous", before["v"])
        .withColumn("next", after["v"])
        .withColumn("is_first", before.isNull())
        .withColumn("is_last", after.isNull())
        .drop(*own, c, edge, "__prev", "__next")
    )


def with_ordinals(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the records of every file 0, 1, 2, … as they stand in it.

    Expects the scan-order columns ``file, block, seq``. Each block of a file is numbered
    on its own; block starts come from a table with one row per block.
    """
    blocks = df.groupBy("file", "block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("block")) - F.col("__n")
    starts = blocks.select("file", "block", before.alias("__start"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))
    return (
        df.withColumn("__rank", rank - 1)
        .join(starts, ["file", "block"])
        .withColumn(name, F.col("__rank") + F.col("__start"))
        .drop("__rank", "__start")
    )


