"""Putting a data set together: union, balance, shuffle, split, counts, samples."""

from __future__ import annotations

import functools
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.hashing import seed_hash
from mailsift.operators.ordering import check_untied, class_totals, cutoffs, rank_cutoffs, up_to, with_position
from mailsift.sources.scratch import land

SEED = 42


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All rows of all sources; equal rows of different sources all stay."""
    return functools.reduce(DataFrame.unionByName, dfs)


def _is_class(label: str, value) -> Column:
    return F.col(label).eqNullSafe(F.lit(value))


def balance(
    df: DataFrame, label: str = "label", keep=1, draw=0, key: str = "key", seed: int = SEED
) -> DataFrame:
    """Keep every row of one class and exactly as many, drawn by seed, of the other.

    Reads label and key to find the cutoff; the mails themselves are only filtered, never
    shuffled. Hand in a landed table (``land``) when ``df`` is expensive to compute.
    """
    both = df.filter(_is_class(label, keep) | _is_class(label, draw))
    totals = {row.g: row.n for row in class_totals(both, label).collect()}
    size, available = totals.get(keep, 0), totals.get(draw, 0)
    if available < size:
        raise ValueError(f"cannot draw {size} rows of class {draw!r} from {available}")
    drawn = F.lit(False)
    if size:
        cutoffs = rank_cutoffs(df.filter(_is_class(label, draw)), {draw: [size]}, label, key, seed)
        drawn = up_to(cutoffs[(draw, size)], seed_hash(seed, key), key)
    return df.filter(_is_class(label, keep) | (_is_class(label, draw) & drawn))


def shuffle(df: DataFrame, key: str = "key", seed: int = SEED) -> DataFrame:
    """All rows in seeded pseudo-random order (a distributed range sort)."""
    return df.orderBy(seed_hash(seed, key), key)


def with_index(df: DataFrame, key: str = "key", seed: int = SEED) -> DataFrame:
    """Position of each row in the seeded shuffle, counted from 0."""
    return with_position(df, key, seed, "index")


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def split_sizes_for(n: int, holdout: Fraction, test_share: Fraction) -> dict[str, int]:
    """Exact sizes of the three parts; both cuts round the later part up."""
    held = _ceil(n * holdout)
    test = _ceil(held * test_share)
    return {"train": n - held, "valid": held - test, "test": test}


def proportional(sizes: DataFrame, total: int, whole: int, of: str, name: str) -> DataFrame:
    """Add ``name``: a total divided in proportion to column ``of``, which adds up to ``whole``.

    Largest remainder; ties go to the smaller class, a missing class first. One small row
    per class is ordered, never the classes' rows.
    """
    exact = F.col(of).cast("decimal(38,0)") * F.lit(total).cast("decimal(18,0)")
    shares = sizes.withColumn("__exact", exact)
    shares = shares.withColumn("__rest", F.expr(f"__exact % {max(whole, 1)}"))
    shares = shares.withColumn(name, F.expr(f"__exact div {max(whole, 1)}"))
    order = Window.orderBy(F.desc("__rest"), F.asc_nulls_first("g"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = F.row_number().over(order) <= F.lit(total) - F.sum(name).over(every)
    return shares.withColumn(name, F.col(name) + more.cast("long")).drop("__exact", "__rest")


def split_quotas(totals: DataFrame, holdout: Fraction, test_share: Fraction) -> DataFrame:
    """``g, n, train, valid``: rows per class that go to train and to valid; the rest is test.

    Both quotas are one plan over ``totals``, which should be a written table.
    """
    n = totals.agg(F.sum("n")).first()[0] or 0
    sizes = split_sizes_for(n, holdout, test_share)
    held = proportional(totals, sizes["train"], n, "n", "train").withColumn("held", F.col("n") - F.col("train"))
    return proportional(held, sizes["valid"], n - sizes["train"], "held", "valid").drop("held")


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "key",
    seed: int = SEED,
    holdout: Fraction | str = "0.2",
    test_share: Fraction | str = "0.5",
) -> DataFrame:
    """Add ``split``: exact train / valid / test sizes, every class in proportion.

    Per class, the first rows in seeded hash order are train, the next valid, the rest
    test. As in ``balance``, only label and key are read to place the cuts. There may be
    any number of classes: quotas and cuts are tables with a row per class, and rows meet
    the cuts of their class by a join, which shuffles nothing while that table is small.
    """
    totals = land(class_totals(df, label), "totals")
    quotas = land(split_quotas(totals, Fraction(holdout), Fraction(test_share)), "quotas").select(
        F.col("g").alias("__g"), F.col("n").alias("__n"), F.col("train").alias("__a"),
        (F.col("train") + F.col("valid")).alias("__b"),
    )
    ends = quotas.select("__n", F.col("__g").alias("g"), F.explode(F.array("__a", "__b")).alias("rank"))
    cuts = cutoffs(df, ends.filter("rank > 0 AND rank < __n"), label, key, seed)

    def cut_at(end: str) -> Column:
        return F.min(F.when(F.col("rank") == F.col(end), F.struct("h", "k"))).alias(f"{end}_cut")

    of_class = land(
        quotas.join(cuts, F.col("__g").eqNullSafe(F.col("g")), "left")
        .groupBy("__g", "__n", "__a", "__b")
        .agg(cut_at("__a"), cut_at("__b"), F.coalesce(F.bool_or("tied"), F.lit(False)).alias("__tied")),
        "cuts_of_classes",
    )
    check_untied(of_class, "__tied", key)
    place = F.struct(seed_hash(seed, key).alias("h"), F.col(key).alias("k"))

    def within(end: str) -> Column:
        first = F.when(F.col(end) >= F.col("__n"), True).otherwise(place <= F.col(f"{end}_cut"))
        return (F.col(end) > 0) & first

    split = F.when(within("__a"), "train").when(within("__b"), "valid").otherwise("test")
    joined = df.join(of_class, F.col(label).eqNullSafe(F.col("__g")))
    return joined.withColumn("split", split).drop(*of_class.columns)


def class_counts(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows per split and class, and per class over all splits (split ``all``)."""
    every = F.when(F.grouping(split) == 1, "all").otherwise(F.col(split))
    counted = df.groupingSets([[split, label], [label]], split, label).agg(
        every.alias("part"), F.count("*").alias("n")
    )
    return counted.select(F.col("part").alias(split), label, "n")


def source_label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "label").agg(F.count("*").alias("n"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))


def sample_at_most(
    df: DataFrame, cap: int | None, key: str = "key", seed: int = SEED
) -> DataFrame:
    """All rows when there are no more than ``cap``, else exactly ``cap`` drawn by seed."""
    if cap is None or cap >= df.count():
        return df
    if cap <= 0:
        return df.limit(0)
    cutoff = rank_cutoffs(df, {None: [cap]}, None, key, seed)[(None, cap)]
    return df.filter(up_to(cutoff, seed_hash(seed, key), key))


def head_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``; none or 0 means all.

    The place of the last one is found on the order columns alone, dealt out by range; the
    rows are then filtered by it, so ``n`` may be large. Of rows that tie for the last
    places any are taken.
    """
    if not n:
        return df
    order = order or ("key",)
    at = F.struct(*order)
    ranges = df.select(at.alias("at")).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    ranges = land(ranges, "ranges")
    before = 0
    for part, rows in sorted(ranges.groupBy("part").count().collect()):
        if before + rows >= n:
            break
        before += rows
    else:
        return df.orderBy(*order)
    place = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    own = ranges.filter(F.col("part") == part).withColumn("place", place)
    last = own.filter(F.col("place") == n - before).first()["at"]
    kinds = [df.schema[c].dataType for c in order]
    end = F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(last, kinds, order)])
    upto = ranges.filter(F.col("at") < end).count()
    return df.filter(at < end).union(df.filter(at == end).limit(n - upto)).orderBy(*order)
