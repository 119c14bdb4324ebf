import random
from collections import Counter
from fractions import Fraction
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from mailsift.operators import assemble
from mailsift.operators.ordering import rank_cutoffs, with_neighbours


def hashed(seed, key):
    return md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """1,000 rows, one class in four."""
    return spark.range(1000).select(
        F.col("id").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit(1).alias("dataset")
    ).cache()


def keys(df):
    return sorted(r.key for r in df.select("key").collect())


def quotas_of(spark, totals):
    table = spark.createDataFrame(list(totals.items()), "g int, n long")
    rows = assemble.split_quotas(table, Fraction("0.2"), Fraction("0.5")).collect()
    return {r.g: (r.train, r.valid) for r in rows}


def test_published_sizes(spark):
    assert quotas_of(spark, {0: 6288, 1: 6288}) == {0: (5030, 629), 1: (5030, 629)}
    assert assemble.split_sizes_for(12576, Fraction("0.2"), Fraction("0.5")) == {
        "train": 10060, "valid": 1258, "test": 1258}


@pytest.mark.parametrize("seed", range(8))
def test_quotas_are_exact_and_fit(spark, seed):
    rnd = random.Random(seed)
    totals = {c: rnd.randint(1, 500) for c in rnd.sample([None, *range(8)], rnd.randint(1, 9))}
    quotas = quotas_of(spark, totals)
    n = sum(totals.values())
    held = -(-n // 5)
    assert quotas.keys() == totals.keys()
    assert sum(t for t, _ in quotas.values()) == n - held
    assert sum(v for _, v in quotas.values()) == held - -(-held // 2)
    assert all(0 <= t and 0 <= v and t + v <= totals[c] for c, (t, v) in quotas.items())


def test_twenty_thousand_classes(spark):
    df = spark.range(60_000).selectExpr("id AS key", "id % 20000 AS label", "1 AS dataset", "'x' AS n")
    split = assemble.stratified_split(df)
    assert {r.split: r.n for r in assemble.split_sizes(split).collect()} == {"train": 48_000, "valid": 6_000, "test": 6_000}
    assert split.columns == ["key", "label", "dataset", "n", "split"]
    assert assemble.balance(df, keep=3, draw=7).count() == 6


def test_balance_draws_the_seeded_first(rows):
    balanced = assemble.balance(rows, seed=7)
    expected = sorted((k for k in range(1000) if k % 4), key=lambda k: hashed(7, k))[:250]
    assert keys(balanced.filter("label = 0")) == sorted(expected)
    assert keys(balanced.filter("label = 1")) == list(range(0, 1000, 4))


def test_balance_does_not_depend_on_partitioning(rows):
    assert keys(assemble.balance(rows.repartition(13))) == keys(assemble.balance(rows.coalesce(1)))


def test_balance_only_filters_the_mails(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    plan = assemble.balance(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Join" not in plan.toString()


def test_balance_needs_enough_rows(rows):
    with pytest.raises(ValueError, match="cannot draw"):
        assemble.balance(rows, keep=0, draw=1)


def test_repeated_keys_are_refused(spark):
    df = spark.range(100).select(F.lit(1).alias("key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    with pytest.raises(ValueError, match="not unique"):
        assemble.balance(df)


def test_split_is_exact_complete_and_stratified(rows):
    split = assemble.stratified_split(rows)
    got = [(r.key, r.label, r.split) for r in split.collect()]
    assert sorted(k for k, _, _ in got) == list(range(1000))
    assert Counter((part, label) for _, label, part in got) == {
        ("train", 0): 600, ("train", 1): 200, ("valid", 0): 75, ("valid", 1): 25, ("test", 0): 75, ("test", 1): 25}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_split_of_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"))
    parts = Counter(r.split for r in assemble.stratified_split(df).collect())
    assert parts == Counter({k: v for k, v in assemble.split_sizes_for(n, Fraction("0.2"), Fraction("0.5")).items() if v})


def test_split_keeps_rows_without_class(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 2) for i in range(50)], "key long, label int")
    split = assemble.stratified_split(df)
    assert split.count() == 50 and split.filter("split is null").count() == 0


def test_index_follows_the_shuffle(rows):
    indexed = assemble.with_index(rows, seed=3)
    expected = sorted(range(1000), key=lambda k: hashed(3, k))
    assert [r.key for r in sorted(indexed.collect(), key=lambda r: r["index"])] == expected
    assert sorted(r["index"] for r in indexed.select("index").collect()) == list(range(1000))
    assert [r.key for r in assemble.shuffle(rows, seed=3).collect()] == expected


def test_samples(rows):
    expected = sorted(sorted(range(1000), key=lambda k: hashed(42, k))[:64])
    assert keys(assemble.sample_at_most(rows, 64)) == expected
    assert assemble.sample_at_most(rows, 1000) is rows and assemble.sample_at_most(rows, None) is rows
    assert assemble.sample_at_most(rows, 0).count() == 0


def test_head(rows):
    assert keys(assemble.head_n(rows, 5)) == [0, 1, 2, 3, 4]
    assert keys(assemble.head_n(rows, 700)) == list(range(700)) and assemble.head_n(rows, 2000).count() == 1000
    tied = assemble.head_n(rows, 600, "label")
    assert tied.count() == 600 and tied.filter("label = 0").count() == 600
    assert assemble.head_n(rows, 800, "label").filter("label = 0").count() == 750
    assert assemble.head_n(rows, 0) is rows and assemble.head_n(rows, None) is rows


def test_cutoffs_at_every_rank(spark):
    df = spark.range(40).select(F.col("id").alias("key"), F.lit("x").alias("label"))
    cutoffs = rank_cutoffs(df, {"x": list(range(1, 41))}, "label", "key", 42)
    order = sorted(range(40), key=lambda k: hashed(42, k))
    assert [cutoffs[("x", r)][1] for r in range(1, 41)] == order


def test_counts(rows):
    split = assemble.stratified_split(rows)
    counted = {(r.split, r.label): r.n for r in assemble.class_counts(split).collect()}
    assert counted[("all", 1)] == 250 and counted[("train", 0)] == 600 and len(counted) == 8
    assert {r.split: r.n for r in assemble.split_sizes(split).collect()} == {"train": 800, "valid": 100, "test": 100}
    assert {(r.dataset, r.label): r.n for r in assemble.source_label_counts(rows).collect()} == {(1, 0): 750, (1, 1): 250}


def test_union_keeps_equal_rows(rows):
    assert assemble.union_sources(rows, rows.select("dataset", "label", "key"), rows).count() == 3000


@pytest.mark.parametrize("chunk", [1, 2, 5, 4096])
def test_neighbours_across_chunks(spark, chunk):
    """Gaps, a long group, null values and groups that start anywhere."""
    turns = {"a": [0, 1, 2, 3, 9, 10, 11, 40], "b": [7], "c": list(range(100, 130)), None: [1, 2]}
    data = [(g, t, None if t % 5 == 0 else f"{g}{t}") for g, ts in turns.items() for t in ts]
    df = spark.createDataFrame(data, "g string, t long, v string")
    got = {(r.g, r.t): r for r in with_neighbours(df, "g", "t", "v", chunk).collect()}
    assert len(got) == len(data)
    for g, ts in turns.items():
        values = {t: None if t % 5 == 0 else f"{g}{t}" for t in ts}
        for i, t in enumerate(ts):
            r = got[(g, t)]
            assert r.previous == (values[ts[i - 1]] if i else None)
            assert r.next == (values[ts[i + 1]] if i + 1 < len(ts) else None)
            assert (r.is_first, r.is_last) == (i == 0, i == len(ts) - 1)
