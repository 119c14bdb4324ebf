"""A corpus that grows by batches, against cleaning all at once."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators import clean, growing
from mailsift.plans import corpus
from mailsift.sources.scratch import land, scratch_path

SCHEMA = "key long, subject string, body string, label int, dataset int"


@pytest.fixture
def marked(spark):
    """Six mails of four texts over three batches, and two that no filter lets pass."""
    texts = [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, "d"), (6, ""), (7, None)]
    rows = [(k, f"Subject {t}", f"a body long enough, of {t}" if t else t, 0, 1) for k, t in texts]
    rows += [(10 + k, "Subject hot", "a body that a third of all mails share", 0, 1) for k in range(30)]
    return land(clean.mark(spark.createDataFrame(rows, SCHEMA)), "marked")


def in_batches(spark, marked, root, deal, batches=3):
    for batch in range(batches):
        growing.admit(marked.filter(deal == batch), root, batch, ["key"], buckets=4)
    return {r.key: r.batch for r in growing.admitted(spark, root).collect()}


def at_once(marked, deal):
    """The first key of each text by batch and key, worked out on the driver."""
    first = {}
    for r in sorted(marked.filter("__step IS NULL").withColumn("b", deal).collect(), key=lambda r: (r.b, r.key)):
        first.setdefault((r.subject, r.body), (r.key, r.b))
    return dict(first.values())


@pytest.mark.parametrize("deal", ["key % 3", "2 - key % 3", "key div 14"])
def test_batches_equal_one_cleaning(spark, marked, deal):
    got = in_batches(spark, marked, scratch_path(spark, "corpus"), F.expr(deal))
    assert got == at_once(marked, F.expr(deal)) and len(got) == 5


def test_a_batch_admitted_again_changes_nothing(spark, marked):
    root, deal = scratch_path(spark, "corpus"), F.col("key") % 3
    once = in_batches(spark, marked, root, deal)
    digests = growing.open_index(spark, root)[0].count()
    for batch in (1, 0, 2):
        growing.admit(marked.filter(deal == batch), root, batch, ["key"])
    assert {r.key: r.batch for r in growing.admitted(spark, root).collect()} == once
    assert growing.open_index(spark, root)[0].count() == digests == len(once)


def test_a_batch_that_failed_before_its_digests_were_kept(spark, marked, monkeypatch):
    root, deal = scratch_path(spark, "corpus"), F.col("key") % 3
    growing.admit(marked.filter(deal == 0), root, 0, ["key"], buckets=4)
    real = growing.rows_at

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(growing, "rows_at", fail)
    with pytest.raises(RuntimeError, match="lost"):
        growing.admit(marked.filter(deal == 1), root, 1, ["key"])
    monkeypatch.setattr(growing, "rows_at", real)
    for batch in (1, 2):
        growing.admit(marked.filter(deal == batch), root, batch, ["key"])
    assert {r.key: r.batch for r in growing.admitted(spark, root).collect()} == at_once(marked, deal)


def test_the_index_outlives_its_session(spark, marked):
    root, deal = scratch_path(spark, "corpus"), F.col("key") % 3
    growing.admit(marked.filter(deal == 0), root, 0, ["key"], buckets=4)
    _, name, buckets = growing.open_index(spark, root)
    spark.sql(f"DROP TABLE {name}")  # what a new session knows: only the files
    again, _, found = growing.open_index(spark, root)
    assert found == buckets == 4 and again.count() == 3
    with pytest.raises(ValueError, match="4 buckets"):
        growing.open_index(spark, root, 8)
    assert in_batches(spark, marked, root, deal) == at_once(marked, deal)


def test_the_index_is_not_shuffled(spark, marked):
    root = scratch_path(spark, "corpus")
    growing.admit(marked, root, 0, ["key"], buckets=4)
    index, _, buckets = growing.open_index(spark, root)
    first = land(marked.select("__digest", F.struct("key").alias("__first")), "first")
    plan = growing.unknown(first, index, 1, buckets)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin"):]
    assert below.count("Exchange") == 1 and "Exchange hashpartitioning(__digest" in below
    assert "SelectedBucketsCount: 4 out of 4" in below
    assert "Broadcast" not in plan


def test_empty_batches(spark, marked):
    root = scratch_path(spark, "corpus")
    empty = growing.admit(marked.limit(0), root, 0, ["key"], buckets=4)
    assert empty.count() == 0 and empty.columns == ["key", *clean.CONTRACT]
    growing.admit(marked, root, 1, ["key"])
    assert growing.admitted(spark, root).count() == 5


def test_plan_of_a_batch(spark, tmp_path):
    root = scratch_path(spark, "corpus")
    rows = [(i, f"s{i % 4}", f"a body of some length {i % 4}", 0, 1) for i in range(8)]
    first, funnel = corpus.grow_source(spark.createDataFrame(rows, SCHEMA), clean.GENERATED, root, 1, ["key"])
    assert first.count() == 4 and funnel.first().duplicate == 4
    later, _ = corpus.grow_source(
        spark.createDataFrame([*rows, (9, "new", "a body of some length", 0, 1)], SCHEMA), clean.GENERATED, root, 2, ["key"])
    assert [r.key for r in later.collect()] == [9]
