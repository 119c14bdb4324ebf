import itertools

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from mailsift.operators import clean
from mailsift.operators.dedup import dedup_exact


def mails(spark, rows):
    schema = "key long, subject string, body string, label int, dataset int"
    return spark.createDataFrame(rows, schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_length_limits(spark):
    rows = [(1, "s" * 9, "b" * 10, 1, 1), (2, "s" * 10, "b" * 10, 1, 1), (3, "s", "😀" * 19, 1, 1),
            (4, "s" * 30, "b" * 19, 1, 1), (5, "s" * 30, "b" * 20, 1, 1), (6, "s", "b" * 18, 1, 1)]
    kept = lambda profile: sorted(r.key for r in clean.clean(mails(spark, rows), profile, ["key"]).collect())
    assert kept(clean.GENERATED) == [2, 3, 4, 5]
    assert kept(clean.HTML_MAIL) == [5]


def test_profiles_differ_in_prefix_and_markup(spark):
    rows = [(1, "Re: hello", "<p>some body text &amp; more</p>", 1, 1)]
    texts = {
        name: clean.clean(mails(spark, rows), profile, ["key"]).first()
        for name, profile in (("raw", clean.RAW_MESSAGE), ("html", clean.HTML_MAIL), ("made", clean.GENERATED))
    }
    assert texts["raw"].subject == "hello" and texts["raw"].body == "<p>some body text &amp; more</p>"
    assert texts["html"].subject == "Re: hello" and texts["html"].body == "some body text & more"
    assert texts["made"].subject == "Re: hello"


def test_dedup_keeps_first_by_order(spark):
    rows = [(9, "s", "b", 1, 3), (1, "s", "b", 1, 4), (5, "s", "c", 1, 4), (4, "s", "c", 1, 4),
            (7, "ab", "c", 1, 1), (8, "a", "bc", 1, 1)]
    kept = dedup_exact(mails(spark, rows)).collect()
    assert sorted((r.key, r.dataset) for r in kept) == [(4, 4), (7, 1), (8, 1), (9, 3)]


def test_dedup_twice_and_under_any_partitioning(spark, sf):
    source = clean.clean_text(fx.mail(spark, sf))
    expected = sorted(r.key for r in dedup_exact(source).select("key").collect())
    for n in (1, 3, 17):
        spread = dedup_exact(source.repartition(n, F.rand(n)))
        assert sorted(r.key for r in spread.select("key").collect()) == expected
    again = dedup_exact(dedup_exact(source))
    assert sorted(r.key for r in again.select("key").collect()) == expected


def test_copies_are_dropped_before_the_shuffle(spark):
    hot = spark.range(0, 30000, 1, 6).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 3 == 0, "hot subject").otherwise(F.col("id").cast("string")).alias("subject"),
        F.when(F.col("id") % 3 == 0, "hot body").otherwise("other").alias("body"),
    )
    kept = dedup_exact(hot, order=["key"])
    plan = plan_of(kept)
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert kept.count() == 20001
    assert kept.filter("subject = 'hot subject'").first().key == 0


def test_cleaning_is_evaluated_once(spark, sf):
    """No regular expression is repeated in the filters above it."""
    plan = plan_of(clean.clean(fx.mail(spark, sf), order=["key"]))
    assert plan.count("regexp_replace") == 2


STEPS = ("empty_subject", "empty_body", "short", "duplicate")


@pytest.mark.parametrize("profile", [clean.RAW_MESSAGE, clean.HTML_MAIL, clean.GENERATED])
def test_funnel_sums_and_matches_cleaning(spark, sf, profile):
    report = clean.funnel(fx.mail(spark, sf), profile).first()
    assert report.original == report.parsed == 200
    assert report.parsed - sum(report[s] for s in STEPS) == report.final
    assert report.final == clean.clean(fx.mail(spark, sf), profile, ["key"]).count()


def test_funnel_known_counts(spark):
    report = clean.funnel(fx.mail(spark, "/root/testdata/sf0.01")).first()
    assert tuple(report) == (1000, 1000, 0, 69, 0, 68, 863)


def test_funnel_counts_each_row_at_its_first_failure(spark):
    rows = [(1, " ", "", 1, 1), (2, "s", " ", 1, 1), (3, "s", "b", 1, 1), (4, "subject", "x" * 20, 1, 1),
            (5, "subject ", " " + "x" * 20, 1, 1), (6, None, "b", 1, 1), (7, "bad", "record", 1, 1)]
    report = clean.funnel(mails(spark, rows), parsed=F.col("key") != 7).first()
    assert tuple(report) == (7, 6, 2, 1, 1, 1, 1)


def test_funnel_of_nothing(spark):
    assert tuple(clean.funnel(mails(spark, [])).first()) == (0,) * 7


def test_published_funnels_add_up():
    """Counts published for three corpora follow the same arithmetic."""
    for original, *removed, final in (
        (517401, 33236, 0, 814, 255130, 228221), (2276, 20, 970, 0, 336, 950), (8422, 60, 60, 0, 2964, 5338)
    ):
        assert list(itertools.accumulate([original, *[-r for r in removed]]))[-1] == final
