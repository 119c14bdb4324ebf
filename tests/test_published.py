"""Tables that readers see as a whole."""

import pytest
from pyspark.sql import functions as F

from mailsift.sources import files, published
from mailsift.sources.scratch import scratch_path


@pytest.fixture
def splits(spark):
    split = F.when(F.col("id") < 6, "train").when(F.col("id") < 8, "valid").otherwise("test")
    return spark.range(10).select(F.col("id").alias("key"), split.alias("split"), F.lit(1).alias("version"))


def keys(df):
    return sorted(r.key for r in df.collect())


def test_readers_see_one_version(spark, splits):
    path = scratch_path(spark, "published")
    assert published.publish(splits, path) == 1
    before = published.read_published(spark, path)
    assert published.publish(splits.filter("key > 0").withColumn("version", F.lit(2)), path) == 2
    assert keys(before) == list(range(10)) and {r.version for r in before.collect()} == {1}
    now = published.read_published(spark, path)
    assert keys(now) == list(range(1, 10)) and {r.version for r in now.collect()} == {2}
    assert keys(published.read_published(spark, path, version=1, split="test")) == [8, 9]
    assert published.manifest(spark, path)["rows"] == 9 and published.manifest(spark, path, 1)["rows"] == 10


def test_a_split_is_one_folder(spark, splits):
    path = scratch_path(spark, "published")
    published.publish(splits, path)
    df = published.read_published(spark, path, split="test")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= test" in plan
    folders = {r.f.split("split=")[1].split("/")[0] for r in df.select(F.input_file_name().alias("f")).collect()}
    assert folders == {"test"} and keys(df) == [8, 9]


def test_a_failed_writer_leaves_the_version_before(spark, splits):
    path = scratch_path(spark, "published")
    published.publish(splits, path)
    broken = splits.withColumn("key", F.when(F.col("key") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("key")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, path)
    assert keys(published.read_published(spark, path)) == list(range(10))
    assert published.publish(splits, path) == 2


def test_a_manifest_cut_short_is_passed_over(spark, splits):
    path = scratch_path(spark, "published")
    published.publish(splits, path)
    assert files.create_small(spark, f"{path}/_versions/0000000002.json", "")
    assert not files.create_small(spark, f"{path}/_versions/0000000002.json", "{}")
    assert published.manifest(spark, path)["version"] == 1
    assert published.publish(splits, path) == 3


def test_two_writers_get_two_numbers(spark, splits, monkeypatch):
    path = scratch_path(spark, "published")
    published.publish(splits, path)
    monkeypatch.setattr(published, "_numbers", lambda *a: [])  # listed before the other was done
    assert published.publish(splits, path) == 2


def test_empty_and_missing(spark, splits):
    path = scratch_path(spark, "published")
    with pytest.raises(ValueError, match="nothing is published"):
        published.read_published(spark, path)
    published.publish(splits.limit(0), path, by=["split", "version"])
    df = published.read_published(spark, path)
    assert df.count() == 0 and set(df.columns) == set(splits.columns)
    published.publish(splits.withColumn("split", F.lit(None).cast("string")), path)
    assert published.read_published(spark, path).filter("split IS NULL").count() == 10
