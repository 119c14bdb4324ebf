"""A scoring run that is stopped and goes on."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from mailsift.plans import prediction

SCHEMA = "index long, label int, dataset int, subject string, body string"


def mails(spark, n=90):
    rows = [(i, i % 2, i % 3, f"subject {i}", "word " * (i * 7 % 40)) for i in range(n)]
    rows += [(None, 1, 1, None, None), (5, 1, 2, "subject 5", ""), (5, 1, 2, "subject 5", "")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("x")).withColumn("place", F.lit("y"))


def model(log, broken=None):
    """A model that writes down what it is asked; raises at a prompt with ``broken``."""

    def load():
        import uuid

        def answer(prompts):
            if broken and any(broken in p for p in prompts):
                raise RuntimeError("stopped")
            (log / uuid.uuid4().hex).write_text(json.dumps(prompts))
            return ["phishing" if len(p) % 2 else "legitimate" for p in prompts]

        return answer

    return load


def asked(log):
    return collections.Counter(p for f in log.iterdir() for p in json.loads(f.read_text()))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_a_stopped_run_asks_nothing_twice(spark, tmp_path, log):
    root, rows = str(tmp_path / "run"), mails(spark)
    shards = prediction.start_run(rows, root, shard_mails=10)
    assert shards == 10
    # The 41st mail is in some shard in the middle; that job fails before it asks anything.
    with pytest.raises(Exception, match="stopped"):
        prediction.resume_run(spark, root, model(log, "subject 41"), at_once=1)
    first = asked(log)
    assert 0 < sum(first.values()) < 93
    with pytest.raises(ValueError, match="not answered"):
        prediction.finish_run(spark, root)
    assert prediction.start_run(rows, root, shard_mails=10) == shards
    left = prediction.resume_run(spark, root, model(log), at_once=3, most_jobs=1)
    assert left > 0 and prediction.resume_run(spark, root, model(log)) == 0
    every = asked(log)
    wanted = collections.Counter(r.prompt for r in prediction.with_prompts(rows).collect())
    assert every == wanted and sum(every.values()) == 93
    assert prediction.resume_run(spark, root, model(log)) == 0 and asked(log) == every

    ours = prediction.finish_run(spark, root, str(tmp_path / "reports"))["predictions"]
    other = prediction.predict_run(rows, model(log))["predictions"]
    assert sorted(ours.collect(), key=str) == sorted(other.collect(), key=str)
    assert spark.read.parquet(str(tmp_path / "reports" / "overall")).first().total == 93


def test_a_shard_that_is_half_answered(spark, tmp_path, log):
    """Files of a job that died while it put them in place count row by row."""
    root, rows = str(tmp_path / "run"), mails(spark)
    prediction.start_run(rows, root, shard_mails=30)
    some = prediction._prompts(spark, root).filter("index % 3 = 0")
    some.select("shard", "place", F.lit("phishing").alias("raw_prediction")).write.partitionBy("shard").parquet(f"{root}/answers")
    answered = collections.Counter(r.prompt for r in some.collect())
    assert prediction.resume_run(spark, root, model(log)) == 0
    wanted = collections.Counter(r.prompt for r in prediction.with_prompts(rows).collect())
    assert asked(log) + answered == wanted
    assert prediction.finish_run(spark, root)["predictions"].count() == 93


def test_shards_hold_like_lengths(spark, tmp_path):
    root = str(tmp_path / "run")
    prediction.start_run(mails(spark), root, shard_mails=10)
    bounds = (
        prediction._prompts(spark, root)
        .groupBy("shard")
        .agg(F.min(F.length("prompt")).alias("least"), F.max(F.length("prompt")).alias("most"), F.count("*").alias("n"))
        .orderBy("shard")
        .collect()
    )
    assert len(bounds) > 5 and all(a.most <= b.least for a, b in zip(bounds, bounds[1:]))
    assert sum(r.n for r in bounds) == 93


def test_one_length_fills_many_shards(spark, tmp_path):
    root = str(tmp_path / "run")
    same = spark.range(1000).select(
        F.col("id").alias("index"), F.lit(1).alias("label"), F.lit(1).alias("dataset"),
        F.lpad(F.col("id").cast("string"), 4, "0").alias("subject"), F.lit("b").alias("body"))
    prediction.start_run(same, root, shard_mails=50)
    sizes = [r["count"] for r in prediction._prompts(spark, root).groupBy("shard").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 200 and sum(sizes) == 1000


def test_other_mails_are_refused(spark, tmp_path):
    root = str(tmp_path / "run")
    prediction.start_run(mails(spark), root)
    with pytest.raises(ValueError, match="other mails"):
        prediction.start_run(mails(spark, 89), root)
    with pytest.raises(ValueError, match="no run"):
        prediction.resume_run(spark, str(tmp_path / "none"), model(tmp_path))


def test_no_mails(spark, tmp_path, log):
    root = str(tmp_path / "run")
    assert prediction.start_run(mails(spark, 0).limit(0), root) == 1
    assert prediction.resume_run(spark, root, model(log)) == 0
    assert prediction.finish_run(spark, root)["predictions"].count() == 0


def test_finished_shards_are_not_read(spark, tmp_path, log):
    root = str(tmp_path / "run")
    prediction.start_run(mails(spark), root, shard_mails=10)
    prediction.resume_run(spark, root, model(log), at_once=5, most_jobs=1)
    left = [r.shard for r in prediction._open(spark, root)]
    plan = prediction._prompts(spark, root).filter(F.col("shard").isin(left))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan.replace("isnotnull(shard#", "shard#")


def test_a_job_looks_into_its_own_shards_only(spark, tmp_path, log, monkeypatch):
    root, looked, opened = str(tmp_path / "run"), [], prediction._open
    prediction.start_run(mails(spark), root, shard_mails=10)
    some = prediction._prompts(spark, root).filter("index % 3 = 0")
    some.select("shard", "place", F.lit("phishing").alias("raw_prediction")).write.partitionBy("shard").parquet(f"{root}/answers")

    def then(*args):
        found = opened(*args)
        looked.clear()
        return found

    reader = type(spark.read)
    read = reader.parquet
    monkeypatch.setattr(prediction, "_open", then)
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **o: (looked.append(paths), read(self, *paths, **o))[1])
    prediction.resume_run(spark, root, model(log), at_once=2)
    assert len(looked) >= 5 and all(len(paths) <= 2 and all("/shard=" in p for p in paths) for paths in looked)
    assert prediction.finish_run(spark, root)["predictions"].count() == 93
