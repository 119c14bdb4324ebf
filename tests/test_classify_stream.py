import math

import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks import fixtures as fx
from mailsift.operators import assemble, classify, clean
from mailsift.sources.scratch import land, scratch_path
from mailsift.streaming import gate
from mailsift.streaming.gate import decide, gate_stream


def test_classifier_learns_and_answers(spark):
    """Mails whose class shows in their words are told apart on unseen rows."""
    word = F.when(F.col("label") == 1, "verify password").otherwise("meeting agenda")
    mails = spark.range(400).select(
        F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label")
    ).withColumn("subject", F.concat(F.lit("note "), (F.col("key") % 7).cast("string"))).withColumn(
        "body", F.concat(word, F.lit(" item "), (F.col("key") % 13).cast("string")))
    split = land(assemble.stratified_split(mails))
    model = classify.fit_classifier(split.filter("split = 'train'"), features=1 << 12)
    scored = classify.score(split.filter("split = 'test'"), model)
    rows = scored.collect()
    assert len(rows) == 40 and {r.raw_prediction for r in rows} <= {"phishing", "legitimate", "unsure"}
    right = sum(r.raw_prediction == ("phishing" if r.label else "legitimate") for r in rows)
    assert right >= 36
    assert set(scored.columns) == {*split.columns, "p_phishing", "raw_prediction"}


def test_batch_query_covers_every_row(spark, sf):
    rows = catalog.QUERIES["classify_batch"](spark, sf).collect()
    n = fx.labelled_mail(spark, sf).count()
    assert [tuple(r) for r in rows] == [(n, n, n, True)]


def test_fit_best_keeps_lowest_loss(spark):
    mails = spark.range(120).select(
        F.lit("s").alias("subject"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 1, "bad").otherwise("good").alias("body"))
    grid = [{"regularisation": 100.0, "features": 64}, {"regularisation": 0.01, "features": 64}]
    model, losses = classify.fit_best(mails, mails, grid)
    table = {r.epoch: r.loss for r in losses.collect()}
    assert table[1] < table[0]
    assert model.stages[-1].getRegParam() == 0.01


def test_answer_margin(spark):
    df = spark.createDataFrame([(0.9,), (0.52,), (0.5,), (0.1,), (None,)], "p double")
    words = [r[0] for r in df.select(classify.answer_of(F.col("p"), 0.05)).collect()]
    assert words == ["phishing", "unsure", "unsure", "legitimate", "unsure"]
    assert df.select(classify.answer_of(F.col("p"))).collect()[2][0] == "phishing"


def test_outside_model_is_loaded_once_and_asked_in_batches(spark):
    def load():
        calls = []

        def model(prompts):
            calls.append(len(prompts))
            return ["phishing" if "verify" in p else f"legitimate {len(calls)}" for p in prompts]

        return model

    df = spark.createDataFrame([("please verify",), ("lunch",)] * 50, "prompt string").coalesce(1)
    answers = df.select(classify.model_answers(load)(F.col("prompt"))).collect()
    assert [a[0] for a in answers] == ["phishing", "legitimate 1"] * 50


def test_log_loss(spark):
    rows = [(i, 0.1 * (i + 1), i % 2) for i in range(9)]
    df = spark.createDataFrame(rows, "index long, p_phishing double, label int")
    losses = [-math.log(p if y else 1 - p) for _, p, y in rows]
    assert classify.log_loss(df).first().loss == pytest.approx(sum(losses) / 9)
    batches = [losses[0:4], losses[4:8], losses[8:]]
    means = [sum(b) / len(b) for b in batches]
    batched = classify.log_loss(df, index="index", batch_size=4)
    assert batched.first().loss == pytest.approx(sum(means) / 3)
    capped = classify.log_loss(df, index="index", batch_size=4, max_batches=2)
    assert capped.first().loss == pytest.approx(sum(means[:2]) / 2)
    assert classify.log_loss(df.limit(0)).first().loss == 0.0
    certain = spark.createDataFrame([(0.0, 1)], "p_phishing double, label int")
    assert math.isfinite(classify.log_loss(certain).first().loss)


def test_first_of_equal_losses_wins(spark):
    df = spark.createDataFrame([(3, 0.5), (2, 0.5), (1, 0.7)], "epoch int, loss double")
    assert tuple(classify.best_candidate(df).first()) == (2, 0.5)


def test_stream_equals_batch(spark, sf):
    path = scratch_path(spark, "arriving")
    fx.pred(spark, sf).select("key", "subject", "body", "raw_prediction").repartition(5).write.parquet(path)
    mails = spark.read.parquet(path)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")

    def run():
        stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 2).parquet(path)
        gate_stream(stream, lambda df: df, out, state, 0.55, available_now=True).awaitTermination()

    run()
    batch = decide(mails, lambda df: df, 0.55)
    streamed = spark.read.parquet(out)
    n = mails.count()
    assert streamed.count() == n > 0
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0
    mails.limit(3).withColumn("key", F.col("key") + 10**6).write.mode("append").parquet(path)
    run()  # resumed from its checkpoint: only what arrived since is decided on
    assert spark.read.parquet(out).count() == n + 3
    assert spark.read.parquet(out).filter("key >= 1000000").count() == 3


def test_stream_with_a_trained_model(spark):
    mails = spark.range(60).select(
        F.lit("s").alias("subject"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 1, "bad link").otherwise("good day").alias("body"))
    model = classify.fit_classifier(mails, features=64)
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    mails.write.parquet(path)
    stream = spark.readStream.schema(mails.schema).parquet(path)
    score = lambda df: classify.score(df, model)
    gate_stream(stream, score, out, state, available_now=True).awaitTermination()
    actions = {(r.label, r.action) for r in spark.read.parquet(out).collect()}
    assert actions == {(1, "BLOCK"), (0, "PASS")}


def test_stream_cleans_as_training_does(spark):
    """An HTML mail gets the same probability from the stream as from a batch."""
    raw = spark.range(60).select(
        F.col("id").alias("key"), F.lit("s").alias("subject"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 1, "<p>bad <b>link</b></p><template>good day</template>")
        .otherwise("<div class='bad link'>good&nbsp;day</div>").alias("body"))
    cleaned = clean.clean_text(raw, clean.HTML_MAIL)
    model = classify.fit_classifier(cleaned, features=64)
    batch = {r.key: r.p_phishing for r in classify.probability(cleaned, model).collect()}
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    score = lambda df: classify.score(df, model)
    gate_stream(stream, score, out, state, available_now=True, profile=clean.HTML_MAIL).awaitTermination()
    assert {r.key: r.p_phishing for r in spark.read.parquet(out).collect()} == batch


def _arrivals(spark, seconds, path, first_key=0):
    """A file of mails, one for each arrival, two mails a text."""
    rows = [(first_key + i, "subject", f"a body of some length, {(first_key + i) // 2}", t) for i, t in enumerate(seconds)]
    df = spark.createDataFrame(rows, "key long, subject string, body string, t long")
    df.select("key", "subject", "body", F.timestamp_seconds("t").alias("arrived")).coalesce(1).write.mode("append").parquet(path)


def _decide_all(spark, path, out, state, keep_for):
    schema = "key long, subject string, body string, arrived timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    score = lambda df: df.withColumn("raw_prediction", F.lit("legitimate"))
    running = gate.gate_stream_once(stream, score, out, state, "arrived", keep_for, available_now=True)
    running.awaitTermination()
    return running


def test_copies_get_one_decision_across_a_restart(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    _arrivals(spark, range(0, 20), path)
    _decide_all(spark, path, out, state, "1 hour")
    decided = {r.body: r.key for r in spark.read.parquet(out).collect()}
    assert len(decided) == spark.read.parquet(out).count() == 10
    _arrivals(spark, range(20, 60), path)  # the same texts and as many new ones
    _arrivals(spark, range(60, 70), path, first_key=100)
    _decide_all(spark, path, out, state, "1 hour")
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({r.body for r in rows}) == 25
    assert all(r.key == decided[r.body] for r in rows if r.body in decided)  # the first that arrived stays


def test_state_of_old_copies_is_let_go(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    sizes = []
    for day in range(6):
        _arrivals(spark, range(day * 86400, day * 86400 + 40), path, first_key=1000 * day)
        running = _decide_all(spark, path, out, state, "1 hour")
        sizes.append(max(p.stateOperators[0].numRowsTotal for p in running.recentProgress if p.stateOperators))
    assert spark.read.parquet(out).count() == 120 and max(sizes) <= 40


def test_funnel_of_a_stream(spark):
    path, out, counts = (scratch_path(spark, n) for n in ("in", "out", "counts"))
    states = [scratch_path(spark, "state") for _ in range(2)]
    schema = "key long, subject string, body string, arrived timestamp"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        gate.funnel_stream(stream, counts, states[0], "arrived", "1 hour", available_now=True).awaitTermination()
        _decide_all(spark, path, out, states[1], "7 days")
        return tuple(gate.stream_funnel(spark, counts, out).first())

    _arrivals(spark, range(20), path)
    assert run() == (20, 0, 0, 0, 10, 10)
    bad = [(500, "", "x", 30), (501, "s", " ", 30), (502, "s", "x", 31)]
    df = spark.createDataFrame(bad, "key long, subject string, body string, t long")
    df.select("key", "subject", "body", F.timestamp_seconds("t").alias("arrived")).write.mode("append").parquet(path)
    _arrivals(spark, range(3590, 3610), path, first_key=10)  # over the border of two spans
    assert run() == (43, 1, 1, 1, 25, 15)


def test_a_larger_stream_has_more_files(spark, sf, monkeypatch):
    """No task deals a fixed share of all mails; the mails are the same."""
    few, many = [], []
    for size, out in ((64 << 20, few), (20_000, many)):
        monkeypatch.setattr(catalog, "FILE_BYTES", size)
        out += [spark.read.parquet(catalog._arriving(spark, sf)[1])]
    files = [df[0].select(F.input_file_name()).distinct().count() for df in (few, many)]
    assert files[0] <= 6 and files[1] > 12
    assert few[0].exceptAll(many[0]).isEmpty() and many[0].exceptAll(few[0]).isEmpty()
