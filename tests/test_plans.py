"""Whole jobs on small files, and the shape of the plans that carry the data."""

import mailbox
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks import fixtures as fx
from mailsift.operators import assemble, clean, evaluate
from mailsift.plans import corpus, training
from mailsift.plans.evaluation import evaluate_run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def files(tmp_path):
    raw = tmp_path / "raw.csv"
    bodies = [f"Report number {i} is attached here." for i in range(40)]
    records = [f"From: a@b\nSubject: {'Re: ' * (i % 3)}Report {i % 30}\n\n{bodies[i % 30]}" for i in range(40)]
    records += ["From: a@b\nSubject: Re:\n\nno subject left, so this one goes", "From: a\nSubject: x\n\n \n"]
    raw.write_text("file,message\n" + "".join(f'{i},"{r}"\n' for i, r in enumerate(records)))
    box = mailbox.mbox(tmp_path / "box.mbox")
    for i in range(12):
        message = EmailMessage()
        message["Subject"] = f"Account {i % 10}"
        message.set_content(f"<p>Please <b>verify</b> account {i % 10} &amp; reply</p>", cte="base64")
        box.add(message)
    box.flush()
    for name in ("clean", "poisoned"):
        lines = "".join(f'"Wire {i}","Send the wire number {i} today"\n' for i in range(6))
        (tmp_path / f"{name}.csv").write_text("subject,body\n" + lines + '"",lost\n')
    return tmp_path


def test_corpora_to_splits(spark, files):
    legit, legit_report = corpus.clean_source(
        corpus.raw_message_source(spark, str(files / "raw.csv")), clean.RAW_MESSAGE)
    box, box_report = corpus.clean_source(
        corpus.mbox_source(spark, str(files / "box.mbox"), excluded=[3]), clean.HTML_MAIL)
    tags = {str(files / "clean.csv"): (1, 3), str(files / "poisoned.csv"): (1, 4)}
    bec, bec_report = corpus.clean_source(corpus.tagged_source(spark, tags), clean.GENERATED)
    assert tuple(legit_report.first()) == (42, 42, 1, 1, 0, 10, 30)
    assert tuple(box_report.first()) == (11, 11, 0, 0, 0, 2, 9)
    assert tuple(bec_report.first()) == (14, 14, 2, 0, 0, 6, 6)
    assert box.filter("body = 'Please verify account 4 & reply'").count() == 1
    assert {r.dataset for r in bec.select("dataset").collect()} == {3}

    data = corpus.build_dataset(legit, box, bec)
    rows = data.collect()
    assert len(rows) == 30 and {r.label for r in rows} == {0, 1}
    assert sorted(r["index"] for r in rows) == list(range(30))
    assert {r.split: r.n for r in assemble.split_sizes(data).collect()} == {"train": 24, "valid": 3, "test": 3}
    again = {(r.key, r.split, r["index"]) for r in corpus.build_dataset(bec, legit.repartition(7), box).collect()}
    assert again == {(r.key, r.split, r["index"]) for r in rows}


def test_evaluate_run_writes_reports(spark, sf, tmp_path):
    tables = evaluate_run(fx.pred(spark, sf).withColumnRenamed("key", "index"), str(tmp_path / "run"))
    assert set(tables) == {"predictions", "report", "overall", "by_dataset", "targets"}
    stored = spark.read.parquet(str(tmp_path / "run" / "overall")).first()
    assert stored.total == tables["predictions"].count()
    assert spark.read.parquet(str(tmp_path / "run" / "targets")).count() == len(evaluate.TARGET_BANDS)


def test_training_picks_a_model_on_valid(spark):
    mails = spark.range(100).select(
        F.col("id").alias("key"), F.lit("s").alias("subject"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 1, "bad").otherwise("good").alias("body"))
    grid = [{"regularisation": 50.0, "features": 64}, {"regularisation": 0.01, "features": 64}]
    splits = assemble.stratified_split(mails)
    model, losses = training.train_classifier(splits, grid)
    assert model.stages[-1].getRegParam() == 0.01 and losses.count() == 2
    rows = training.training_rows(mails, cap=10).collect()
    assert len(rows) == 10 and all(r.full.startswith(r.prompt) for r in rows)
    with pytest.raises(ValueError, match="split"):
        training.train_classifier(mails)


LAZY = [n for n in catalog.QUERIES if n not in ("classify_batch", "gate_stream")]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_needed(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "key")
    plan = plan_of(assemble.with_index(docs.select("key")))
    assert "text" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    counts = plan_of(assemble.source_label_counts(fx.mail(spark, sf)))
    assert "text" not in counts


def test_quality_shuffles_only_counts(spark, sf):
    plan = plan_of(evaluate.quality(catalog.answered(spark, sf), ["dataset"]))
    last = plan[: plan.index("hashpartitioning(dataset")]
    assert "HashAggregate" in last
    wide = plan[plan.index("hashpartitioning(dataset"):].split("\n")[1]
    assert "partial_count" in wide


def test_conversations_are_shuffled_once(spark, sf):
    from mailsift.operators.prompts import render_turns

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(render_turns(fx.table(spark, sf, "conversations")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [l for l in plan.split("\n") if "Exchange hashpartitioning(__missing" in l and "__chunk" in l]
    assert plan.count("Exchange") == 4 and len(wide) == 3
