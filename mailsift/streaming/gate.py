"""Screening mail as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from mailsift.operators.clean import GENERATED, Profile, clean_text, mark
from mailsift.operators.policy import gate
from mailsift.sources.files import child_names

Scorer = Callable[[DataFrame], DataFrame]


def decide(
    mails: DataFrame, score: Scorer, threshold: float = 0.5, profile: Profile = GENERATED
) -> DataFrame:
    """Clean, score and decide on mails; the same projection for a batch and a stream.

    ``score`` sees ``subject`` and ``body`` as training saw them, cleaned by ``profile``,
    and adds ``raw_prediction``. Nothing here keeps state, so a restarted stream
    continues from its checkpoint with nothing to rebuild.
    """
    return _decide(clean_text(mails, profile), score, threshold)


def _decide(cleaned: DataFrame, score: Scorer, threshold: float) -> DataFrame:
    return gate(score(cleaned.withColumn("email_text", F.col("body"))), threshold)


def decide_once(
    mails: DataFrame,
    score: Scorer,
    arrived: str,
    keep_for: str = "7 days",
    threshold: float = 0.5,
    profile: Profile = GENERATED,
) -> DataFrame:
    """Clean a stream, drop what the filters reject and what was seen before, and decide.

    A text passes once within ``keep_for`` of its first arrival by the timestamp column
    ``arrived``. State is a digest and a time for each such text, dealt by digest, and is
    let go of when the watermark has passed that time, so it is bounded by the texts of
    that span however long the stream runs. Mails that arrive later than ``keep_for``
    behind the newest are dropped as late. Of copies in one micro-batch any one is kept;
    their texts are equal.
    """
    valid = mark(mails, profile).filter("__step IS NULL").drop("__step")
    timed = valid.withWatermark(arrived, keep_for)
    return _decide(timed.dropDuplicatesWithinWatermark(["__digest"]).drop("__digest"), score, threshold)


def gate_stream(
    arriving: DataFrame,
    score: Scorer,
    path: str,
    checkpoint: str,
    threshold: float = 0.5,
    available_now: bool = False,
    profile: Profile = GENERATED,
) -> StreamingQuery:
    """Write a decision for every arriving mail to Parquet, each exactly once."""
    decided = decide(arriving, score, threshold, profile)
    return _start(_append(decided, path, checkpoint), available_now)


def gate_stream_once(
    arriving: DataFrame,
    score: Scorer,
    path: str,
    checkpoint: str,
    arrived: str,
    keep_for: str = "7 days",
    threshold: float = 0.5,
    available_now: bool = False,
    profile: Profile = GENERATED,
) -> StreamingQuery:
    """As ``gate_stream``, with the filters, and one decision for copies (``decide_once``)."""
    decided = decide_once(arriving, score, arrived, keep_for, threshold, profile)
    return _start(_append(decided, path, checkpoint), available_now)


def funnel_stream(
    arriving: DataFrame,
    path: str,
    checkpoint: str,
    arrived: str,
    span: str = "1 day",
    late: str = "7 days",
    available_now: bool = False,
    profile: Profile = GENERATED,
) -> StreamingQuery:
    """Keep counting what the filters remove of a stream, by span of arrival.

    Counts change as mails arrive, so each micro-batch writes the counts it changed to a
    folder of its own; a batch that is run again after a failure replaces its folder.
    State is a row for each span and step, given up once ``late`` behind the newest mail.
    """
    step = F.coalesce("__step", F.lit("kept")).alias("step")
    counts = (
        mark(arriving, profile)
        .withWatermark(arrived, late)
        .groupBy(F.window(arrived, span).alias("span"), step)
        .agg(F.count("*").alias("n"))
    )

    def write(changed: DataFrame, batch: int) -> None:
        flat = changed.select(F.col("span.start").alias("start"), "step", "n")
        flat.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return _start(writer, available_now)


def stream_funnel(spark: SparkSession, counts: str, decisions: str) -> DataFrame:
    """The funnel of a stream so far, from its counts and its decisions.

    ``original`` mails, those removed by each filter, ``duplicate`` ones, and ``final``.
    """
    passed = spark.read.parquet(decisions).agg(F.lit("final").alias("step"), F.count("*").alias("n"))
    schema = "start timestamp, step string, n long, batch long"
    folders = any(n.startswith("batch=") for n in child_names(spark, counts))
    changed = spark.read.schema(schema).parquet(counts) if folders else spark.createDataFrame([], schema)
    latest = changed.groupBy("start", "step").agg(F.max_by("n", "batch").alias("n"))

    def at(step: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("step") == step, F.col("n"))), F.lit(0))

    filters = ("empty_subject", "empty_body", "short")
    counted = latest.select("step", "n").union(passed).agg(
        F.coalesce(F.sum(F.when(F.col("step") != "final", F.col("n"))), F.lit(0)).alias("original"),
        *[at(s).alias(s) for s in (*filters, "kept", "final")],
    )
    duplicate = (F.col("kept") - F.col("final")).alias("duplicate")
    return counted.select("original", *filters, duplicate, "final")


def _append(decided: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    options = {"path": path, "checkpointLocation": checkpoint}
    return decided.writeStream.format("parquet").options(**options).outputMode("append")


def _start(writer: DataStreamWriter, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()
