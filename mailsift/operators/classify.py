"""Training, scoring and choosing a mail classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import tagged_text
from mailsift.sources.scratch import land

_STEPS = ("__tokens", "__counts", "__features", "__raw", "__probability", "__prediction")
_TEXT = "__text"
MIN_PROBABILITY = 1e-15


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn(_TEXT, tagged_text(F.col("subject"), F.col("body")))


def fit_features(train: DataFrame, features: int = 1 << 18) -> PipelineModel:
    """Hashed words, weighted by how rare they are.

    Hashing needs no vocabulary on the driver, so the model's size is fixed by
    ``features`` and not by the corpus.
    """
    stages = [
        RegexTokenizer(inputCol=_TEXT, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__counts", numFeatures=features),
        IDF(inputCol="__counts", outputCol="__features", minDocFreq=2),
    ]
    return Pipeline(stages=stages).fit(_with_text(train).select(_TEXT))


def _featured(df: DataFrame, model: PipelineModel, label: str) -> DataFrame:
    """Label and features of every row, written once for all that is fitted on them."""
    rows = _with_text(df).select(_TEXT, F.col(label).cast("double").alias(label))
    return land(model.transform(rows).select(label, "__features"), "features")


def _regression(label: str, regularisation: float = 0.01, iterations: int = 30) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="__features",
        labelCol=label,
        rawPredictionCol="__raw",
        probabilityCol="__probability",
        predictionCol="__prediction",
        regParam=regularisation,
        maxIter=iterations,
    )


def fit_classifier(
    train: DataFrame,
    label: str = "label",
    features: int = 1 << 18,
    regularisation: float = 0.01,
    iterations: int = 30,
) -> PipelineModel:
    """Hashed, weighted words into a logistic regression."""
    words = fit_features(train, features)
    fitted = _regression(label, regularisation, iterations).fit(_featured(train, words, label))
    return PipelineModel(stages=[*words.stages, fitted])


def probability(df: DataFrame, model: PipelineModel, name: str = "p_phishing") -> DataFrame:
    """Add the probability that a mail is phishing."""
    scored = model.transform(_with_text(df))
    return scored.withColumn(name, vector_to_array("__probability")[1]).drop(_TEXT, *_STEPS)


def answer_of(p: Column, margin: float = 0.0) -> Column:
    """Probability as a free-text answer, ``unsure`` closer than ``margin`` to even."""
    return (
        F.when(p.isNull() | (F.abs(p - 0.5) < margin), "unsure")
        .when(p >= 0.5, "phishing")
        .otherwise("legitimate")
    )


def score(df: DataFrame, model: PipelineModel, margin: float = 0.05) -> DataFrame:
    """Add ``p_phishing`` and the answer ``raw_prediction``."""
    scored = probability(df, model)
    return scored.withColumn("raw_prediction", answer_of(F.col("p_phishing"), margin))


def model_answers(load: Callable[[], Callable[[list[str]], list[str]]]):
    """Column function that asks an outside model, for instance a language model.

    ``load`` runs once per Python worker and returns the model: a batch of prompts in, as
    many answers out. Prompts travel in Arrow batches. Use as
    ``df.withColumn("raw_prediction", model_answers(load)(prompt_column))``.
    """

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(list(prompts)), dtype="object")

    return F.pandas_udf(answer, "string")


def row_loss(p: Column, label: Column) -> Column:
    of_label = F.when(label == 1, p).otherwise(1 - p)
    bounded = F.least(F.greatest(of_label, F.lit(MIN_PROBABILITY)), F.lit(1.0))
    return -F.log(bounded)


def log_loss(
    df: DataFrame,
    by: Sequence[str] = (),
    p: str = "p_phishing",
    label: str = "label",
    index: str | None = None,
    batch_size: int | None = None,
    max_batches: int | None = None,
) -> DataFrame:
    """Mean loss, 0 for no rows.

    With ``index`` and ``batch_size`` it is the mean over batches of their mean losses,
    optionally of the first ``max_batches`` only, as a batched evaluation reports it.
    """
    losses = df.withColumn("__loss", row_loss(F.col(p), F.col(label)))
    if batch_size:
        batch = F.floor(F.col(index) / batch_size)
        losses = losses.withColumn("__batch", batch)
        if max_batches:
            losses = losses.filter(F.col("__batch") < max_batches)
        losses = losses.groupBy(*by, "__batch").agg(F.avg("__loss").alias("__loss"))
    return losses.groupBy(*by).agg(F.coalesce(F.avg("__loss"), F.lit(0.0)).alias("loss"))


def best_candidate(losses: DataFrame, candidate: str = "epoch", loss: str = "loss") -> DataFrame:
    """The candidate with the lowest loss, the earliest on ties."""
    best = losses.agg(F.min(F.struct(loss, candidate)).alias("best"))
    return best.select(f"best.{candidate}", f"best.{loss}")


def fit_best(
    train: DataFrame,
    valid: DataFrame,
    grid: Sequence[Mapping],
    label: str = "label",
    features: int = 1 << 18,
) -> tuple[PipelineModel, DataFrame]:
    """Train every parameter set, keep the model with the lowest validation loss.

    Words are hashed and weighted once for every number of features; only the regressions
    are fitted anew.
    """
    learned: dict[int, tuple] = {}
    models, losses = [], []
    for i, params in enumerate(grid):
        size = params.get("features", features)
        if size not in learned:
            words = fit_features(train, size)
            learned[size] = words, _featured(train, words, label), _featured(valid, words, label)
        words, seen, held = learned[size]
        model = _regression(label, **{k: v for k, v in params.items() if k != "features"}).fit(seen)
        scored = model.transform(held).withColumn("p_phishing", vector_to_array("__probability")[1])
        losses.append((i, log_loss(scored, label=label).first().loss))
        models.append(PipelineModel(stages=[*words.stages, model]))
    table = train.sparkSession.createDataFrame(losses, "epoch int, loss double")
    return models[best_candidate(table).first()["epoch"]], table
