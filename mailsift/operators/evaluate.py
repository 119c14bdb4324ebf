"""Confusion counts, quality ratios, run comparison and target checks."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("TP", "TN", "FP", "FN")
RATIOS = ("Accuracy", "Precision", "Recall", "F1-score")


def _counts(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    return [
        F.count_if((y == 1) & (p == 1)).alias("TP"),
        F.count_if((y == 0) & (p == 0)).alias("TN"),
        F.count_if((y == 0) & (p == 1)).alias("FP"),
        F.count_if((y == 1) & (p == 0)).alias("FN"),
    ]


def _validity(predicted: str) -> list[Column]:
    valid = F.count_if(F.col(predicted).isin(0, 1))
    return [
        F.count("*").alias("total"),
        valid.alias("n"),
        (F.count("*") - valid).alias("invalid"),
    ]


def confusion(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Confusion counts with phishing as positive; rows without a valid answer count nowhere."""
    return df.groupBy(*by).agg(*_counts(label, predicted))


def validity(df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted_label") -> DataFrame:
    """Total, valid (``n``) and invalid answers."""
    return df.groupBy(*by).agg(*_validity(predicted))


def _ratio(above: Column, below: Column) -> Column:
    return F.coalesce(F.try_divide(above, below), F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Quality ratios from ``TP, TN, FP, FN, n, total``; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    based = counts.withColumns(
        {
            "Accuracy": _ratio(tp + tn, F.col("n")),
            "Precision": _ratio(tp, tp + fp),
            "Recall": _ratio(tp, tp + fn),
            "Conservative accuracy": _ratio(tp + tn, F.col("total")),
        }
    )
    p, r = F.col("Precision"), F.col("Recall")
    return based.withColumn("F1-score", _ratio(2 * p * r, p + r))


def quality(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Counts, validity and ratios, overall or per group; only groups and counts shuffle."""
    return with_ratios(df.groupBy(*by).agg(*_validity(predicted), *_counts(label, predicted)))


def quality_report(
    df: DataFrame, by: str = "dataset", label: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Overall quality (``by`` null, scope ``all``) and quality per group, in one pass."""
    counted = df.groupingSets([[by], []], by).agg(
        F.when(F.grouping(by) == 1, "all").otherwise("group").alias("scope"),
        *_validity(predicted),
        *_counts(label, predicted),
    )
    return with_ratios(counted)


def compare_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """One row of quality per named run, for instance before and after training."""
    named = [df.select(F.lit(name).alias("Model"), *RATIOS, *COUNTS) for name, df in runs.items()]
    return functools.reduce(DataFrame.unionByName, named)


# Bands a tuned classifier is expected to reach.
TARGET_BANDS = {
    "Accuracy": (0.80, 0.92),
    "Precision": (0.75, 0.92),
    "Recall": (0.85, 0.95),
    "F1-score": (0.82, 0.93),
}


def check_targets(
    metrics: DataFrame, bands: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Each metric against its band: ``below``, ``within`` or ``above``."""
    bands = bands or TARGET_BANDS
    others = [c for c in metrics.columns if c not in bands]
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).alias("value"),
            F.lit(float(low)).alias("low"),
            F.lit(float(high)).alias("high"),
        )
        for name, (low, high) in bands.items()
    ]
    verdict = (
        F.when(F.col("value") < F.col("low"), "below")
        .when(F.col("value") > F.col("high"), "above")
        .otherwise("within")
    )
    return metrics.select(*others, F.inline(F.array(*entries))).withColumn("verdict", verdict)
