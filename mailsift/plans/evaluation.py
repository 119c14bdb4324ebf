"""Scored mail to prediction rows, quality tables and target checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mailsift.functions.answers import parse_answer_any
from mailsift.operators import evaluate
from mailsift.operators.policy import prediction_rows
from mailsift.sources.scratch import land
from mailsift.sources.sinks import write_report


def evaluate_run(
    scored: DataFrame, path: str | None = None, parse=parse_answer_any, fmt: str = "parquet", bom: bool = False
) -> dict[str, DataFrame]:
    """Predictions, quality overall and per source, and the target check of one run.

    Predictions are landed, so that scoring runs once however many tables are made; the
    metrics of all rows and of each source come from one pass over them.
    """
    predictions = land(prediction_rows(scored, parse=parse), "predictions")
    report = land(evaluate.quality_report(predictions), "report")
    tables = {
        "predictions": predictions,
        "report": report,
        "overall": report.filter("scope = 'all'").drop("scope", "dataset"),
        "by_dataset": report.filter("scope = 'group'").drop("scope").orderBy("dataset"),
    }
    tables["targets"] = evaluate.check_targets(tables["overall"].select(*evaluate.RATIOS))
    if path:
        for name, table in tables.items():
            write_report(table, f"{path}/{name}", fmt, bom)
    return tables
