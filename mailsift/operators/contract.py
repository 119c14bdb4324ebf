"""Does a table have the columns, rows and classes that were agreed?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.schemas import CONTRACT


def missing_columns(df: DataFrame, required: Iterable[str] = CONTRACT) -> list[str]:
    return sorted(set(required) - set(df.columns))


def check_contract(df: DataFrame, required: Iterable[str] = CONTRACT, split: str = "split") -> DataFrame:
    """Rows, columns and rows per class of each split; raises if a column is missing."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    by = [split] if split in df.columns else []
    counted = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return counted.withColumn("columns", F.lit(len(df.columns) - len(by)))
