"""Writers for mail tables and reports, and a preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_BOM = "\ufeff"


def write_csv(
    df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite", bom: bool = False
) -> None:
    """CSV for exchange: header, no index, text kept to the last blank.

    ``bom`` puts a byte-order mark at the beginning of every file, in front of the first
    column's name, as spreadsheets ask for; it cannot go with ``quote_all``, which would
    put a quote in front of it.
    """
    if bom and quote_all:
        raise ValueError("a byte-order mark must come before the first quote")
    if bom:
        df = df.toDF(_BOM + df.columns[0], *df.columns[1:])
    df.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        quoteAll=quote_all,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Split mail as Parquet, one folder per split, so readers prune to the one they want."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", bom: bool = False) -> None:
    """Predictions or metric tables; missing parent folders are made."""
    if fmt == "csv":
        write_csv(df, path, bom=bom)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def preview(df: DataFrame, k: int = 5, chars: int = 300, order: str = "key") -> DataFrame:
    """First ``k`` rows by ``order`` with the body cut for display."""
    return df.orderBy(order).limit(k).withColumn("body", F.substring("body", 1, chars))
