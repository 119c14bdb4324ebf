"""Readers for raw messages, mailboxes, tagged, cleaned and split CSV files."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions.mime import from_char
from mailsift.functions.text import apply_na_tokens
from mailsift.operators.parse import stamp
from mailsift.schemas import CLEAN_MAIL
from mailsift.sources.csv_records import BOM, column_names, header_lines, read_csv_records

#: How records of a CSV file may lie: True for line breaks inside quoted fields, read in
#: blocks; False for a record a line; "whole" for files with stray quotes, a task for each.
MultiLine = bool | str

# Empty markers another reader of the same files treats as missing; pass as `na_tokens`.
COMMON_NA_TOKENS = ["NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]


def _header_groups(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files by their first line, a byte-order mark aside."""
    groups: dict[str, list[str]] = {}
    for file, header in sorted(header_lines(spark, path).items()):
        if header:
            groups.setdefault(header.rstrip("\r"), []).append(file)
    return dict(sorted(groups.items()))


def _csv(
    spark: SparkSession,
    path: str | list[str],
    select: Callable[[DataFrame, list[Column]], DataFrame],
    multi_line: MultiLine = True,
    scan_order: bool = False,
) -> DataFrame:
    """What ``select`` takes by name from quoted, doubled-quote CSV; every column is text.

    Each file names its own columns: files whose headers differ are read apart and their
    selections united by name. Files of any size are read in blocks, line breaks inside
    fields or not; fields that hold quotes must be quoted, as writers do. For other files
    ``multi_line="whole"`` reads each by one task.
    """
    parts = []
    for header, files in _header_groups(spark, path).items():
        if multi_line is True:
            df = read_csv_records(spark, files, column_names(header))
            order = [F.col(f"__{c}").alias(c) for c in ("file", "block", "seq")]
        else:
            whole = multi_line == "whole"
            df = spark.read.csv(files, header=True, multiLine=whole, quote='"', escape='"', encoding="UTF-8")
            order, first = _scan_order(), df.columns[0]
            df = df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df
        parts.append(select(df, order if scan_order else []))
    if not parts:
        raise ValueError(f"no CSV file with a header in {path}")
    return functools.reduce(DataFrame.unionByName, parts)


def _scan_order() -> list[Column]:
    """Columns that sort the records of each file as they stand in it.

    ``seq`` grows in reading order inside a block; together with file and block it is an
    order that does not depend on how blocks were dealt out to tasks.
    """
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ]


def read_raw_csv(
    spark: SparkSession,
    path: str | list[str],
    column: str = "message",
    scan_order: bool = False,
    multi_line: MultiLine = True,
) -> DataFrame:
    """One raw message per row in the named column."""
    message = F.col(column).alias("message")
    return _csv(spark, path, lambda df, order: df.select(*order, message), multi_line, scan_order)


def read_raw_json(
    spark: SparkSession, path: str | list[str], column: str = "message", scan_order: bool = False
) -> DataFrame:
    """One raw message per line of JSON, in the named member; files of any size are read in blocks."""
    df = spark.read.json(path, T.StructType([T.StructField(column, T.StringType())]))
    return df.select(*(_scan_order() if scan_order else []), F.col(column).alias("message"))


def read_mbox(spark: SparkSession, path: str | list[str], scan_order: bool = False) -> DataFrame:
    """One row per message of mbox files; a line that begins ``From `` starts a message.

    The separator is the record delimiter of a splittable text scan, so a mailbox of any
    size is read in blocks. Quoted ``>From `` lines stay as they are. Files must begin
    with a ``From `` line, as the format asks.
    """
    df = spark.read.option("lineSep", "\nFrom ").text(path)
    first_line = F.length(F.substring_index("value", "\n", 1))
    after_separator = from_char(F.col("value"), first_line + 2)
    return df.filter(F.length("value") > 0).select(
        *(_scan_order() if scan_order else []), after_separator.alias("message")
    )


def read_tagged(
    spark: SparkSession,
    tags: Mapping[str, tuple[int, int]],
    na_tokens: Sequence[str] | None = None,
    scan_order: bool = False,
    multi_line: MultiLine = True,
) -> DataFrame:
    """Files of one kind, each tagged with its ``(label, dataset)``."""
    parts = []
    for path, (label, dataset) in tags.items():
        texts = [apply_na_tokens(F.col(c), na_tokens).alias(c) for c in ("subject", "body")]
        own = _csv(spark, path, lambda df, order: df.select(*order, *texts), multi_line, scan_order)
        parts.append(stamp(own, label, dataset))
    return functools.reduce(DataFrame.unionByName, parts)


def read_clean(
    spark: SparkSession,
    path: str | list[str],
    na_tokens: Sequence[str] | None = None,
    scan_order: bool = False,
    multi_line: MultiLine = True,
) -> DataFrame:
    """Cleaned mail, columns found by name and typed by the contract.

    A label or source id that is no number becomes null, which the contract report shows
    as a class of its own, instead of ending the job.
    """
    def typed(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return apply_na_tokens(c, na_tokens).alias(field.name)
        return F.trim(c).try_cast(field.dataType).alias(field.name)

    fields = [typed(field) for field in CLEAN_MAIL]
    return _csv(spark, path, lambda df, order: df.select(*order, *fields), multi_line, scan_order)


def read_split(
    spark: SparkSession,
    path: str | list[str],
    split: str | None = None,
    na_tokens: Sequence[str] | None = None,
    scan_order: bool = False,
    multi_line: MultiLine = True,
) -> DataFrame:
    """One split file; a byte-order mark before the header is ignored."""
    df = read_clean(spark, path, na_tokens, scan_order, multi_line)
    return df.withColumn("split", F.lit(split)) if split else df
