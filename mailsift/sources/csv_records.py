"""Records of CSV files whose fields hold line breaks, read in blocks."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.sources.scratch import land

BOM = "﻿"
_READERS = 16


def header_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of every file, a byte-order mark aside; no more of a file is read.

    Files are listed by Spark and opened by the driver, some at a time.
    """
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> tuple[str, str]:
        place = hadoop.fs.Path(sc._jvm.java.net.URI(file))
        stream = place.getFileSystem(conf).open(place)
        codec = codecs.getCodec(place)
        raw = stream if codec is None else codec.createInputStream(stream)
        reader = sc._jvm.java.io.BufferedReader(sc._jvm.java.io.InputStreamReader(raw, "UTF-8"))
        try:
            return place.toString(), (reader.readLine() or "").lstrip(BOM)
        finally:
            reader.close()

    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(_READERS) as pool:
        return dict(pool.map(first_line, files))


def column_names(header: str) -> list[str]:
    """Names in a header line; empty and repeated ones are told by their place, as Spark does."""
    given = next(csv.reader([header]), [])
    lower = [name.lower() for name in given]
    return [
        f"_c{i}" if not name else f"{name}{i}" if lower.count(lower[i]) > 1 else name for i, name in enumerate(given)
    ]


def _quotes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _borders(lines: DataFrame) -> DataFrame:
    """A row per block: does it begin inside a quoted field (``open``), and end inside one
    (``ends_open``)."""
    odd = lines.groupBy("file", "block").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    upto = F.sum("odd").over(Window.partitionBy("file").orderBy("block"))
    return odd.select("file", "block", ((upto - F.col("odd")) % 2).alias("open"), (upto % 2).alias("ends_open"))


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, block, seq, record`` of every record behind the headers; blank lines are left out.

    A line break ends a record if an even number of quotes stands before it. Quotes are
    counted per block, so that a small table tells which blocks begin inside a field; lines
    are numbered by record inside their block, where all whole records are put together.
    Only pieces of records that go over a border, two a block at most, meet in a second
    step. Files of any size are read by many tasks, and moved once.
    """
    lines = _lines(spark, files)
    borders = land(_borders(lines), "borders")
    inside = Window.partitionBy("file", "block").orderBy("seq")
    counted = lines.join(borders, ["file", "block"]).withColumn("quotes", _quotes(F.col("value")))
    before = F.sum("quotes").over(inside) - F.col("quotes") + F.col("open")
    starts = counted.withColumn("starts", (before % 2 == 0).cast("int"))
    numbered = starts.withColumn("number", F.sum("starts").over(inside))
    pieces = numbered.groupBy("file", "block", "number").agg(
        F.first("ends_open").alias("ends_open"),
        F.min("seq").alias("seq"),
        F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("lines"),
    )
    last = F.max("number").over(Window.partitionBy("file", "block"))
    pieces = pieces.withColumn("cut", (F.col("number") == 0) | ((F.col("ends_open") == 1) & (F.col("number") == last)))
    text = F.array_join(F.transform("lines", lambda l: l["value"]), "\n")
    header = (F.col("block") == 0) & (F.col("number") == 1)
    whole = pieces.filter(~F.col("cut") & ~header).select("file", "block", "seq", text.alias("record"))
    cut = pieces.filter("cut").select("file", "block", "number", "seq", text.alias("text"))
    # A piece without a beginning goes to the last record that has one, blocks before.
    along = Window.partitionBy("file").orderBy("block", "number")
    begun = F.last(F.when(F.col("number") > 0, F.struct("block", "number", "seq")), ignorenulls=True).over(along)
    joined = (
        cut.withColumn("begun", begun)
        .groupBy("file", "begun")
        .agg(F.array_sort(F.collect_list(F.struct("block", "number", "text"))).alias("texts"))
        .select(
            "file", "begun.block", "begun.number", "begun.seq",
            F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("record"),
        )
    )
    records = whole.unionByName(joined.filter(~header).drop("number"))
    return records.filter(F.rtrim(F.col("record"), F.lit("\r")) != "")


def read_csv_records(spark: SparkSession, files: list[str], header: list[str]) -> DataFrame:
    """The columns that ``header`` names, as text, of files that have it as their first line.

    ``__file, __block, __seq`` sort the records as they stand in the files.
    """
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    # In files with Windows line ends those inside fields become plain, as Spark's reader has it.
    plain = F.replace(F.rtrim(F.col("record"), F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    line = F.when(F.endswith(F.col("record"), F.lit("\r")), plain).otherwise(F.col("record"))
    parsed = F.from_csv(line, schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}).alias("__row")
    order = [F.col(c).alias(f"__{c}") for c in ("file", "block", "seq")]
    named = read_records(spark, files).select(*order, parsed)
    return named.select("__file", "__block", "__seq", "__row.*")
