"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import LOWER, SPACES, UPPER
from mailsift.sources.scratch import land

MIN_CHARS, MIN_DOCUMENTS = 40, 5


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def line_digest(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key; null for keys that are too short to count."""
    # Most lines are settled by their own length.
    key = line_key(line)
    return F.when(
        (F.char_length(line) >= min_chars) & (F.char_length(key) >= min_chars), F.unhex(F.md5(key))
    )


def shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``line, keeper`` of the lines found in many documents; the keeper has the largest id.

    A document counts once for each line, so its lines are made distinct before they are
    exploded; the counts then add up inside each task before they are shuffled, and a line
    in every document costs one row per task.
    """
    return (
        _digests(docs, min_chars, key, text)
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_documents)
        .select("line", "keeper")
    )


def _digests(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """``id, line`` once per document, however often the line stands in it."""
    digests = F.transform(_lines(text), lambda x: line_digest(x, min_chars))
    distinct = F.explode(F.array_distinct(digests)).alias("line")
    return docs.select(F.col(key).alias("id"), distinct).filter("line is not null")


def _places(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """``id, place, line`` for every line that is long enough to count."""
    places = docs.select(F.col(key).alias("id"), F.posexplode(_lines(text)).alias("place", "line"))
    return places.withColumn("line", line_digest(F.col("line"), min_chars)).filter("line is not null")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def drop_shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Documents with every column as it was, but the text without lines that many share.

    Adds ``n_lines`` (before) and ``n_dropped``. A line whose key has at least
    ``min_chars`` code points and stands in at least ``min_documents`` documents loses all
    its places except those in the document with the largest id that holds it. Other lines
    stay in their order, white space and all.

    Lines are exploded as 128-bit hashes only. The lines over the threshold are written
    once; the places that each document loses join back by id as one small row, and its
    other lines are put together again by place, in time linear in its lines.

    A null text stays null and counts as one empty line; an empty text is one empty line.
    Ids are taken to be unique; rows that repeat an id with the same text count as so many
    documents and lose the same places. A row with a null id counts for its lines and loses them all. A text
    that loses every line becomes empty. An empty table stays empty. The names
    ``n_lines`` and ``n_dropped`` are overwritten if the table has them.
    """
    shared = land(shared_lines(docs, min_chars, min_documents, key, text), "shared_lines")
    losses = (
        _places(docs, min_chars, key, text)
        .join(shared, "line")
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_set("place").alias("__lost"))
    )
    added = ("n_lines", "n_dropped")
    own = [c for c in docs.columns if c not in added]
    # The one-element array keeps the lines from being split anew for every column.
    split = F.inline(F.array(F.struct(_lines(text).alias("__lines"))))
    wide = docs.join(losses, F.col(key).eqNullSafe(F.col("__id")), "left").select(*own, "__lost", split)
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    stays = F.transform(F.array_except(places, "__lost"), lambda i: F.get("__lines", i))
    kept = F.when(F.col("__lost").isNull() | F.col(text).isNull(), F.col(text)).otherwise(
        F.array_join(stays, "\n")
    )
    return wide.select(
        *[kept.alias(c) if c == text else F.col(c) for c in own],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long").alias("n_dropped"),
    )
