"""From raw files to cleaned sources, and from sources to a balanced, split data set."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import assemble
from mailsift.operators.clean import Profile, funnel_of, kept_of, mark
from mailsift.operators.dedup import text_digest
from mailsift.operators.growing import admit
from mailsift.operators.parse import exclude_ordinals, parse_messages, stamp
from mailsift.sources.readers import read_mbox, read_raw_csv, read_tagged
from mailsift.sources.scratch import land

# Scan order decides which of several copies is the first.
FILE_ORDER = ("file", "block", "seq")


def raw_message_source(spark: SparkSession, path, label: int = 0, dataset: int = 1) -> DataFrame:
    """Parsed rows of raw-message CSV files, unparsed records included and marked."""
    return stamp(parse_messages(read_raw_csv(spark, path, scan_order=True)), label, dataset)


def mbox_source(
    spark: SparkSession, path, excluded: Iterable[int] = (), label: int = 1, dataset: int = 2
) -> DataFrame:
    """Parsed rows of mailboxes without the messages at the excluded places."""
    messages = read_mbox(spark, path, scan_order=True)
    excluded = list(excluded)
    if excluded:
        messages = exclude_ordinals(messages, excluded).drop("ordinal")
    return stamp(parse_messages(messages, decode=True), label, dataset)


def tagged_source(spark: SparkSession, tags: Mapping[str, tuple[int, int]], na_tokens=None) -> DataFrame:
    return read_tagged(spark, tags, na_tokens, scan_order=True).withColumn("parsed", F.lit(True))


def clean_source(df: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Cleaned mail of a parsed source, and the report of what was removed.

    Cleaned and marked rows are landed first: both results read them, so raw files are
    read, parsed and cleaned once, scan order is fixed, and what came from one large CSV
    file can be split.
    """
    marked = land(mark(df, profile, F.col("parsed")), "marked")
    return kept_of(marked, ("dataset", *FILE_ORDER)).drop(*FILE_ORDER), funnel_of(marked)


def grow_source(
    df: DataFrame, profile: Profile, root: str, batch: int, order=("dataset", *FILE_ORDER)
) -> tuple[DataFrame, DataFrame]:
    """Clean a batch of new mail and admit it to the corpus below ``root``.

    Returns the mails that were new, and the funnel of the batch, whose duplicates are
    those inside the batch alone.
    """
    marked = land(mark(df, profile, F.col("parsed") if "parsed" in df.columns else None), "marked")
    return admit(marked, root, batch, order), funnel_of(marked)


def add_key(df: DataFrame) -> DataFrame:
    """Key a mail by what it says and where it is from.

    Unique once copies are removed, and the same however files are laid out or tasks are
    retried, which row numbers are not.
    """
    return df.withColumn("key", F.hex(text_digest(F.col("dataset"), F.col("subject"), F.col("body"))))


def build_dataset(*cleaned: DataFrame, seed: int = assemble.SEED) -> DataFrame:
    """Union, balance, split and shuffle position of cleaned sources.

    The union is landed once, because balancing and splitting each read label and key
    several times; those passes then touch two columns of a Parquet table.
    """
    mails = land(add_key(assemble.union_sources(*cleaned)), "union")
    balanced = land(assemble.balance(mails, seed=seed), "balanced")
    return land(assemble.with_index(assemble.stratified_split(balanced, seed=seed), seed=seed), "dataset")
