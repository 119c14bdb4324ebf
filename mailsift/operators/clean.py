"""Cleaning profiles, quality filters and the removal funnel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import text
from mailsift.functions.html import html_to_text
from mailsift.operators.dedup import dedup_exact, first_of_each, text_digest
from mailsift.operators.projection import once
from mailsift.schemas import CONTRACT


@dataclass(frozen=True)
class Profile:
    """How one kind of source is cleaned."""

    strip_prefix: bool = False  # drop reply / forward marks from the subject
    html: bool = False  # reduce the body to its visible text
    min_body: int = 1  # shortest body kept, in characters
    min_total: int = 20  # shortest subject + body kept, in characters


RAW_MESSAGE = Profile(strip_prefix=True)
HTML_MAIL = Profile(html=True, min_body=20)
GENERATED = Profile()


def clean_text(df: DataFrame, profile: Profile = GENERATED) -> DataFrame:
    body = html_to_text(F.col("body")) if profile.html else text.clean_body(F.col("body"))
    return once(
        df, subject=text.clean_subject(F.col("subject"), profile.strip_prefix), body=body
    )


def has_subject() -> Column:
    return F.col("subject") != ""


def has_body(min_chars: int = 1) -> Column:
    if min_chars <= 1:
        return F.col("body") != ""
    return text.n_chars(F.col("body")) >= min_chars


def long_enough(min_chars: int = 20) -> Column:
    return text.n_chars(F.col("subject")) + text.n_chars(F.col("body")) >= min_chars


def removal_step(profile: Profile) -> Column:
    """Name of the first filter a cleaned row fails; null when it passes all."""
    return (
        F.when(~has_subject(), "empty_subject")
        .when(~has_body(profile.min_body), "empty_body")
        .when(~long_enough(profile.min_total), "short")
    )


def keep_valid(df: DataFrame, profile: Profile = GENERATED) -> DataFrame:
    return df.filter(
        has_subject() & has_body(profile.min_body) & long_enough(profile.min_total)
    )


def to_contract(df: DataFrame, *retained: str) -> DataFrame:
    return df.select(*retained, *CONTRACT)


def mark(df: DataFrame, profile: Profile = GENERATED, parsed: Column | None = None) -> DataFrame:
    """Cleaned text, the filter a row fails (``__step``) and a digest of what passes all.

    ``parsed`` tells the parsed records from the rest (default: all parsed). All regular
    expressions and digests are here; ``kept_of`` and ``funnel_of`` read the result, which
    is worth landing when both are wanted.
    """
    is_parsed = F.lit(True) if parsed is None else F.coalesce(parsed, F.lit(False))
    step = F.when(~F.col("__parsed"), "unparsed").otherwise(removal_step(profile))
    marked = clean_text(df.withColumn("__parsed", is_parsed), profile).withColumn("__step", step)
    digest = F.when(F.col("__step").isNull(), text_digest(F.col("subject"), F.col("body")))
    return marked.drop("__parsed").withColumn("__digest", digest)


def kept_of(marked: DataFrame, order: Sequence[str] = ("dataset", "key")) -> DataFrame:
    """Marked rows that pass all filters, the first of each text by ``order``."""
    valid = marked.filter("__step IS NULL").drop("__step")
    retained = [c for c in order if c not in CONTRACT]
    return to_contract(first_of_each(valid, "__digest", order), *retained)


def clean(
    df: DataFrame,
    profile: Profile = GENERATED,
    order: Sequence[str] = ("dataset", "key"),
) -> DataFrame:
    """Clean, filter and de-duplicate one corpus; the order columns are kept along."""
    valid = keep_valid(clean_text(df, profile), profile)
    retained = [c for c in order if c not in CONTRACT]
    return to_contract(dedup_exact(valid, order=order), *retained)


def funnel(
    df: DataFrame, profile: Profile = GENERATED, by: Sequence[str] = (), parsed: Column | None = None
) -> DataFrame:
    """How many rows each step removes, each row counted where it first fails."""
    return funnel_of(mark(df, profile, parsed), by)


def funnel_of(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The funnel of marked rows.

    One scan and one narrow shuffle: only digests and counts travel. Rows that fail a
    filter share a single null digest, which the map-side aggregate folds into one row per
    task.
    """
    by = list(by)
    per_text = (
        marked.select(*by, F.coalesce("__step", F.lit("kept")).alias("__step"), "__digest")
        .groupBy(*by, "__step", "__digest")
        .agg(F.count("*").alias("__n"))
    )

    def rows_at(step: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("__step") == step, F.col("__n"))), F.lit(0))

    distinct = F.count_if(F.col("__step") == "kept")
    return per_text.groupBy(*by).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("original"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - rows_at("unparsed")).alias("parsed"),
        rows_at("empty_subject").alias("empty_subject"),
        rows_at("empty_body").alias("empty_body"),
        rows_at("short").alias("short"),
        (rows_at("kept") - distinct).alias("duplicate"),
        distinct.alias("final"),
    )
