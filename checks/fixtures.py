"""Mail-shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import mime
from mailsift.operators.clean import GENERATED, Profile, clean_text, keep_valid
from mailsift.operators.dedup import dedup_exact


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as it lies."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def before_newline(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def after_newline(c: Column) -> Column:
    return mime.from_char(c, F.length(before_newline(c)) + 2)


def mail(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as mails: first line is the subject, the rest the body."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    legit = F.coalesce("toxic", F.lit(0)) == 0
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("key"),
        before_newline(F.col("text")).alias("subject"),
        after_newline(F.col("text")).alias("body"),
        F.col("toxic").alias("label"),
        F.when(legit, 1).otherwise(2 + F.col("doc_id") % 3).cast("int").alias("dataset"),
    )


def clean_mail(spark: SparkSession, sf: str, profile: Profile = GENERATED) -> DataFrame:
    """Cleaned, filtered, de-duplicated mail with its key; lowest key wins."""
    valid = keep_valid(clean_text(mail(spark, sf), profile), profile)
    return dedup_exact(valid, order=["key"])


def labelled_mail(spark: SparkSession, sf: str) -> DataFrame:
    return clean_mail(spark, sf).filter(F.col("label").isNotNull())


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled mail with a made-up free-text answer of every kind a model gives."""
    slot = F.col("key") % 11
    answer = (
        F.when(slot == 0, "unsure")
        .when(slot == 1, F.lit(None).cast("string"))
        .when(slot == 2, "legitimate, not phishing")
        .when(slot == 3, " Phishing.")
        .when(F.col("label") == 1, "phishing")
        .otherwise("Legitimate")
    )
    return labelled_mail(spark, sf).withColumn("raw_prediction", answer)
