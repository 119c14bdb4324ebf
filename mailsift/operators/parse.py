"""Raw messages to mail rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import mime, multipart
from mailsift.operators.ordering import with_ordinals
from mailsift.operators.projection import once


def parse_messages(df: DataFrame, column: str = "message", decode: bool = False) -> DataFrame:
    """Replace a raw message by ``parsed``, ``subject`` and ``body``.

    ``decode=False``: body of a single-part mail as it stands, missing subject ``""``.
    ``decode=True``: body transfer-decoded to UTF-8 with bad bytes dropped, missing
    subject null. Multipart mails give the text of all their ``text/plain`` parts.

    Well-formed mail is taken apart by JVM expressions, multipart mail of any depth, clean
    base64 and quoted-printable included. Only the rest has its text sent to Python: the
    others pass a null, as a ``when`` around the call would not stop Spark from evaluating
    it for every row.
    """
    missing = None if decode else ""
    raw = F.col("__raw")
    cut = once(
        df.withColumnRenamed(column, "__raw"),
        __head=mime.header_block(raw),
        __body=mime.body_raw(raw),
    )
    head, body = F.col("__head"), F.col("__body")
    joined = multipart.multipart_text(head, body, from_bytes=decode)
    if decode:
        single = F.coalesce(mime.base64_text(head, body), multipart.quoted_body(head, body))
        cut = once(cut, __joined=joined, __decoded=single)
    else:
        cut = once(cut, __joined=joined, __decoded=F.lit(None).cast("string"))
    odd = mime.needs_parser(head, raw, decode, F.col("__decoded"), F.col("__joined"))
    routed = once(cut, __odd=F.coalesce(odd, F.lit(False)))
    narrow = (
        routed.withColumn("__there", raw.isNotNull())
        .withColumn("__python", F.when(F.col("__odd"), raw.cast("binary")))
        .drop("__raw")
    )
    done = narrow.withColumn("__mime", mime.mime_parser(decode)(F.col("__python")))

    def either(name: str, native: Column) -> Column:
        return F.when(F.col("__odd"), F.col(f"__mime.{name}")).otherwise(native).alias(name)

    subject = F.when(F.col("__there"), mime.subject_in(F.col("__head"), missing))
    return done.select(
        *[c for c in df.columns if c != column],
        either("ok", F.col("__there")).alias("parsed"),
        either("subject", subject),
        either("body", F.coalesce("__joined", "__decoded", "__body")),
    )


def drop_unparsed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("parsed")).drop("parsed")


def exclude_ordinals(df: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """Leave out messages by their place in the file, counted from 0."""
    numbered = df if "ordinal" in df.columns else with_ordinals(df)
    return numbered.filter(~F.col("ordinal").isin(list(ordinals)))


def stamp(df: DataFrame, label: int, dataset: int) -> DataFrame:
    """Mark every row of a source with its class and source id."""
    return df.withColumn("label", F.lit(label)).withColumn("dataset", F.lit(dataset))
