"""Raw mail taken apart: subject, undecoded body, and which rows need a MIME parser."""

from __future__ import annotations

import email

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import let

# Patterns below use `d`, so that `^` and `$` know no line end but "\n".
_SUBJECT = r"(?imd)^Subject:[ \t]*([^\n]*(?:\n[ \t][^\n]*+)*+)"
HEADER_BLOCK = r"\A(?:[!-9;-~]++:[^\n]*+(?:\n[ \t][^\n]*+)*+(?:\n|\z))*+\z"
_HAS_SUBJECT = r"(?imd)^Subject:"
_NESTED = r"(?imd)^Content-Type:[ \t]*+(?:\n[ \t]++)*+(?:multipart|message)/"
_TRANSFER = r"(?imd)^Content-Transfer-Encoding:"
_BASE64 = r"(?imd)^Content-Transfer-Encoding:[ \t]*+base64$"
# Whole groups of four, padding only at the end: what every decoder reads alike.
WHOLE_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
_ENCODED = r"(?imd)^Content-Transfer-Encoding:\s*(?:base64|quoted-printable|(?:x-)?uue)"


def from_char(c: Column, start: Column) -> Column:
    """Text from a character on, counted from 1; no need to know how much is left."""
    return F.substring(c, start, F.lit(2**31 - 1))


def cut_at(raw: Column) -> Column:
    """Place of the line end before the first empty line, 0 if there is none."""
    with_cr = F.when(F.contains(raw, F.lit("\r")), F.instr(raw, "\n\r\n")).otherwise(0)

    def first(places: Column) -> Column:
        bare, cr = places["bare"], places["cr"]
        return F.when((bare > 0) & ((cr == 0) | (bare < cr)), bare).otherwise(cr)

    return let(F.struct(F.instr(raw, "\n\n").alias("bare"), with_cr.alias("cr")), first)


def _unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def opens_empty(raw: Column) -> Column:
    """The first line is empty already, so the message has no headers."""
    return F.startswith(raw, F.lit("\n")) | F.startswith(raw, F.lit("\r\n"))


def header_block(raw: Column, cut: Column | None = None) -> Column:
    """Lines before the first empty line, with unix line ends; ``cut`` tells where that is, if known."""
    head = let(
        cut_at(raw) if cut is None else cut,
        lambda cut: F.when(cut > 0, F.substring(raw, F.lit(1), cut)).otherwise(raw),
    )
    lines = _unix_lines(head)
    return F.when(opens_empty(raw), "").otherwise(F.regexp_replace(lines, r"\n\z", ""))


def body_raw(raw: Column, cut: Column | None = None) -> Column:
    """Everything after the first empty line, transfer encoding left as it is."""
    after = let(cut_at(raw) if cut is None else cut, lambda cut: F.when(cut > 0, from_char(raw, cut + 1)).otherwise(""))
    rest = F.when(opens_empty(raw), raw).otherwise(after)

    def without_empty_line(r: Column) -> Column:
        return from_char(r, F.when(F.startswith(r, F.lit("\r\n")), 3).otherwise(2))

    return F.when(raw.isNotNull(), let(rest, without_empty_line))


def subject_in(header: Column, missing: str | None = "") -> Column:
    found = F.regexp_extract(header, _SUBJECT, 1)
    return F.when(header.rlike(_HAS_SUBJECT), found).otherwise(F.lit(missing))


def subject_of(raw: Column, missing: str | None = "") -> Column:
    """First ``Subject`` header, folded lines and encoded words left as they are."""
    return subject_in(header_block(raw), missing)


def base64_text(header: Column, body: Column) -> Column:
    """The decoded body of clean base64 mail that holds UTF-8 text; null for any other."""
    only = header.rlike(_BASE64) & (F.regexp_count(header, F.lit(_TRANSFER)) == 1)

    def decoded(letters: Column) -> Column:
        text = F.try_to_binary(letters, F.lit("base64")).cast("string")
        return F.when(letters.rlike(WHOLE_BASE64), let(text, lambda t: F.when(F.is_valid_utf8(t), t)))

    return F.when(only, let(F.regexp_replace(body, r"\r?\n", ""), decoded))


def needs_parser(
    header: Column, raw: Column, decode: bool, decoded: Column | None = None, joined: Column | None = None
) -> Column:
    """True for messages that plain string functions would not take apart correctly.

    ``decoded`` is the text of a body whose transfer encoding has been undone already,
    ``joined`` that of the parts of a multipart mail.
    """
    apart = joined.isNull() if joined is not None else F.lit(True)
    odd = ~header.rlike(HEADER_BLOCK) | F.contains(header, F.lit("\r")) | (header.rlike(_NESTED) & apart)
    if decode:
        encoded = header.rlike(_ENCODED) & (decoded.isNull() if decoded is not None else F.lit(True))
        odd = odd | encoded | header.rlike(r"[^\x00-\x7f]") | ~F.is_valid_utf8(raw)
    return odd


def mime_parser(decode: bool):
    """Arrow UDF over the standard mail parser: bytes in, ``struct<ok, subject, body>`` out.

    Defined inside a function, so that executors receive its code and need no package.
    """

    def parse(raws: pd.Series) -> pd.DataFrame:
        def plain_text(message):
            kinds = ((part.get_content_type(), part) for part in message.walk())
            payloads = (part.get_payload(decode=True) for kind, part in kinds if kind == "text/plain")
            return "".join(p.decode(errors="ignore") for p in payloads if p)

        def one(raw):
            if raw is None:
                return False, None, None
            try:
                if decode:
                    message, missing = email.message_from_bytes(raw), None
                else:
                    message, missing = email.message_from_string(raw.decode()), ""
                subject = message.get("Subject", missing)
                if message.is_multipart():
                    body = plain_text(message)
                elif decode:
                    body = message.get_payload(decode=True).decode(errors="ignore")
                else:
                    body = str(message.get_payload() or "")
                return True, subject if subject is None else str(subject), body
            except Exception:  # one unreadable mail must not end the job
                return False, None, None

        return pd.DataFrame([one(raw) for raw in raws], columns=["ok", "subject", "body"])

    return F.pandas_udf(parse, "ok boolean, subject string, body string")
