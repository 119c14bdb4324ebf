"""Scalar text cleaning and prompt text, as JVM-side column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode-aware `\s` stands for. Java's own `\s` covers
# only six of them, so every pattern spells the class out. Those below U+0100 are listed
# one by one, which Java turns into a table look-up; the rest sit behind one range test.
_RARE = r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}"
    rf"[\x{{1680}}-\x{{3000}}&&{_RARE}]]"
)

# Texts and proportions of a shortened prompt.
TRUNCATION_MARK = "\n\n[...truncated...]\n\n"
HEAD_SHARE = 0.65
TAIL_SHARE = 0.25


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    For expressions that mention an expensive value several times; in lazily evaluated
    branches Spark would otherwise compute it again for each mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fill_blank(c: Column) -> Column:
    """Missing text becomes the empty string."""
    return F.coalesce(c, F.lit(""))


def squash_ws(c: Column) -> Column:
    """Each run of Unicode whitespace becomes one blank; none at either end."""
    return F.trim(F.regexp_replace(c, WS + "++", " "))


def strip_ws(c: Column) -> Column:
    """No Unicode whitespace at either end; the inside stays as it is.

    The look-behind lets a run inside the text be tried once, not from each of its blanks.
    """
    return F.regexp_replace(c, rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def strip_reply_prefix(c: Column) -> Column:
    """Drop every leading ``re:`` / ``fw:`` / ``fwd:``, however they are stacked.

    Possessive quantifiers keep the Java matcher iterative, so a subject made of
    thousands of prefixes cannot exhaust its stack.
    """
    return F.regexp_replace(c, f"(?i)^(?:(?:re|fwd?){WS}*+:{WS}*+)++", "")


def clean_subject(c: Column, strip_prefix: bool = False) -> Column:
    c = fill_blank(c)
    return squash_ws(strip_reply_prefix(c) if strip_prefix else c)


def clean_body(c: Column) -> Column:
    return squash_ws(fill_blank(c))


def n_chars(c: Column) -> Column:
    """Length in code points."""
    return F.length(c)


def label_word(c: Column) -> Column:
    """``1`` (number or text, blanks allowed) is phishing, anything else legitimate."""
    is_one = squash_ws(c.cast("string")) == "1"
    return F.when(is_one, "phishing").otherwise("legitimate")


def mail_text(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Subject: "), fill_blank(subject), F.lit("\nBody: "), fill_blank(body))


def body_text(body: Column) -> Column:
    """A mail without a subject, as pasted into a form."""
    return F.concat(F.lit("Body: "), fill_blank(body))


def tagged_text(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("[SUBJECT] "), fill_blank(subject), F.lit(" [BODY] "), fill_blank(body))


def compact_text(c: Column, max_chars: int = 6000) -> Column:
    """Keep opening and ending of a text longer than ``max_chars``."""
    head, tail = int(max_chars * HEAD_SHARE), int(max_chars * TAIL_SHARE)
    if tail < 1:
        raise ValueError("max_chars must be at least 4, or no ending would be kept")
    shortened = F.concat(
        F.substring(c, 1, head), F.lit(TRUNCATION_MARK), F.right(c, F.lit(tail))
    )
    return F.when(F.length(c) > max_chars, shortened).otherwise(c)


def fill_template(template: str, subject: Column, body: Column) -> Column:
    """Put subject and body into a template with ``{subject}`` and ``{body}`` slots.

    The template is cut apart here, so a mail that itself contains ``{body}`` is
    never expanded a second time.
    """
    slots = {"{subject}": fill_blank(subject), "{body}": fill_blank(body)}
    pieces = [p for p in re.split(r"(\{subject\}|\{body\})", template) if p]
    return F.concat(*[slots[p] if p in slots else F.lit(p) for p in pieces])


def apply_na_tokens(c: Column, tokens: list[str] | None) -> Column:
    """Read the listed tokens as missing, for files written with such markers."""
    return F.when(~c.isin(list(tokens)), c) if tokens else c
