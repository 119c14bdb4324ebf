"""Prompts and training rows from mail tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import chat, text
from mailsift.operators.ordering import with_neighbours

# Column names a mail table may use, best first, and the display texts.
SUBJECT_NAMES = ("subject", "Subject", "title")
BODY_NAMES = ("email_text", "body", "text", "content")
NO_SUBJECT = "無主旨"
NO_BODY = "無內文"
SUBJECT_AS_BODY = "[系統智慧分析模式：已由主旨自動代入]\n"

# Words that mark a sentence as worth keeping in a shortened mail.
SENSITIVE_WORDS = (
    "account", "attachment", "bank", "confirm", "credential", "expire", "invoice", "login",
    "password", "payment", "suspend", "transfer", "urgent", "verify", "wire",
)
URL = r"(?i)(?:https?://|www\.)[^\s<>\"']+"


def add_messages(
    df: DataFrame,
    system: str = chat.TRAIN_SYSTEM,
    with_answer: bool = True,
    max_chars: int | None = None,
    body_only: bool = False,
) -> DataFrame:
    """Add ``messages``, the chat that asks about a mail, with the answer for training.

    ``body_only`` asks about the body alone; the subject is shown nowhere.
    """
    user = text.body_text(F.col("body")) if body_only else text.mail_text(F.col("subject"), F.col("body"))
    return df.withColumn(
        "messages",
        chat.chat_messages(
            F.col("subject"),
            F.col("body"),
            system,
            F.col("label") if with_answer else None,
            text.compact_text(user, max_chars) if max_chars else user,
        ),
    )


def render_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    add_cue: bool = False,
    tools: Sequence[dict] = (),
    default_system: str = chat.DEFAULT_SYSTEM,
    tool_calls: str | None = None,
) -> DataFrame:
    """Render a table with one row per turn; every row gives its ``piece`` of the chat.

    Pieces of a conversation in turn order, put end to end, are the rendered chat. No
    conversation is gathered anywhere, so its length does not matter. ``tool_calls`` names
    a column of ``array<struct<name, arguments>>`` with the calls of assistant turns.
    """
    placed = with_neighbours(df, conversation, turn, role)
    start = chat.opening(F.col(role), F.col(content), tools, default_system)
    own = chat.turn_text(
        F.col(role),
        F.col(content),
        F.col("previous"),
        F.col("next"),
        F.col("is_first"),
        F.col(tool_calls) if tool_calls else None,
    )
    cue = f"{chat.TURN_START}assistant\n" if add_cue else ""
    piece = F.concat(
        F.when(F.col("is_first"), start).otherwise(""),
        own,
        F.when(F.col("is_last"), cue).otherwise(""),
    )
    return placed.select(conversation, turn, piece.alias("piece"))


def instruction_rows(df: DataFrame, instruction: str = chat.TRAIN_SYSTEM) -> DataFrame:
    """Instruction, input and output of each mail; ``write.json`` makes the training file."""
    return df.withColumns(
        {
            "instruction": F.lit(instruction),
            "input": text.mail_text(F.col("subject"), F.col("body")),
            "output": text.label_word(F.col("label")),
        }
    )


def instruction_json(df: DataFrame, instruction: str = chat.TRAIN_SYSTEM) -> DataFrame:
    rows = instruction_rows(df, instruction)
    record = F.to_json(F.struct("instruction", "input", "output"))
    return rows.withColumn("record", record).drop("instruction", "input", "output")


def resolve_mail_columns(df: DataFrame) -> DataFrame:
    """Name subject and body whatever they are called; without a body the subject serves."""
    subject_name = next((n for n in SUBJECT_NAMES if n in df.columns), None)
    body_name = next((n for n in BODY_NAMES if n in df.columns), None)
    subject = F.col(subject_name).cast("string") if subject_name else F.lit(NO_SUBJECT)
    body = F.col(body_name).cast("string") if body_name else F.lit(NO_BODY)
    stand_in = F.concat(F.lit(SUBJECT_AS_BODY), subject)
    body = F.when((body == NO_BODY) & (subject != NO_SUBJECT), stand_in).otherwise(body)
    others = [c for c in df.columns if c not in (subject_name, body_name)]
    return df.select(*others, subject.alias("subject"), body.alias("email_text"))


def mail_at(df: DataFrame, k: int, index: str = "index") -> DataFrame:
    """The mail at one position; none when the position is out of range."""
    return df.filter(F.col(index) == k)


def _neighbourhood(sentences: Column, wanted) -> Column:
    """Sentences that are wanted, or stand next to one that is, in their order."""

    def keep(hits: Column) -> Column:
        def near(i: Column) -> Column:
            around = [F.get(hits, i - 1), F.get(hits, i), F.get(hits, i + 1)]
            return F.exists(F.array(*around), lambda h: F.coalesce(h, F.lit(False)))

        return F.filter(sentences, lambda s, i: near(i))

    return text.let(F.transform(sentences, wanted), keep)


def compact_keep_links(
    subject: Column,
    body: Column,
    max_chars: int = 6000,
    words: Sequence[str] = SENSITIVE_WORDS,
) -> Column:
    """Shorten a long mail to what tells phishing apart.

    Kept are the subject, the opening and ending, and in between the sentences with a URL
    or a sensitive word together with their neighbours. A mail within ``max_chars`` stays
    as it is. Links and warnings are never dropped to meet the length.
    """
    head, tail = int(max_chars * text.HEAD_SHARE), int(max_chars * text.TAIL_SHARE)
    marked = f"{URL}|(?i)\\b(?:{'|'.join(words)})"

    def word_start(t: Column) -> Column:
        """Characters of ``t`` that belong to the word it opens with."""
        return F.length(F.regexp_extract(t, r"^\S*+", 0))

    def shortened(t: Column) -> Column:
        # Both cuts move outward to a blank, so that no link is cut in two.
        size = F.length(t)
        first = F.lit(head) + word_start(F.substring(t, F.lit(head + 1), size))
        last = size - tail - word_start(F.reverse(F.substring(t, F.lit(1), size - tail)))
        middle = F.substring(t, first + 1, F.greatest(last - first, F.lit(0)))
        kept = text.let(
            F.split(middle, r"(?<=[.!?\n])\s+"),
            lambda s: _neighbourhood(s, lambda x: x.rlike(marked)),
        )
        return F.concat(
            F.substring(t, F.lit(1), first),
            F.lit(text.TRUNCATION_MARK),
            F.array_join(kept, " "),
            F.lit(text.TRUNCATION_MARK),
            F.substring(t, F.greatest(first, last) + 1, size),
        )

    return text.let(
        text.mail_text(subject, body),
        lambda t: F.when(F.length(t) > max_chars, shortened(t)).otherwise(t),
    )
