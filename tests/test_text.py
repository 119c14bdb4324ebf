import random
import re

import pytest
from pyspark.sql import functions as F

from mailsift.functions import text
from mailsift.functions.chat import CLASSIFIER_TEMPLATE

ODD = ["\t", "\x0b", "\x0c", "\r", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ",
       " ", " ", " ", "　"]
KEPT = ["​", "﻿", "\x00", "\x1b", "᠎", "⁠"]


def test_whitespace_class_is_exactly_pythons(column_of):
    chars = [chr(c) for c in [*range(1, 0x3100), 0xFEFF, 0x1F600] if not 0xD800 <= c < 0xE000]
    made = column_of(lambda c: F.regexp_replace(c, text.WS + "++", "blank"), chars)
    assert [c for c, m in zip(chars, made) if m == "blank"] == [c for c in chars if re.fullmatch(r"\s", c)]


def test_squash_ws_like_python(column_of):
    rng = random.Random(7)
    values = ["", " ", "a", " a  b "] + [
        "".join(rng.choice(["a", "é", "😀", " ", *ODD, *KEPT]) for _ in range(rng.randint(0, 30)))
        for _ in range(400)
    ]
    expected = [re.sub(r"\s+", " ", v).strip(" ") for v in values]
    assert column_of(text.squash_ws, values) == expected


def test_strip_ws_like_python(column_of):
    rng = random.Random(9)
    values = ["", " ", "a", " a  b ", " " * 200000 + "x" + " " * 200000 + "y"] + [
        "".join(rng.choice(["a", "é", " ", *ODD, *KEPT]) for _ in range(rng.randint(0, 12))) for _ in range(300)
    ]
    assert column_of(text.strip_ws, values) == [v.strip() for v in values]


def strip_by_scanning(subject):
    mark, at = re.compile(r"(?i)(?:fwd|fw|re)\s*:\s*"), 0
    while found := mark.match(subject, at):
        at = found.end()
    return subject[at:]


def test_reply_prefix_to_fixpoint(column_of):
    rng = random.Random(8)
    values = ["RE: Fwd : fw:re:Re[2]: hello", " Re: x", "Re", "Re:", "Regarding: x", "re　:\xa0FW:x",
              "x Re: y", "\nRe: z", "re :\nfwd:\r\n re: k", "re: " * 20000 + "end"]
    parts = ["re", "RE", "fw", "Fwd", ":", " ", "\xa0", "x", "["]
    values += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert column_of(text.strip_reply_prefix, values) == [strip_by_scanning(v) for v in values]


def test_clean_subject_orders_prefix_before_whitespace(column_of):
    values = [None, "", "Re: a\tb ", " Re: a", "folded\n line"]
    stripped = column_of(lambda c: text.clean_subject(c, True), values)
    assert stripped == ["", "", "a b", "Re: a", "folded line"]
    assert column_of(text.clean_subject, values)[2] == "Re: a b"


def test_length_counts_code_points(column_of):
    assert column_of(text.n_chars, ["😀é", ""]) == [2, 0]


def test_label_word(spark, column_of):
    assert column_of(text.label_word, ["1", " 1\n", "0", "", None, "01", "phishing"]) == [
        "phishing", "phishing", "legitimate", "legitimate", "legitimate", "legitimate", "legitimate"]
    df = spark.createDataFrame([(1,), (0,), (None,)], "label int")
    assert [r[0] for r in df.select(text.label_word(F.col("label"))).collect()] == [
        "phishing", "legitimate", "legitimate"]


def test_compact_text_lengths(column_of):
    short, long = "x" * 6000, "a" * 3900 + "-" * 5000 + "z" * 1500
    kept, cut = column_of(text.compact_text, [short, long])
    assert kept == short
    assert cut == "a" * 3900 + "\n\n[...truncated...]\n\n" + "z" * 1500
    with pytest.raises(ValueError):
        text.compact_text(F.col("x"), 3)


def test_template_is_filled_once(spark):
    df = spark.createDataFrame([("{body}", "b {subject}"), (None, None)], "s string, b string")
    filled = text.fill_template(CLASSIFIER_TEMPLATE, F.col("s"), F.col("b"))
    rows = [r[0] for r in df.select(filled).collect()]
    assert rows[0].endswith("User:\nSubject: {body}\nBody: b {subject}\n")
    assert rows[1].endswith("User:\nSubject: \nBody: \n")


def test_na_tokens(column_of):
    values = ["None", "none", "NA", "x", "", None]
    assert column_of(lambda c: text.apply_na_tokens(c, ["None", "NA"]), values) == [
        None, "none", None, "x", "", None]
    assert column_of(lambda c: text.apply_na_tokens(c, None), values) == values
