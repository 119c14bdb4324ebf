import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, part int"


@pytest.fixture
def docs_of(spark):
    """Documents of given (doc_id, text) pairs, with columns that clash with inner names."""

    def make(pairs, parts=3):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7, 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Made-up but fixed prose: prose(seed, words)."""
    import random

    syllables = "th on er in ea the ou an st ly ti nd re be ha wh sh for ing tion".split()

    def make(seed, words):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(words))

    return make


ODD_TEXTS = [
    None, "", " ", "\n", "\n\n  \t\n", "a", "é", "don't", "  two  spaces \n and\ttabs ", "\x1c\x85  x y ",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "12345 67,89 ½ ² Ⅷ", "日本語のテキスト", "a" * 3000, " " * 3000,
    "x \n y", "emoji 👩‍👩‍👧 ok", "\u0000nul", "!" * 500, "tail ", " head",
]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
