"""Quality rules as weak supervision: votes, learned accuracies, posterior quality."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import UPPER, LOWER, id_and_text, map_rows, window_hashes, word_hashes
from mailsift.sources.scratch import land

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30

_LETTERS = (UPPER + LOWER).encode()
_UTF8_MORE = bytes(range(128, 192))  # continuation bytes
_SPACES = b" \t\n\x0b\x0c\r"
_ENDINGS = (b".", b"!", b"?", b":", b";", b'"', b")")

FEATURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_ended bigint, n_distinct bigint, n_top bigint, "
    "n_run bigint, n_letters bigint, n_upper bigint, n_marks bigint, n_bare bigint"
)


def without(data: bytes, some: bytes) -> int:
    """How many bytes of ``some`` there are."""
    return len(data) - len(data.translate(None, some))


def repeated_words(windows: np.ndarray, n_words: int, width: int) -> int:
    """Words that lie in a window found twice or more, its first place included."""
    if n_words < width:
        return 0
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    edges = np.zeros(n_words + 1, np.int64)
    again = np.flatnonzero(count[place] > 1)
    edges[again] += 1
    np.add.at(edges, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text that the rules vote on; one pass, no shuffle."""

    def make():
        hashes = word_hashes()

        def row(i, value):
            data = (value or "").encode()
            words = data.split()
            lines = [x for x in data.split(b"\n") if x.strip()]
            h = hashes.of(words)
            _, times = np.unique(h, return_counts=True)
            same = np.flatnonzero(np.diff(h) != 0)
            ends = np.concatenate(([-1], same, [len(h) - 1]))
            yield (
                i,
                len(words),
                len(data) - without(data, _UTF8_MORE + _SPACES),
                without(data, SYMBOLS),
                len(lines) - len(set(lines)),
                repeated_words(window_hashes(h, WINDOW), len(words), WINDOW),
                len(lines),
                sum(x.rstrip().endswith(_ENDINGS) for x in lines),
                len(times),
                int(times.max()) if len(times) else 0,
                int(np.diff(ends).max()) if len(h) else 0,
                without(data, _LETTERS) + _wide_letters(data),
                without(data, UPPER.encode()),
                data.count(b"!"),
                data.count(b" | ") + data.count(b" - "),
            )

        return row

    return map_rows(id_and_text(docs, key, text), ["id", "text"], make, FEATURES)


def _wide_letters(data: bytes) -> int:
    """Code points beyond ASCII, which prose has as letters."""
    return without(data, bytes(range(192, 256)))


@dataclass(frozen=True)
class Rule:
    """Votes good (1), bad (-1) or abstains (0) on the measured columns."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]

    def vote(self) -> Column:
        # A rule whose condition is null abstains.
        return F.when(self.bad(), -1).when(self.good(), 1).otherwise(0).cast("int")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) > 0, F.col(b))


def _between(c: Column, low: float, high: float) -> Column:
    return (c >= low) & (c <= high)


#: Several rules look at each kind of junk, so that their agreement can be learned from.
RULES = (
    Rule("length", lambda: F.col("n_words") >= 40, lambda: F.col("n_words") < 10),
    Rule(
        "word_length",
        lambda: _between(_share("word_chars", "n_words"), 3, 9),
        lambda: ~_between(_share("word_chars", "n_words"), 2, 14),
    ),
    Rule(
        "symbols",
        lambda: _share("n_symbols", "n_words") <= 0.02,
        lambda: _share("n_symbols", "n_words") > 0.1,
    ),
    Rule(
        "letters",
        lambda: _share("n_letters", "word_chars") >= 0.92,
        lambda: (F.col("n_words") >= 40) & (_share("n_letters", "word_chars") < 0.8),
    ),
    Rule("bars", lambda: _share("n_bare", "n_words") <= 0.02, lambda: _share("n_bare", "n_words") > 0.15),
    Rule(
        "capitals",
        lambda: _share("n_upper", "n_letters") <= 0.1,
        lambda: _share("n_upper", "n_letters") > 0.3,
    ),
    Rule("marks", lambda: _share("n_marks", "n_words") <= 0.05, lambda: _share("n_marks", "n_words") > 0.2),
    Rule(
        "repeats",
        lambda: _share("n_repeat_words", "n_words") <= 0.1,
        lambda: _share("n_repeat_words", "n_words") > 0.3,
    ),
    Rule(
        "lines",
        lambda: _share("n_dup_lines", "n_lines") <= 0.1,
        lambda: _share("n_dup_lines", "n_lines") > 0.3,
    ),
    Rule(
        "variety",
        lambda: (F.col("n_words") >= 40) & (_share("n_top", "n_words") <= 0.12),
        lambda: (F.col("n_words") >= 40) & (_share("n_top", "n_words") > 0.25),
    ),
    Rule("runs", lambda: F.col("n_run") <= 3, lambda: F.col("n_run") >= 6),
    Rule(
        "endings",
        lambda: _share("n_ended", "n_lines") >= 0.6,
        lambda: (F.col("n_lines") >= 4) & (_share("n_ended", "n_lines") < 0.2),
    ),
)


@dataclass(frozen=True)
class LabelModel:
    """Chance of each vote given quality, as learned by expectation-maximisation."""

    prior: float  # of good documents
    good: tuple[tuple[float, float, float], ...]  # per rule: bad vote, abstention, good vote
    junk: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Chance that a document with these votes is good."""
        odds = math.log(self.prior) - math.log1p(-self.prior)
        for vote, good, junk in zip(votes, self.good, self.junk):
            if vote:  # abstaining says nothing about quality
                weight = math.log(good[vote + 1]) - math.log(junk[vote + 1])
                # Rules are taken to be no worse than chance.
                odds += vote * max(0.0, vote * weight)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


#: Where learning starts, and counts as so many documents of each class: most text is
#: good, rules rarely speak against good text, and junk offends some rules, not all.
START = LabelModel(0.9, ((0.01, 0.09, 0.9),) * len(RULES), ((0.3, 0.2, 0.5),) * len(RULES))
WEIGHT = 5.0


def learn(patterns: dict[tuple[int, ...], int], rounds: int = 50, start: LabelModel = START) -> LabelModel:
    """Estimate the accuracies of the rules from how often each pattern of votes occurs.

    Each round weighs the patterns by the posterior under the present model and takes the
    weighted shares of votes, with the starting model as so many further documents.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array(keys, int).reshape(len(keys), len(start.good)) + 1
    seen = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    model = start
    for _ in range(rounds):
        p = np.array([model.posterior(k) for k in keys])
        tables = []
        for weight, before in ((n * p, start.good), (n * (1 - p), start.junk)):
            counts = np.einsum("p,prv->rv", weight, seen) + WEIGHT * np.array(before)
            tables.append(counts / counts.sum(axis=1, keepdims=True))
        prior = ((n * p).sum() + WEIGHT * start.prior) / (n.sum() + WEIGHT)
        good, junk = (tuple(map(tuple, t.tolist())) for t in tables)
        model = LabelModel(float(min(max(prior, 1e-6), 1 - 1e-6)), good, junk)
    return model


def judge_quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Measured counts of every text, its votes, and the posterior chance that it is good.

    Columns: those of ``measure``, ``votes`` (array of -1, 0, 1 in the order of
    ``rules``), ``quality`` (0 to 1), ``base_failed`` and ``kept``. A text fails the base
    with fewer than 20 words, or when over 30 % of its words lie in 8-word windows that
    recur; of the others, those with ``quality`` of at least ``least`` are kept. No rule
    decides alone: what a vote is worth is learned from all documents.

    Texts are read once. Their votes are grouped to patterns, of which there are at most
    3 to the power of the rules, each with a count; the model is learned from these counts
    on the driver and its posteriors join back by pattern.

    Null, empty and blank texts have no words and fail the base. Repeated rows and null
    ids count and come out like all others; an empty table gives no rows; extra columns
    are not read.
    """
    spark = docs.sparkSession
    votes = F.array(*[r.vote() for r in rules]).alias("votes")
    voted = land(measure(docs, key, text).select("*", votes), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = Counter({tuple(r.votes): r.n for r in counted})
    start = START if rules is RULES else LabelModel(
        START.prior, START.good[:1] * len(rules), START.junk[:1] * len(rules)
    )
    model = learn(patterns, start=start)
    quality = spark.createDataFrame(
        [(list(k), model.posterior(k)) for k in sorted(patterns)], "votes array<int>, quality double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    return (
        voted.join(F.broadcast(quality), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= least))
    )
