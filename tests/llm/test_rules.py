import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mailsift.llm import rules
from mailsift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


def test_base_counts(docs_of, odd_texts, prose):
    pairs = [*enumerate(odd_texts), (None, "null id"), (7, "don't"), (7, "don't")]
    passage = prose(9, 9)
    pairs += [(100, f"{passage} {prose(1, 30)}\n{passage} é {passage}"), (101, "a b " * 40), (102, prose(4, 5000))]
    pairs += [(103, "x # y\n x # y\nx # y\n\n\n| & |")]
    got = rules.judge_quality(docs_of(pairs)).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter((i, *base(t)) for i, t in pairs)
    assert not any(r.kept and r.base_failed for r in got)


def test_empty_table(docs_of):
    assert rules.judge_quality(docs_of([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.integers(1, 5))
def test_repeated_words(words, width):
    h = np.array([ord(c) for c in words], np.uint64)
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    counts = Counter(windows)
    again = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + width)}
    got = rules.repeated_words(rules.window_hashes(h, width), len(words), width)
    assert got == len(again)


def test_accuracies_are_learned():
    rnd = np.random.default_rng(1)
    good = rnd.random(20_000) < 0.85
    # Two rules that see junk half of the time, one that only guesses.
    chances = [((0.01, 0.09, 0.9), (0.5, 0.2, 0.3))] * 2 + [((0.3, 0.4, 0.3), (0.3, 0.4, 0.3))]
    votes = [
        np.where(good, rnd.choice([-1, 0, 1], len(good), p=g), rnd.choice([-1, 0, 1], len(good), p=j))
        for g, j in chances
    ]
    start = rules.LabelModel(0.9, ((0.05, 0.15, 0.8),) * 3, ((0.3, 0.3, 0.4),) * 3)
    model = rules.learn(Counter(zip(*(v.tolist() for v in votes))), rounds=300, start=start)
    assert model.posterior((1, 1, -1)) > 0.8 and model.posterior((-1, -1, 1)) < 0.2
    assert abs(model.prior - 0.85) < 0.1


def test_an_abstaining_rule_says_nothing():
    model = rules.START
    assert model.posterior((0,) * 12) == model.posterior(()) or abs(model.posterior((0,) * 12) - model.prior) < 1e-9


def test_junk_goes_and_clean_text_stays(docs_of, prose):
    clean = [(i, ".\n".join(prose(100 * i + k, 20) for k in range(6)) + ".") for i in range(300)]
    words = [prose(k, 200).split() for k in range(40)]
    junk = [" ".join(w + "%%%" for w in words[i]) if i % 2 else " ".join(w.upper() + "!!" for w in words[i]) for i in range(40)]
    out = {r.doc_id: r.kept for r in rules.judge_quality(docs_of(clean + [(1000 + i, t) for i, t in enumerate(junk)])).collect()}
    assert all(out[i] for i, _ in clean) and not any(out[1000 + i] for i in range(40))


def test_query_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = QUERIES["op10_quality_rules"](spark, sf).filter("not base_failed").select("doc_id", "kept")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    shares = labels.join(kept, "doc_id").selectExpr("quality", "int(kept) AS k").groupBy("quality").avg("k")
    share = {r["quality"]: r["avg(k)"] for r in shares.collect()}
    assert share[1] > 0.98 and share[0] < 0.2
