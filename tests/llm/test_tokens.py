import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailsift.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
count = tokens.counter(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts(spark, docs_of, odd_texts):
    pairs = [*enumerate(odd_texts), (None, "null id"), (1, ""), (1, "")]
    got = tokens.count_tokens(docs_of(pairs), PATH, limit=100).collect()
    expected = [(i, len((t or "").encode()), library(t), library(t) > 100) for i, t in pairs]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_empty_table(docs_of):
    assert tokens.count_tokens(docs_of([]), PATH).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'stlreab1., 　é", max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert count(text) == library(text)


def test_long_texts_are_counted_lazily_but_alike(monkeypatch, prose):
    text = prose(1, 2000) + " " * 50 + "\n" + "q" * 5000 + " don't"
    expected = library(text)
    monkeypatch.setattr(tokens, "LONG_TEXT", 10)
    assert tokens.counter(PATH)(text) == expected


def test_heap_equals_repeated_scan():
    ranks = {("a", "b"): 0, ("b", "a"): 1, ("ab", "ab"): 2, ("a", "ab"): 3, ("abab", "a"): 4, ("b", "b"): 5}

    def scan(symbols):
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not pairs:
                return len(symbols)
            i = min(pairs)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rnd = random.Random(5)
    for _ in range(500):
        word = rnd.choices("ab", k=rnd.randint(0, 30))
        assert tokens.count_merged(list(word), ranks) == scan(list(word))


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_long_words_take_n_log_n(n):
    assert count("ab" * n) == library("ab" * n)


def test_a_full_cache_forgets_and_goes_on(prose, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 200)
    counted = tokens.counter(PATH)
    assert all(counted(t) == library(t) for t in (prose(s, 150) for s in range(20)))
