import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailsift.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODED = packing.Encoded(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(pairs, rows, length):
    """Every id in one piece, sequences without gaps, none too long."""
    left = Counter()
    for i, text in pairs:
        ids = ids_of(text)
        for start in range(0, len(ids), length):
            piece = np.array(ids[start : start + length], "<u4")
            left[(i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert left == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= length
    return len(sequences)


def test_round_trip(docs_of, odd_texts, prose):
    pairs = [*enumerate(odd_texts), (None, "null id"), (5, "twice"), (5, "twice"), (900, prose(2, 4000))]
    pairs += [(100 + i, prose(i, 10 + 7 * i)) for i in range(60)] + [(300 + i, "same words") for i in range(80)]
    n = check(pairs, packing.pack(docs_of(pairs), PATH, length=256).collect(), 256)
    tokens = sum(len(ids_of(t)) for _, t in pairs)
    assert n <= tokens / 256 * 1.05 + 1


def test_result_does_not_depend_on_partitions(docs_of, prose):
    pairs = [(i, prose(i % 20, 40)) for i in range(100)]
    one, other = (
        sorted(map(tuple, packing.pack(docs_of(pairs, parts), PATH, length=128).collect())) for parts in (1, 7)
    )
    assert one == other


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.patterns_of(histogram, 64)
    held = Counter()
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for size in pattern:
            held[size] += n
    assert held == Counter(histogram)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=12))
def test_patterns_equal_placing_one_by_one(histogram):
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [i for i, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[max(fits, key=lambda i: rooms[i])] -= size
            else:
                rooms.append(20 - size)
    ours = [20 - sum(p) for p, n in packing.patterns_of(histogram, 20) for _ in range(n)]
    assert len(ours) == len(rooms) or abs(len(ours) - len(rooms)) <= 1


def test_slots_cover_every_rank():
    rnd = random.Random(3)
    histogram = {rnd.randint(1, 2048): rnd.randint(1, 10**9) for _ in range(500)}
    at = Counter()
    for size, first, n, _, _ in sorted(packing.slots_of(packing.patterns_of(histogram))):
        assert first == at[size]
        at[size] += n
    assert at == Counter(histogram)


def test_encoding_equals_the_library(prose, odd_texts):
    encoded = packing.Encoded(PATH)
    for text in [*filter(None, odd_texts), prose(3, 500), " ".join(prose(i, 3) for i in range(50))]:
        assert np.frombuffer(encoded.encode(text), "<u4").tolist() == ids_of(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'stlreab1.,\u00a0\u3000\u00e9\x1c\x85", max_size=40))
def test_any_text_is_encoded_as_by_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(ENCODED.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_long_strings_go_to_the_library(prose):
    text = "a" * 5000 + " " * 5000 + prose(1, 5) + "\n" * 3000 + "!" * 4000
    assert np.frombuffer(ENCODED.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_a_full_cache_forgets_and_goes_on(prose, monkeypatch):
    monkeypatch.setattr(packing, "SMALL_CACHE_ENTRIES", 300)
    encoded = packing.Encoded(PATH)
    for seed in range(20):
        text = prose(seed, 150)
        assert np.frombuffer(encoded.encode(text), "<u4").tolist() == ids_of(text)[:-1]
    assert len(encoded) <= 300


def test_plain_texts_need_no_second_library(prose):
    encoded = packing.Encoded(PATH)
    encoded.encode(prose(1, 50))
    assert "tokenizer" not in vars(encoded)
    special = "a <|endoftext|> b"
    assert np.frombuffer(encoded.encode(special), "<u4").tolist() == ids_of(special)[:-1]
    assert sorted(encoded.special) == sorted(t.content for t in LIBRARY.get_added_tokens_decoder().values())
