import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mailsift.llm import token_files
from mailsift.llm.queries import QUERIES
from mailsift.sources.scratch import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(pairs):
    """``doc_id, start, n_tokens, ids_crc32`` of (doc_id, text) pairs in the order given."""
    start, out = 0, []
    for i, text in pairs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, docs, block):
    path = scratch_path(spark, "test-token-files")
    token_files.write_tokens(docs, PATH, path, block=block)
    rows = sorted(map(tuple, token_files.read_documents(spark, path).collect()), key=lambda r: r[1])
    shards = spark.read.parquet(path).orderBy("part", "part_start").collect()
    return rows, [token_files.Shard(bytes(r.payload)) for r in shards]


@pytest.mark.parametrize("block", [token_files.BLOCK, 50])
def test_files_hold_the_ids_of_the_library(spark, docs_of, odd_texts, prose, block):
    pairs = [*enumerate(odd_texts), *((100 + i, prose(i, 60 * i)) for i in range(12))]
    rows, shards = read(spark, docs_of(pairs), block)
    assert rows == expected(pairs)
    by_id = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for i, t in pairs}
    assert [i for s in shards for i in s.doc_ids] == [i for i, _ in pairs]
    for s in shards:
        assert len(s.blocks) == max(1, -(-int(s.tokens[-1]) // block))
        for place, i in enumerate(s.doc_ids):
            assert s.ids(place).tolist() == by_id[i]


def test_any_tokens_of_a_document_without_the_rest(prose):
    rnd = random.Random(2)
    texts = [prose(s % 3, 400 * s) for s in range(1, 6)]
    ids = [LIBRARY.encode(t).ids + [0] for t in texts]
    shard = token_files.Shard(
        token_files.write_shard([1, None, 3, 4, 5], [len(x) for x in ids], np.array(sum(ids, []), np.uint32), block=700)
    )
    assert shard.doc_ids == [1, None, 3, 4, 5] and len(shard.blocks) > 3
    for _ in range(300):
        doc = rnd.randrange(5)
        start, stop = rnd.randint(0, len(ids[doc])), rnd.randint(0, len(ids[doc]) + 5)
        assert shard.ids(doc, start, stop).tolist() == ids[doc][start:stop]
    assert shard.ids(2, -5).tolist() == ids[2][-5:]


@pytest.mark.parametrize("alphabet", [1, 2, 5, 300, 2**32])
def test_grammars_expand_to_what_they_were_made_of(alphabet):
    rnd = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 3, 50, 5000):
        ids = rnd.integers(0, alphabet, n).astype(np.uint32)
        ends = np.flatnonzero(rnd.random(n) < 0.02)
        symbols, stops, rules, terminals = token_files.compress(ids, ends)
        lengths = token_files.expansion_lengths(rules, len(terminals))
        assert token_files.expand(symbols, rules, terminals, lengths).tolist() == ids.tolist()
        few = symbols[:3]
        assert token_files.expand(few, rules, terminals, lengths).tolist() == ids[: lengths[few].sum()].tolist()
        # No rule goes beyond the end of a document, and rules use earlier symbols only.
        assert (np.cumsum(lengths[symbols])[stops] - 1).tolist() == ends.tolist()
        assert all(max(pair) < len(terminals) + i for i, pair in enumerate(rules.tolist()))


def test_many_different_ids():
    ids = np.concatenate([np.arange(40_000), np.tile([7, 8, 9], 20_000)]).astype(np.uint32)
    symbols, _, rules, terminals = token_files.compress(ids, np.empty(0, np.int64))
    lengths = token_files.expansion_lengths(rules, len(terminals))
    assert len(rules) and len(symbols) < 60_000
    assert (token_files.expand(symbols, rules, terminals, lengths) == ids).all()


def test_frequent_pairs_are_gone():
    words = [list(range(10 * w, 10 * w + 6)) for w in range(4)]
    rnd = random.Random(3)
    ids = np.array(sum((rnd.choice(words) for _ in range(2000)), []), np.uint32)
    symbols, _, rules, _ = token_files.compress(ids, np.empty(0, np.int64))
    assert len(symbols) < len(ids) / 6 and len(rules) >= 20


def test_ties_nulls_and_repeated_rows(spark, docs_of):
    pairs = [(None, "a b"), (None, None), (2, "x"), (2, "y"), (2, "x"), (1, None), (3, "")]
    rows, _ = read(spark, docs_of(pairs), 4)
    assert [r[0] for r in rows] == [None, None, 1, 2, 2, 2, 3]
    ends = [(r[1], r[1] + r[2]) for r in rows]
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    plain = {(i, n, c) for i, _, n, c in expected(pairs)}
    assert {(i, n, c) for i, _, n, c in rows} == plain
    assert read(spark, docs_of([]), 4) == ([], [])


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(map(tuple, QUERIES["op11_token_files"](spark, sf).collect()))
    assert got == expected(map(tuple, rows))


def test_ids_do_not_depend_on_the_words_that_are_kept(prose):
    from mailsift.llm.packing import Encoded

    texts = [prose(i, 40) for i in range(20)]
    for entries in (4, token_files.CACHE_WORDS):
        encoded = Encoded(PATH, entries)
        assert [np.frombuffer(encoded.encode(t), "<u4").tolist() for t in texts] == [LIBRARY.encode(t).ids for t in texts]
        assert len(encoded) <= entries and (entries == 4 or len(encoded) > 100)


@pytest.mark.parametrize("run_bytes", [1, 7, 100, token_files.RUN_BYTES])
def test_words_of_a_run_have_the_ids_of_the_library(monkeypatch, odd_texts, prose, run_bytes):
    monkeypatch.setattr(token_files, "RUN_BYTES", run_bytes)
    texts = [t or "" for t in odd_texts] + ["", " a", "a", " a b  c  d ", "b<|endoftext|> a b", "q" * 1200 + " a b"]
    texts += ["", " “a” 　x 中 ", "\x00 \x00a", *(prose(i, 30) for i in range(4)), ""]
    expected = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    words = token_files.Words(PATH)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before", *texts, "after"], kind).slice(1, len(texts))
        assert [ids.tolist() for ids in words.encode(column)] == expected
    assert list(words.encode(pa.array([], pa.string()))) == []


def test_a_word_of_a_run_is_encoded_once(prose):
    """However often words come back and whatever came before, a run encodes each of them once."""
    words, encoded = token_files.Words(PATH), []
    plain = words.encoded.merged
    words.encoded.merged = lambda text: encoded.append(text) or plain(text)
    texts = [prose(i, 200) for i in range(50)]
    for _ in range(2):
        encoded.clear()
        assert [ids.tolist() for ids in words.encode(pa.array(texts))] == [LIBRARY.encode(t).ids for t in texts]
        different = {w for t in texts for w in t.split(" ")}
        assert sum(map(len, encoded)) <= sum(len(w) + 1 for w in different) + sum(len(t.split(" ")[0]) + 1 for t in texts)
        assert len(encoded) <= 1 + len(texts)


def test_a_vocabulary_whose_ids_are_not_ranks(tmp_path, prose, odd_texts):
    with open(PATH, encoding="utf-8") as file:
        data = json.load(file)
    data["added_tokens"] = []
    last = max(data["model"]["vocab"].values())
    data["model"]["vocab"] = {token: last - i for token, i in data["model"]["vocab"].items()}
    path = str(tmp_path / "turned.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(data, file)
    texts = [*(t or "" for t in odd_texts), prose(1, 50)]
    library = Tokenizer.from_file(path)
    got = [ids.tolist() for ids in token_files.Words(path).encode(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_spaces_at_the_end_of_a_text_stay_together(tmp_path):
    """Two spaces are one id here, so a cut between them would show."""
    with open(PATH, encoding="utf-8") as file:
        data = json.load(file)
    for token in data.pop("added_tokens"):
        data["model"]["vocab"].pop(token["content"], None)
    data["added_tokens"] = []
    data["model"]["vocab"]["ĠĠ"] = 256 + len(data["model"]["merges"])
    data["model"]["merges"].append("Ġ Ġ" if isinstance(data["model"]["merges"][0], str) else ["Ġ", "Ġ"])
    path = str(tmp_path / "spaces.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(data, file)
    texts = ["a  ", "b", " c  ", " ", "  ", "   d   e", "", "f  ", "", "g   h"]
    library, words = Tokenizer.from_file(path), token_files.Words(path)
    assert words.encoded.merged != words.encoded._by_library and len(library.encode("a  ").ids) == 2
    assert [ids.tolist() for ids in words.encode(pa.array(texts))] == [library.encode(t).ids for t in texts]
