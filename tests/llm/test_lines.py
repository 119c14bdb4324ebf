import hashlib
from collections import defaultdict

import pytest

from checks.compare import connect, difference
from mailsift.llm import lines
from mailsift.llm.queries import ORACLE, QUERIES

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACES))


def brute(pairs, least=40, documents=5):
    holders = defaultdict(list)
    for i, text in pairs:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, text in pairs:
        all_lines = (text or "").split("\n")
        stay = [
            x for x in all_lines
            if len(key(x)) < least or len(holders[key(x)]) < documents
            or i == max(h for h in holders[key(x)] if h is not None)
        ]
        kept = None if text is None else "\n".join(stay)
        out.append((i, kept, len(all_lines), len(all_lines) - len(stay)))
    return sorted(out, key=repr)


def check(docs_of, pairs):
    got = lines.drop_shared_lines(docs_of(pairs)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute(pairs)


def test_shared_lines(docs_of, prose, odd_texts):
    shared = [prose(k, 12) for k in range(4)]
    pairs = [*enumerate(odd_texts)]
    for i in range(100, 140):
        own = [prose(i, 15), shared[i % 4], f" {shared[(i + 1) % 4].upper()}\t", shared[0] if i % 9 else "short"]
        pairs.append((i, "\n".join(own * (1 + i % 2))))
    pairs += [(200 + i, "z" * n) for i, n in enumerate([39] * 6 + [40] * 4 + [41] * 5)]
    pairs += [(None, shared[0] + "\nlast")]
    check(docs_of, pairs)


def test_keeper_keeps_all_its_copies(docs_of):
    line = "x" * 40
    check(docs_of, [(i, f"{line}\n{i}\n{line}") for i in range(5)])


def test_four_documents_are_not_five(docs_of):
    line = "x" * 40
    check(docs_of, [(i, f"{line}\n{line}") for i in range(4)])


def test_columns_stay(docs_of):
    docs = docs_of([(1, "a\nb")])
    out = lines.drop_shared_lines(docs.withColumn("n_lines", docs.n))
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert out.first().asDict() == docs.first().asDict() | {"n_lines": 2, "n_dropped": 0}


def test_empty_table(docs_of):
    assert lines.drop_shared_lines(docs_of([])).collect() == []


def test_many_lost_lines_take_linear_time(docs_of):
    long = "\n".join(f"{n:040d}" for n in range(30_000))
    pairs = [(i, long + f"\n{i}") for i in range(5)]
    out = {r.doc_id: r for r in lines.drop_shared_lines(docs_of(pairs)).collect()}
    assert [out[i].text for i in range(5)] == ["0", "1", "2", "3", long + "\n4"]


@pytest.mark.parametrize("name", ["op3_line_dedup"])
def test_query_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None


def test_digest_of_a_text_is_that_of_its_bytes(spark, sf):
    texts = {r.doc_id: r.text for r in lines.drop_shared_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in QUERIES["op3_line_dedup"](spark, sf).collect():
        assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
