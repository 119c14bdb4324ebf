import random
import re
from collections import defaultdict

import numpy as np
import pytest

from checks.compare import connect, difference
from mailsift.llm import minhash
from mailsift.llm.components import components
from mailsift.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(pairs, width, percent):
    sets = defaultdict(list)
    for i, text in pairs:
        sets[i].append(shingles(text, width))
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids for x in sets[a] for y in sets[b]
        if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    found = least_reachable(ids, links)
    return sorted((i, len(shingles(t, width)), found[i], found[i] == i) for i, t in pairs)


def edited(text, n, seed):
    rnd, words = random.Random(seed), text.split()
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(docs_of, odd_texts, prose, width):
    pairs = [(1000 + i, t) for i, t in enumerate(odd_texts)]
    for g in range(6):
        base = prose(g, 60 + 30 * g)
        pairs += [(100 * g + k, edited(base, k % 4, 7 * g + k)) for k in range(12)]
        pairs += [(100 * g + 50 + k, base.upper() if k % 2 else base) for k in range(6)]
    # A chain: each is like the next, the ends are not alike.
    words = prose(77, 300).split()
    pairs += [(700 + k, " ".join(words[12 * k : 12 * k + 150])) for k in range(12)]
    pairs += [(900, "two words"), (901, "Two  Words\n"), (902, "two words more"), (903, "two words"), (903, "two words")]
    got = minhash.near_duplicates(docs_of(pairs), minhash.Scheme(words=width)).collect()
    assert sorted(map(tuple, got)) == brute(pairs, width, 80)


def test_null_ids(docs_of):
    pairs = [(None, "a b c d e"), (5, "a b c d e"), (None, "other words"), (None, None), (7, "x")]
    got = {tuple(r) for r in minhash.near_duplicates(docs_of(pairs)).collect()}
    assert got == {(None, 1, 5, False), (5, 1, 5, True), (None, 1, None, True), (None, 0, None, True), (7, 1, 7, True)}


def test_empty_table(docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_bridges_are_found_beyond_the_stars(spark, docs_of, prose):
    """The first of a bucket is like none of the rest, which are like each other."""
    base = prose(5, 400)
    far = edited(base, 40, 1)  # shares bands with the others, but is under the threshold
    pairs = [(0, far)] + [(1 + k, edited(base, 2, 100 + k)) for k in range(30)]
    got = minhash.near_duplicates(docs_of(pairs), minhash.Scheme(words=4)).collect()
    assert sorted(map(tuple, got)) == brute(pairs, 4, 80)


def test_a_large_group_of_near_copies_makes_few_pairs(spark, docs_of, prose):
    base = prose(8, 300)
    pairs = [(k, edited(base, 1, k)) for k in range(300)]
    scheme = minhash.Scheme(words=4)
    signed = minhash.signatures(docs_of(pairs).selectExpr("doc_id AS id", "text"), scheme)
    buckets = minhash._bucketed(signed).groupBy("bucket").agg({"id": "min", "*": "count"})
    buckets = buckets.withColumnsRenamed({"min(id)": "leader", "count(1)": "n"}).filter("n > 1").drop("n")
    stars = minhash.star_pairs(signed, buckets, scheme)
    assert stars.count() < 300 * scheme.bands
    found = components(stars)
    bridges = minhash.bridge_pairs(signed, buckets, found, scheme)
    assert found.select("component").distinct().count() == 1 and bridges.count() == 0


def test_estimates_follow_similarity():
    rnd, scheme = np.random.default_rng(3), minhash.Scheme()
    signer = minhash.Signer(scheme)
    agree, odd = [], []
    for _ in range(200):
        common, a, b = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = (signer.samples(np.concatenate((common, own))) for own in (a, b))
        agree.append((x == y).mean())
        sketches = (signer.sketch(x) ^ signer.sketch(y)).view(np.uint8)
        odd.append(int(np.unpackbits(sketches).sum()))
    assert abs(np.mean(agree) - 0.8) < 0.02
    n, bits = scheme.samples, scheme.sketch_bits
    assert abs(np.mean(odd) - bits / 2 * (1 - (1 - 2 / bits) ** (2 * n * 0.2))) < 2
    assert max(odd) <= scheme.most_odd_bits() < bits / 2


def test_long_sets_are_signed_in_blocks():
    signer = minhash.Signer(minhash.Scheme())
    hashes = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    whole = (hashes[None] * signer.factor + signer.shift).min(axis=1)
    assert (signer.samples(hashes) == whole).all()


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rnd = random.Random(seed)
    shapes = [
        [(i, i + 1) for i in range(200)],
        [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)],
        [(999, i) for i in range(100)] + [(5, 5), (7, 8), (8, 7), (7, 8)],
        [],
    ]
    links = shapes[seed]
    ids = {i for link in links for i in link}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == least_reachable(sorted(ids), links) and len(got) == len(ids)


def test_query_equals_sql(spark, sf):
    assert difference(QUERIES["op1_minhash_dedup"](spark, sf), connect(sf), ORACLE["op1_minhash_dedup"]) is None


def test_few_hashes_of_words_are_kept(monkeypatch):
    from mailsift.llm import common

    words = [b"%d" % (i % 150) for i in range(1000)]
    expected = common.WordHashes().of(words).tolist()
    monkeypatch.setattr(common, "WORD_HASHES", 100)
    hashes = common.WordHashes()
    assert hashes.of(words).tolist() == expected and len(hashes) <= 100
