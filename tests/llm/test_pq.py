import hashlib
import math
import random

import numpy as np
import pytest

from checks.compare import connect, difference
from mailsift.llm import pq
from mailsift.llm.queries import ORACLE, QUERIES

ROWS = "vec_id long, embedding array<float>, label int, id string, code int"


def brute(rows, rounds=pq.ROUNDS):
    """Codes of (vec_id, vector, label) rows by comparing all with all, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    w = width // 4
    cut = [[v[p * w : (p + 1) * w] for v in whole] for p in range(4)]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[cut[p][i] for i in order[:256]] for p in range(4)]

    def assigned(p):
        out = []
        for q in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(q, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for q, (e, _) in zip(cut[p], assigned(p)):
                members.setdefault(e, []).append(q)
            for e, m in members.items():
                books[p][e] = [sum(column) // len(m) for column in zip(*m)]
    found = [assigned(p) for p in range(4)]
    errors = [sum(found[p][i][1] for p in range(4)) for i in range(len(kept))]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{found[p][k][0]:02x}" for p in range(4)), errors[k], labels[label], digest)
        for k, (i, _, label) in enumerate(kept)
    ]


@pytest.fixture
def coded(spark):
    def run(rows, parts=3):
        frame = spark.createDataFrame([(*r, "x", 7) for r in rows], ROWS).repartition(parts)
        return sorted(map(tuple, pq.quantize(frame).collect()), key=repr)

    return run


def test_nearest_is_that_of_comparing_all():
    rnd = np.random.default_rng(3)
    for spread in (2, 30, 3000, 2**40):
        points = rnd.integers(-spread, spread, (256, 4))
        points[100:120] = points[5]  # equal entries
        queries = np.concatenate([rnd.integers(-spread, spread, (200, 4)), points[::7]])
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in points] for q in queries]
        index, least = pq.nearest(pq.build(points), points, queries)
        assert index.tolist() == [row.index(min(row)) for row in d]
        assert [int(x) for x in least] == [min(row) for row in d]


def test_subtrees_are_left_out(monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-100_000, 100_000, (16, 8))
    points = np.repeat(centres, 16, 0) + rnd.integers(-50, 50, (256, 8))
    queries = points + rnd.integers(-5, 5, points.shape)
    tree, met = pq.build(points), 0
    plain = pq.squared

    def counted(x, y):
        nonlocal met
        met += len(x) * len(y)
        return plain(x, y)

    monkeypatch.setattr(pq, "squared", counted)
    index, _ = pq.nearest(tree, points, queries)
    assert met < 0.3 * len(points) * len(queries)
    assert index.tolist() == plain(queries, points).argmin(1).tolist()


def test_tree_holds_every_entry_within_its_ranges():
    points = np.random.default_rng(5).integers(-9, 9, (300, 3))

    def walk(node):
        below = [node.entries]
        for j, child in enumerate(node.children or []):
            inside = np.concatenate([node.entries[j : j + 1], *([walk(child)] if child else [])])
            for i, s in enumerate(node.entries):
                d = np.sqrt(((points[inside] - points[s]) ** 2).sum(1))
                assert (node.low[i, j] <= d).all() and (d <= node.high[i, j]).all()
            below.append(inside[1:])
        return np.concatenate(below)

    assert sorted(walk(pq.build(points))) == list(range(300))


def test_many_vectors_in_few_places(coded):
    rnd = random.Random(1)
    rows = [(i, [rnd.randint(-3, 3) / 1024 + 1e-4 for _ in range(8)], rnd.choice([1, 2, None])) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(400)]  # a vector that many share
    assert coded(rows) == sorted(brute(rows), key=repr)


def test_edges(coded):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 1.0, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], None),
        (5, [0.1, -0.1, 2.0, -2.0], None), (5, [0.1, -0.1, 2.0, -2.0], None), (6, [], 3), (None, [1.0, 2.0, 3.0], 3),
        (7, [-0.0001, 0.0, 0.0, 0.0, 9.0], 4), (5, [0.0, 0.0, 0.0, 0.0], 2), (8, [1.5e6, -1.5e6, 0.0, 1.0], 5),
    ]
    assert coded(rows) == sorted(brute(rows), key=repr)
    assert coded([(1, [], None), (2, [], None)])[0][1:4] == ("00000000", 0, 0)
    assert coded([]) == [] and coded(rows[:4]) == []


def test_enormous_components_have_a_result(coded):
    out = coded([(i, [1e30 * i, 0.0, 0.0, -1e38], 1) for i in range(300)])
    assert len(out) == 300 and all(0 <= e <= 2**63 - 1 and 0 <= s <= 2**63 - 1 for _, _, e, s, _ in out)


def test_rare_labels_meet_their_sums_too(spark):
    coded = spark.createDataFrame([(i, i % 7 if i < 50 else None, "00", i) for i in range(100)], "vec_id long, label int, code string, error long")
    few = {r.vec_id: r.label_error for r in pq.label_errors(coded, few=3).collect()}
    assert few == {r.vec_id: r.label_error for r in pq.label_errors(coded).collect()}
    assert few[99] == sum(range(50, 100)) and few[0] == sum(range(0, 50, 7))


def test_query_equals_sql(spark, sf):
    assert difference(QUERIES["op13_vector_codes"](spark, sf), connect(sf), ORACLE["op13_vector_codes"]) is None
