import hashlib
import random
import zlib

import pytest

from mailsift.llm import structure
from mailsift.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, conv string, copies int"
FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute(rows):
    """Results by trying all edits of (conv, turn, role, text) rows, forwards, least first."""
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    return {conv: one(conv, turns) for conv, turns in by_conv.items()}


def one(conv, turns):
    shown = lambda v: " " if v is None else str(v)
    got = []
    for turn, role, text in turns:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        got += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got.sort(key=lambda g: (g[0] is not None, g[0] or 0, hashlib.sha256(f"{len(g[1])}:{g[1]}{g[2]}".encode()).digest()))
    numbers = {g[0] for g in got if g[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    faults, seen = [], set()
    for _, role, text in got:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(got, faults):
        new, late = {}, int(fault == "t")
        for state, (cost, audit, out) in best.items():
            put(new, state, (cost + 3, audit + "D", out))
            if fault in "-t":
                if role and role[0] in FOLLOWS[state]:
                    put(new, FOLLOWS[state][role[0]], (cost + late, audit + "K", (*out, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if other[0] in FOLLOWS[state]:
                        put(new, FOLLOWS[state][other[0]], (cost + 2 + late, audit + "R", (*out, f"{other}:{text}")))
        best = inserted(new)
    cost, audit, out = min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def put(best, state, way):
    if state not in best or way[:2] < best[state][:2]:
        best[state] = way


def inserted(best):
    best = dict(best)
    for _ in range(4):
        for state, (cost, audit, out) in list(best.items()):
            for role in ("user", "assistant"):
                if role[0] in FOLLOWS[state]:
                    put(best, FOLLOWS[state][role[0]], (cost + 2, audit + "I", (*out, role + ":")))
    return best


@pytest.fixture
def repaired(spark):
    def run(rows, chunk=structure.CHUNK, parts=3):
        frame = spark.createDataFrame([(*r, "x", 9) for r in rows], TURNS).repartition(parts)
        return {r[0]: tuple(r)[1:] for r in structure.repair_conversations(frame, chunk=chunk).collect()}

    return run


def conversations(seed, n, most, unlike=True):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uu"]
    for conv in range(n):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(roles) if rnd.random() < 0.4 else roles[turn % 2]
            text = rnd.choice(["Yes.", "no", "", " \t\n", None, "Well, well!  ", "x.\x0b", "a ", ". . ."])
            if unlike and text and rnd.random() < 0.8:
                text = f"{turn} {text}"
            number = None if rnd.random() < 0.05 else turn + (3 if rnd.random() < 0.05 else 0)
            yield conv, number, role, text


@pytest.mark.parametrize("chunk", [structure.CHUNK, 1, 3])
def test_equals_trying_everything(repaired, chunk):
    rows = [*conversations(chunk, 120, 14), *((None, t, r, x) for _, t, r, x in conversations(1, 1, 14))]
    expected = brute(rows)
    got = repaired(rows, chunk)
    assert {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v} == {} and len(got) == len(expected)


def test_costs_that_never_converge(repaired):
    """System turns only: the better of two states changes with each turn."""
    rows = [(1, t, "system", f"{t}.") for t in range(60)] + [(2, t, "user", "") for t in range(60)]
    assert repaired(rows, 4) == brute(rows)


def test_a_long_conversation_in_many_chunks(repaired):
    rows = [(7, t, ("user", "assistant")[t % 2 if t % 31 else 0], f"{t}" + ("." if t % 5 else "")) for t in range(3000)]
    assert repaired(rows, 100, 8) == brute(rows)


def test_repeated_rows(repaired):
    rows = [(1, 1, "user", "Again."), *[(1, 2, "assistant", "Sure.")] * 500, (1, 3, "user", "Again."), *[(1, 4, "user", "")] * 30]
    assert repaired(rows, 64) == brute(rows)


def test_edges(repaired):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (3, None, None, None), (4, 5, "user", "x" * 300_000 + "."), (4, 6, "assistant", "."), (5, 10**12, "user", "a")]
    out = repaired(rows)
    assert out == brute(rows)
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired([]) == {}


def test_fix_ups_stop_where_vectors_are_parallel():
    looked = []

    class Counted(structure.Steps):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    turns = bytes(structure.symbol("ua"[i % 2], 0) for i in range(10_000))
    steps = structure.Steps()
    found = structure.before(steps, turns, structure.ANY)
    counted = Counted()
    assert structure.fixed_up(counted, turns, (structure.ANY, found), structure.END) == structure.before(steps, turns, structure.END)
    assert len(looked) < 100


def test_whole_table_against_trying_everything(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == brute(map(tuple, rows))
