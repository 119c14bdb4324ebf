import json
import random

import pytest

from checks.compare import connect, difference
from mailsift.llm import toolcalls
from mailsift.llm.queries import ORACLE, QUERIES

CALLS = "conversation long, turn long, call_id string, tool string, arguments string, x int"
SCHEMAS = [
    ("add", "a", "number", True), ("add", "b", "number", True), ("add", "note", "string", False),
    ("list", "of", "array", False), ("list", "by", "object", False), ("list", "ok", "boolean", False),
]


@pytest.fixture
def link(spark):
    def run(calls, results=(), schemas=SCHEMAS):
        rows = toolcalls.link_tool_calls(
            spark.createDataFrame([(*c, 1) for c in calls], CALLS),
            spark.createDataFrame(list(results), "conversation long, call_id string, content string"),
            spark.createDataFrame(schemas, "tool string, parameter string, type string, required boolean"),
        )
        return {(r.conversation, r.call_id): r for r in rows.collect()}

    return run


def test_canonical_json(link):
    out = link(
        [(1, 0, "c1", "add", '{"note": "é \\" \\n",  "b": 2, "a": 1.5}'), (1, 1, "c2", "list", '{"of":[3, {"z":1,"y":[]}],"by":{"b":null,"a":true}}')],
        [(1, "c1", 'said "3.5"'), (1, "c2", None)],
    )
    assert out[1, "c1"].json == '{"arguments":{"a":1.5,"b":2,"note":"é \\" \\n"},"id":"c1","name":"add","result":"said \\"3.5\\""}'
    assert out[1, "c2"].json == '{"arguments":{"by":{"a":true,"b":null},"of":[3,{"y":[],"z":1}]},"id":"c2","name":"list","result":""}'
    assert all(r.valid and r.n_results == 1 and json.loads(r.json) for r in out.values())


def test_problems(link):
    calls = [
        (1, 0, "a", "add", '{"a": 1}'), (1, 1, "b", "add", '{"a": "1", "b": 2, "c": 3}'), (1, 2, "c", "nope", "{}"),
        (1, 3, "d", "add", "[1]"), (1, 4, "e", "add", None), (1, 5, "f", "add", '{"a": 1, "a": 2, "b"'),
        (1, 6, "g", None, "{}"), (1, 7, "h", "list", '{"ok": "$result:zzz"}'), (1, 8, "i", "list", '{"ok": null}'),
    ]
    out = link(calls, [(1, "b", "x"), (1, "b", "y"), (1, "b", "y"), (2, "a", "of another conversation")])
    problems = {k[1]: r.problems for k, r in out.items()}
    both = ["missing a", "missing b", "no result"]
    assert problems == {
        "a": ["missing b", "no result"],
        "b": ["several results", "type of a", "unknown c"],
        "c": ["no result", "unknown tool"],
        "d": ["malformed arguments", *both],
        "e": ["malformed arguments", *both],
        "f": ["malformed arguments", *both],
        "g": ["no result", "unknown tool"],
        "h": ["no result", "unknown reference"],
        "i": ["no result", "type of ok"],
    }
    assert not any(r.valid for r in out.values())


def needs(*ids):
    return json.dumps({f"p{i}": f"$result:{c}" for i, c in enumerate(ids)})


def test_order(link):
    calls = [(1, t, f"c{t}", "list", needs(*[f"c{u}" for u in range(max(0, t - 2), t)])) for t in range(6)]
    # Out of turn: the first needs the last.
    calls += [(2, 0, "x", "list", needs("z")), (2, 1, "y", "list", needs("x")), (2, 2, "z", "list", "{}"), (2, 3, "w", "list", "{}")]
    # A cycle, one behind it, one beside it.
    calls += [(3, 0, "a", "list", needs("b")), (3, 1, "b", "list", needs("a")), (3, 2, "c", "list", needs("b")), (3, 3, "d", "list", "{}"), (3, 4, "e", "list", needs("e"))]
    out = link(calls)
    assert [out[1, f"c{t}"].position for t in range(6)] == list(range(6))
    assert {c: out[2, c].position for c in "xyzw"} == {"z": 0, "w": 1, "x": 2, "y": 3}
    assert {c: (out[3, c].position, out[3, c].cyclic) for c in "abcde"} == {
        "d": (0, False), "a": (1, True), "b": (2, True), "c": (3, True), "e": (4, True)
    }


def test_long_conversations_are_numbered_in_blocks(link, monkeypatch):
    monkeypatch.setattr(toolcalls, "BLOCK", 7)
    out = link([(1, 3 * t, f"c{t}", "list", "{}") for t in range(100)])
    assert [out[1, f"c{t}"].position for t in range(100)] == list(range(100))


def test_edges(link):
    calls = [
        (None, 0, "a", "list", "{}"), (1, None, "a", "list", "{}"), (1, 0, None, "list", "{}"),
        (1, 5, "b", "list", "{}"), (1, 4, "b", "list", '{"ok": true}'), (1, 4, "b", "list", '{"ok": true}'), (1, 6, "", "list", ""),
    ]
    out = link(calls, [(None, "b", "x"), (1, None, "x"), (1, "b", "x" * 100_000)])
    assert set(out) == {(1, "b"), (1, "")} and out[1, "b"].valid and len(out[1, "b"].json) > 100_000
    assert out[1, ""].problems == ["malformed arguments", "no result"]
    assert link([]) == {}


def test_equal_numbers_are_spelled_alike(link):
    spelled = ["100", "1e2", "100.0", "1E+2", "10.0e1", "100.000", "1000e-1"]
    out = link([(1, i, f"c{i}", "add", f'{{"a": {n}, "b": -0.0, "note": "1e2 \\" 3.0,"}}') for i, n in enumerate(spelled)])
    assert {r.json.split('"id"')[0] for r in out.values()} == {'{"arguments":{"a":100,"b":0,"note":"1e2 \\" 3.0,"},'}
    small = link([(1, i, f"c{i}", "add", f'{{"a": {n}, "b": 1}}') for i, n in enumerate(["1e-7", "0.0000001", "10.0E-8"])])
    assert {r.json.split(',"b"')[0] for r in small.values()} == {'{"arguments":{"a":0.0000001'}
    large = link([(1, i, f"c{i}", "add", f'{{"a": {n}, "b": 1}}') for i, n in enumerate(["1e30", "1" + "0" * 30, "1e300", "1" + "0" * 300, "1e-300"])])
    begun = [large[1, f"c{i}"].json.split(",")[0] for i in range(5)]
    assert begun[0] == begun[1] == '{"arguments":{"a":1' + "0" * 30 and begun[2] == begun[3] == '{"arguments":{"a":1E300'
    assert begun[4] == '{"arguments":{"a":1E-300' and all(float(json.loads(r.json)["arguments"]["a"]) > 0 for r in large.values())


def test_malformed_numbers_stay_malformed(link):
    out = link([(1, i, f"c{i}", "add", f'{{"a": {n}, "b": 1}}') for i, n in enumerate(["01e2", "1e", "1.e2", "+1e2", "1e2.5"])])
    assert all("malformed arguments" in r.problems for r in out.values())


def test_whole_texts_of_any_script(link):
    text = "Ünï \\ \"quoted\" \n\t 日本語 😀 " * 2000
    out = link([(1, 0, "c", "list", json.dumps({"by": {"text": text}}))], [(1, "c", text)])
    assert json.loads(out[1, "c"].json) == {"arguments": {"by": {"text": text}}, "id": "c", "name": "list", "result": text}


def depths(edges, calls):
    """Longest ways by walking them; calls on a cycle or behind one have none."""
    level, left = {}, set(calls)
    while fresh := {c for c in left if all(d in level for d in edges.get(c, ()))}:
        level |= {c: 1 + max((level[d] for d in edges.get(c, ())), default=-1) for c in fresh}
        left -= fresh
    return level


def test_levels_in_rounds_that_grow_with_the_logarithm(spark, monkeypatch):
    names, plain = [], toolcalls.land
    monkeypatch.setattr(toolcalls, "land", lambda df, name="table": names.append(name) or plain(df, name))
    edges = {f"c{i}": [f"c{i + 1}"] for i in range(999)}
    calls = spark.createDataFrame([(1, f"c{i}") for i in range(1000)], "conversation long, call_id string")
    needs = spark.createDataFrame([(1, a, b) for a, bs in edges.items() for b in bs], "conversation long, call_id string, needs string")
    got = {r.call_id: r.level for r in toolcalls.levels(calls, needs).collect()}
    assert got == depths(edges, {f"c{i}" for i in range(1000)}) and names.count("fresh") <= 12


def test_levels_of_any_graph(spark):
    rnd = random.Random(6)
    rows, wanted = [], {}
    for conv in range(30):
        calls = [f"c{i}" for i in range(rnd.randint(1, 14))]
        back = rnd.choice([0, 0, 0.05])
        edges = {}
        for i, c in enumerate(calls):
            found = {calls[j] for j in range(len(calls)) if (j > i and rnd.random() < rnd.choice([0.1, 0.4])) or (j <= i and rnd.random() < back)}
            if found:
                edges[c] = sorted(found)
        rows += [(conv, c, d) for c in calls for d in edges.get(c, [None])]
        wanted |= {(conv, c): v for c, v in depths(edges, calls).items()}
    frame = spark.createDataFrame(rows, "conversation long, call_id string, needs string")
    out = toolcalls.levels(frame.select("conversation", "call_id").distinct(), frame.filter("needs IS NOT NULL"))
    assert {(r.conversation, r.call_id): r.level for r in out.collect()} == wanted


def test_query_equals_sql(spark, sf):
    assert difference(QUERIES["op6_tool_calls"](spark, sf), connect(sf), ORACLE["op6_tool_calls"]) is None


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op6_tool_calls"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
