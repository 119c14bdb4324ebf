import json
import random

import pytest
from pyspark.sql import functions as F

from mailsift.functions import chat
from mailsift.operators import prompts
from mailsift.schemas import TOOL_MESSAGE

TOOLS = [{"name": "f", "description": "Prüfe « x »", "parameters": {"a": [1, 2]}}]


def say(role, content):
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


def rendered(spark, messages, **options):
    rows = [([(m[0], m[1], m[2] if len(m) > 2 else None) for m in messages],)]
    df = spark.createDataFrame(rows, f"m array<{TOOL_MESSAGE.simpleString()}>")
    return df.select(chat.render_chat(F.col("m"), has_tool_calls=True, **options)).first()[0]


def test_plain_chat(spark):
    assert rendered(spark, [("system", "S"), ("user", "U"), ("assistant", "A")]) == (
        say("system", "S") + say("user", "U") + say("assistant", "A"))


def test_default_system_and_cue(spark):
    assert rendered(spark, [("user", "U")], add_cue=True) == (
        say("system", chat.DEFAULT_SYSTEM) + say("user", "U") + "<|im_start|>assistant\n")


def test_later_system_turn_is_kept(spark):
    assert rendered(spark, [("user", "U"), ("system", "S")]) == (
        say("system", chat.DEFAULT_SYSTEM) + say("user", "U") + say("system", "S"))


def test_unknown_roles_leave_no_trace(spark):
    assert rendered(spark, [("system", "S"), ("critic", "C")]) == say("system", "S")


def test_tools_calls_and_merged_replies(spark):
    text = rendered(
        spark,
        [("user", "U"), ("assistant", "", [("f", '{"a": 1}'), ("g", "{}")]), ("tool", "r1"), ("tool", "r2"),
         ("assistant", "so", [("h", "[]")]), ("tool", "r3")],
        tools=TOOLS,
    )
    spec = json.dumps(TOOLS[0], ensure_ascii=False)
    head, rest = text.split("<tools>\n", 1)
    assert head.startswith(f"<|im_start|>system\n{chat.DEFAULT_SYSTEM}\n\n# Tools\n\n")
    assert rest.startswith(f"{spec}\n</tools>\n\nFor each function call")
    assert text.endswith(
        "</tool_call><|im_end|>\n" + say("user", "U")
        + '<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>'
        + '\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        + "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
        + '<|im_start|>assistant\nso\n<tool_call>\n{"name": "h", "arguments": []}\n</tool_call><|im_end|>\n'
        + "<|im_start|>user\n<tool_response>\nr3\n</tool_response><|im_end|>\n"
    )


def test_turn_table_equals_array(spark):
    """Pieces put end to end are the same text as the chat rendered from one array."""
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool", "tool"]
    chats = {c: [(rng.choice(roles), f"{c}-{i}") for i in range(rng.randint(1, 9))] for c in range(60)}
    turns = spark.createDataFrame(
        [(c, 3 * i, r, t) for c, ms in chats.items() for i, (r, t) in enumerate(ms)],
        "conv_id long, turn long, role string, text string",
    )
    pieces = prompts.render_turns(turns, add_cue=True, tools=TOOLS).collect()
    arrays = spark.createDataFrame(
        list(chats.items()), "c long, m array<struct<role:string,content:string>>"
    ).select("c", chat.render_chat(F.col("m"), add_cue=True, tools=TOOLS).alias("text"))
    for row in arrays.collect():
        mine = sorted((p.turn, p.piece) for p in pieces if p.conv_id == row.c)
        assert "".join(p for _, p in mine) == row.text


def test_messages_of_a_mail(spark):
    df = spark.createDataFrame([("s", None, 1)], "subject string, body string, label int")
    trained = prompts.add_messages(df).first().messages
    assert [tuple(m) for m in trained] == [
        ("system", chat.TRAIN_SYSTEM), ("user", "Subject: s\nBody: "), ("assistant", "phishing")]
    asked = prompts.add_messages(df, system="x", with_answer=False).first().messages
    assert [m.role for m in asked] == ["system", "user"] and asked[0].content == "x"


def brute_labels(prompt, full, n):
    full = full[:n]
    trained = set(range(len(prompt[:n]), len(full))) or {len(full) - 1}
    return [x if i in trained else -100 for i, x in enumerate(full)]


def test_answer_only_labels(spark):
    rng = random.Random(4)
    cases = [([rng.randint(1, 9) for _ in range(rng.randint(0, 8))], [rng.randint(1, 9) for _ in range(rng.randint(0, 10))])
             for _ in range(200)]
    df = spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(cases)], "i int, p array<int>, f array<int>")
    rows = df.select("i", chat.answer_only_labels(F.col("p"), F.col("f"), 6).alias("y")).collect()
    assert all(r.y == brute_labels(*cases[r.i], 6) for r in rows)


def test_instruction_record(spark):
    df = spark.createDataFrame([("s\t\"q\"", "b\n", 0)], "subject string, body string, label int")
    record = json.loads(prompts.instruction_json(df, "I").first().record)
    assert list(record.items()) == [
        ("instruction", "I"), ("input", "Subject: s\t\"q\"\nBody: b\n"), ("output", "legitimate")]


def test_resolve_mail_columns(spark):
    def resolved(**columns):
        df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        row = prompts.resolve_mail_columns(df).first()
        return row.subject, row.email_text

    assert resolved(title="t", subject="s", content="c", text="x") == ("s", "x")
    assert resolved(title="t", body="b", email_text="e") == ("t", "e")
    assert resolved(title="t") == ("t", prompts.SUBJECT_AS_BODY + "t")
    assert resolved(content="c") == (prompts.NO_SUBJECT, "c")
    assert resolved(other="o") == (prompts.NO_SUBJECT, prompts.NO_BODY)


def test_mail_at_bounds(spark):
    df = spark.range(5).withColumnRenamed("id", "index")
    assert [prompts.mail_at(df, k).count() for k in (-1, 0, 4, 5)] == [0, 1, 1, 0]


def brute_compact(whole, size):
    """Sentence by sentence, as documented."""
    import re

    if len(whole) <= size:
        return whole
    head, tail = int(size * 0.65), int(size * 0.25)
    first, last = head, len(whole) - tail
    while first < len(whole) and not whole[first].isspace():
        first += 1
    while last > 0 and not whole[last - 1].isspace():
        last -= 1
    sentences = re.split(r"(?<=[.!?\n])\s+", whole[first:max(first, last)])
    marked = re.compile(prompts.URL + r"|(?i:\b(?:" + "|".join(prompts.SENSITIVE_WORDS) + "))")
    hits = [bool(marked.search(s)) for s in sentences]
    kept = [s for i, s in enumerate(sentences) if any(hits[max(0, i - 1):i + 2])]
    mark = "\n\n[...truncated...]\n\n"
    return whole[:first] + mark + " ".join(kept) + mark + whole[max(first, last):]


def test_long_mail_keeps_links_and_warnings(spark):
    rng = random.Random(6)
    words = ["hello", "there.", "Really?", "https://evil.example/login?a=1", "verify", "end.\n", "plain", "Wire!"]
    mails = [" ".join(rng.choice(words[:2] * 6 + words) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    mails += ["x" * 500, "https://" + "y" * 400 + " z", "a. " * 90 + "https://u.example/" + "q" * 90]
    df = spark.createDataFrame(list(enumerate(mails)), "i int, body string")
    rows = df.select("i", prompts.compact_keep_links(F.lit("s"), F.col("body"), 200).alias("t")).collect()
    for r in rows:
        whole = f"Subject: s\nBody: {mails[r.i]}"
        assert r.t == brute_compact(whole, 200)
        assert all(url in r.t for url in mails[r.i].split() if url.startswith("https"))


def test_too_small_budget():
    with pytest.raises(ValueError):
        from mailsift.functions.text import compact_text

        compact_text(F.col("x"), 0)
