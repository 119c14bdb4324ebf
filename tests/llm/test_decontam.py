import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from mailsift.llm import decontam
from mailsift.llm.queries import ORACLE, QUERIES

ITEM = "Then Maria bought 12 apples for 3 dollars, gave 12 to her friend and walked 5 km home to tell the story."


@pytest.fixture
def leaks(spark, docs_of):
    def find(texts, items=(ITEM,), **more):
        table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        rows = decontam.find_leaks(docs_of(list(enumerate(texts))), table, **more).collect()
        return {(r.doc_id, r.item_id): r.reworded for r in rows}

    return find


def test_templates(spark):
    df = spark.createDataFrame([(1, "The 3.5 kg of Rice. Rice costs $7,200 in IBM's \"Shop\" Été été.")], "id long, text string")
    row = decontam.templates(df, "id", "text").first()
    assert row.symbols == [
        "the", "#number", "#unit", "of", "#name", "rice", "costs", "#number", "in", "ibm", "s", "#name", "#name", "été",
    ]


def test_verbatim_and_reworded(leaks, prose):
    other = ITEM.replace("Maria", "Tom").replace("12", "40").replace("3 dollars", "9 euros").replace("5 km", "8 miles")
    texts = [
        f"{prose(1, 50)} {ITEM} {prose(2, 50)}",
        f"{prose(3, 50)} {other} {prose(4, 50)}",
        ITEM.upper(),
        ITEM.replace(",", "").replace(" ", "\n"),
        prose(5, 200),
    ]
    found = leaks(texts)
    assert found[(0, 0)] is False and found[(1, 0)] is True and (4, 0) not in found


def test_slots_must_be_consistent(leaks):
    item = "Take 4 balls, add 4 balls, remove 4 balls and say how many of the 4 balls are left then."
    same, mixed = item.replace("4", "9"), "9".join(item.split("4")[:2]) + "8".join(["", *item.split("4")[2:]])
    assert leaks([same, mixed], [item]) == {(0, 0): True}


def test_half_of_an_item(leaks):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    item = " ".join(words)
    assert leaks([" ".join(words[:12]), " ".join(words[:11])], [item]) == {(0, 0): False}


def words_of(n):
    return [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]


def test_an_excerpt_of_a_long_item(leaks):
    """13 tokens in a row are reported, 12 are not, nor are more with a gap."""
    words = words_of(59)
    texts = [words[10:41], words[20:33], words[20:32], words[:8] + ["x"] + words[8:16], words[:12] + words[30:42]]
    assert leaks([" ".join(t) for t in texts], [" ".join(words)]) == {(0, 0): False, (1, 0): False}


def test_every_eighth_word_changed(leaks):
    words = words_of(59)
    eighth = [f"other{i}" if i % 8 == 7 else w for i, w in enumerate(words)]
    fifth = [f"other{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    assert leaks([" ".join(eighth), " ".join(fifth)], [" ".join(words)]) == {(0, 0): False}


def test_placeholders_alone_say_nothing(leaks):
    numbers = " ".join(str(i) for i in range(60))
    item = "What comes after these: " + numbers
    assert leaks([numbers, " ".join(str(7 * i) for i in range(90))], [item, numbers]) == {}
    # Numbers that belong to a question do not hide it.
    assert leaks([item, item.replace("5", "8")], [item])[(0, 0)] is False


def test_tables_of_numbers_cost_what_prose_does(leaks):
    import time

    items = [f"which of these {i} is the least " + " ".join(str(i * k) for k in range(60)) for i in range(20)]

    def seconds(n):
        start = time.time()
        assert leaks([" ".join(str(i) for i in range(n))] * 2, items) == {}
        return time.time() - start

    seconds(100)
    assert seconds(80_000) < 4 * max(seconds(20_000), 2)


def test_edges(leaks, odd_texts):
    items = [None, "", "too few words", "exactly five words are enough", ITEM, ITEM]
    texts = [*odd_texts, "we say exactly five words are enough here", "too few words"]
    assert leaks(texts, items) == {(len(odd_texts), 3): False}
    assert leaks([], [ITEM]) == {} and leaks(["a b c d e f"], []) == {}
    assert leaks([ITEM, ITEM], [ITEM, ITEM]) == {(d, i): False for d in (0, 1) for i in (0, 1)}


def test_null_and_repeated_ids(spark, docs_of):
    items = spark.createDataFrame([(1, ITEM), (None, ITEM), (1, "short one that is not it")], "item_id long, text string")
    docs = docs_of([(None, ITEM), (4, ITEM), (4, ITEM)])
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()] == [(4, 1)]


def test_shuffled_benchmark_gives_the_same(spark, sf, monkeypatch):
    query = QUERIES["op4_benchmark_decontamination"]
    few = {tuple(r) for r in query(spark, sf).collect()}
    monkeypatch.setattr(decontam, "MOST_BROADCAST_WINDOWS", 0)
    assert {tuple(r) for r in query(spark, sf).collect()} == few and few


def test_a_long_text(leaks, prose):
    assert leaks([prose(1, 60_000) + " " + ITEM]) == {(0, 0): False}


def test_query_equals_sql(spark, sf):
    query, sql = (x["op4_benchmark_decontamination"] for x in (QUERIES, ORACLE))
    assert difference(query(spark, sf), connect(sf), sql) is None


def test_query_equals_sql_with_slots(spark, tmp_path):
    import duckdb

    long = " ".join(words_of(40)) + " 1 2 3 4 5 6 7 8 then 9 days"
    texts = [ITEM, ITEM.replace("12", "7"), ITEM.replace("12", "7", 1), "In Rome, " + ITEM.lower(), None, ""]
    texts += [long, " ".join(long.split()[3:17]), long.replace("3 4", "4 4"), " ".join(long.split()[3:15]), "1 2 3 4 5 6 7"]
    texts += [" ".join(f"x{i}" if i % 8 == 7 else w for i, w in enumerate(long.split()))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(0, ITEM), (1, ITEM.replace("12 apples", "14 pears")), (2, long)]
    items = spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", docs), ("benchmark", items)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path))
    assert difference(got, db, ORACLE["op4_benchmark_decontamination"]) is None and got.filter(F.col("reworded")).count()


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op4_benchmark_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
