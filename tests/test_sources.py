import csv
import gzip
import mailbox
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailsift.functions import mime
from mailsift.operators.contract import check_contract, missing_columns
from mailsift.operators.ordering import with_ordinals
from mailsift.operators.parse import exclude_ordinals, parse_messages
from mailsift.sources import csv_records, readers, scratch, sinks


@pytest.fixture
def small_blocks(spark):
    """Cut files into blocks of a few hundred bytes, so records cross block borders."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def make_mbox(path, n=150):
    rng = random.Random(5)
    lines = [b"text with From inside", b">From quoted", b"", b"caf\xe9 bad", "é中".encode() * 5, b"From_x"]
    with open(path, "wb") as f:
        for i in range(n):
            body = b"\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))
            f.write(b"From a@b Thu Jan  1 00:00:00 2015\nSubject: s%d\n\n" % i + body + b"\n\n")


def test_mbox_like_the_standard_reader(spark, small_blocks, tmp_path):
    make_mbox(tmp_path / "a.mbox")
    frame = readers.read_mbox(spark, str(tmp_path / "a.mbox"), scan_order=True)
    assert frame.select("block").distinct().count() > 5
    rows = parse_messages(with_ordinals(frame), decode=True).orderBy("ordinal").collect()
    theirs = list(mailbox.mbox(str(tmp_path / "a.mbox")))
    assert [r.ordinal for r in rows] == list(range(len(theirs)))
    assert [r.subject for r in rows] == [m["subject"] for m in theirs]
    bodies = [m.get_payload(decode=True).decode(errors="ignore") for m in theirs]
    assert [r.body.rstrip("\n") for r in rows] == [b.rstrip("\n") for b in bodies]


def test_ordinals_start_anew_in_every_file(spark, small_blocks, tmp_path):
    make_mbox(tmp_path / "a.mbox", 40)
    make_mbox(tmp_path / "b.mbox", 30)
    frame = with_ordinals(readers.read_mbox(spark, str(tmp_path), scan_order=True))
    kept = exclude_ordinals(frame, [0, 7, 35])
    counts = {r.file[-6:]: r.n for r in kept.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a.mbox": 37, "b.mbox": 28}
    subjects = kept.filter("file like '%a.mbox'").select(mime.subject_of(F.col("message"))).collect()
    assert {f"s{i}" for i in (0, 7, 35)}.isdisjoint({r[0] for r in subjects})


def test_raw_csv_quotes_newlines_and_order(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        'file,message\n1,"Subject: a ""quoted""\n\nline 1\nline, 2"\n2,"Subject: b\n\nx\\n"\n3,\n'
    )
    rows = readers.read_raw_csv(spark, str(tmp_path / "raw.csv"), scan_order=True).orderBy("seq").collect()
    assert [r.message for r in rows] == [
        'Subject: a "quoted"\n\nline 1\nline, 2', "Subject: b\n\nx\\n", None]


def test_clean_csv_null_tokens_and_column_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'label,subject,dataset,body\n1,None,2,NA\n0,"",1,null\n1,,3," spaced "\n', encoding="utf-8"
    )
    plain = {r.dataset: r for r in readers.read_clean(spark, str(tmp_path)).collect()}
    assert (plain[2].subject, plain[2].body, plain[2].label) == ("None", "NA", 1)
    assert plain[3].subject is None and plain[3].body == " spaced "
    tokens = {r.dataset: r for r in readers.read_clean(spark, str(tmp_path), readers.COMMON_NA_TOKENS).collect()}
    assert (tokens[2].subject, tokens[2].body, tokens[1].body) == (None, None, None)


def test_label_that_is_no_number_is_null(spark, tmp_path):
    (tmp_path / "c.csv").write_text("subject,body,label,dataset\ns,b,spam,1\ns,b, 1 ,x\n")
    rows = sorted((r.label is None, r.dataset) for r in readers.read_clean(spark, str(tmp_path)).collect())
    assert rows == [(False, None), (True, 1)]


def test_split_csv_ignores_byte_order_mark(spark, tmp_path):
    (tmp_path / "test.csv").write_text("subject,body,label,dataset\ns,b,1,4\n", encoding="utf-8-sig")
    row = readers.read_split(spark, str(tmp_path / "test.csv"), "test").first()
    assert (row.subject, row.label, row.dataset, row.split) == ("s", 1, 4, "test")


def test_tagged_files_keep_their_tags(spark, tmp_path):
    for name in ("clean", "poisoned"):
        (tmp_path / f"{name}.csv").write_text("id,subject,body\n1,s,b\n2,,c\n")
    tags = {str(tmp_path / "clean.csv"): (1, 3), str(tmp_path / "poisoned.csv"): (1, 4)}
    rows = readers.read_tagged(spark, tags).collect()
    assert sorted((r.dataset, r.label, r.subject or "", r.body) for r in rows) == [
        (3, 1, "", "c"), (3, 1, "s", "b"), (4, 1, "", "c"), (4, 1, "s", "b")]


@pytest.mark.parametrize("quote_all", [False, True])
def test_csv_round_trip(spark, tmp_path, quote_all):
    texts = ['a "q" b', "two\nlines", "comma, x", " lead and trail ", "back\\slash", "é😀", 'ends"', "\ttab"]
    df = spark.createDataFrame([(t, t[::-1], 1, i) for i, t in enumerate(texts)],
                               "subject string, body string, label int, dataset int")
    sinks.write_csv(df, str(tmp_path / "out"), quote_all)
    back = readers.read_clean(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_split_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "subject string, split string")
    sinks.write_splits(df, str(tmp_path / "splits"))
    part = spark.read.parquet(str(tmp_path / "splits")).filter("split = 'test'")
    assert [r.subject for r in part.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_report_makes_parent_folders(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "report")
    sinks.write_report(spark.range(3).toDF("n"), path, "csv")
    assert spark.read.csv(path, header=True).count() == 3


def test_files_begin_with_a_mark(spark, tmp_path):
    path = tmp_path / "marked"
    rows = [("a, b", "first\nsecond", 1, 2), (" lead", "é", 0, 1)]
    df = spark.createDataFrame(rows, "subject string, body string, label int, dataset int").repartition(2)
    sinks.write_csv(df, str(path), bom=True)
    files = [f.read_bytes() for f in path.glob("*.csv")]
    assert files and all(f.startswith(b"\xef\xbb\xbfsubject,body") for f in files)
    for multi_line in (True, "whole"):
        back = readers.read_split(spark, str(path), "test", multi_line=multi_line)
        assert sorted(map(tuple, back.drop("split").collect())) == sorted(rows)
    with pytest.raises(ValueError, match="quote"):
        sinks.write_csv(df, str(path), quote_all=True, bom=True)


def test_preview_cuts_text(spark):
    df = spark.createDataFrame([(3, "c" * 900), (1, "a"), (2, "b" * 400)], "key int, body string")
    assert [(r.key, len(r.body)) for r in sinks.preview(df, 2, 300).collect()] == [(1, 1), (2, 300)]


def test_contract(spark):
    df = spark.createDataFrame([("s", "b", 1, 2, "train"), ("s", "b", 0, 1, "train")],
                               "subject string, body string, label int, dataset int, split string")
    report = check_contract(df).collect()
    assert sorted((r.split, r.label, r.n, r["columns"]) for r in report) == [("train", 0, 1, 4), ("train", 1, 1, 4)]
    assert missing_columns(df.drop("body")) == ["body"]
    with pytest.raises(ValueError, match="body"):
        check_contract(df.drop("body"))


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or scratch._local_folder()
    assert scratch.scratch_path(spark, "x").startswith(named)
    assert scratch.scratch_path(spark, "x") != scratch.scratch_path(spark, "x")
    assert scratch.land(spark.range(5)).count() == 5


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_every_file_names_its_own_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffsubject,body,label,dataset\ns1,b1,1,3\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("dataset,body,subject,label\n4,\"b\n2\",s2,0\n")
    (tmp_path / "c.csv").write_text("subject,body,label,dataset\r\ns3,b3,x,3\r\n")
    rows = readers.read_split(spark, str(tmp_path)).orderBy("subject").collect()
    assert [tuple(r) for r in rows] == [("s1", "b1", 1, 3), ("s2", "b\n2", 0, 4), ("s3", "b3", None, 3)]


def test_json_lines_are_read_in_blocks(spark, small_blocks, tmp_path):
    path = str(tmp_path / "raw")
    messages = [f"Subject: {i}\n\n" + "x" * (7 * i) for i in range(100)] + [None]
    spark.createDataFrame([(m,) for m in messages], "message string").coalesce(1).write.json(path)
    frame = readers.read_raw_json(spark, path, scan_order=True)
    assert frame.select("block").distinct().count() > 5
    assert sorted(r.message for r in frame.collect() if r.message) == sorted(filter(None, messages))


def test_landed_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda s: str(tmp_path))
    assert scratch.land(spark.range(3)).count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    scratch.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def csv_rows(n):
    rnd = random.Random(1)
    texts = ["a", "b\nc", 'q"uo,te"d', "", "x\n\n\ny", 'é中\n""\n,', "long " * 300, "l\n" * 200, "end\r\nx", " sp ", "\n", '"', ","]
    return [(str(k), rnd.choice(texts), rnd.choice(["z", "", "w\n"])) for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [97, 997, 10_000_000])
def test_records_with_line_breaks_are_read_in_blocks(spark, tmp_path, size, end):
    rows = csv_rows(300)
    with open(tmp_path / "f 1.csv", "w", newline="", encoding="utf-8-sig") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(("key", "message", "o"))
        writer.writerows(rows)
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = readers._csv(spark, str(tmp_path), lambda df, order: df.select(*order, "key", "message", "o"), True, True)
        got = [(r.key, r.message, r.o) for r in sorted(df.collect(), key=lambda r: (r.file, r.block, r.seq))]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    whole = readers._csv(spark, str(tmp_path), lambda df, order: df.select("key", "message", "o"), "whole")
    assert got == [tuple(r) for r in whole.collect()]
    assert [k for k, _, _ in got] == [k for k, _, _ in rows]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("message\n" + '"a\nb"\n' * 400_000)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        assert csv_records._lines(spark, [str(tmp_path / "f.csv")]).rdd.getNumPartitions() >= 10
        rows = readers.read_raw_csv(spark, str(tmp_path)).groupBy("message").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [tuple(r) for r in rows] == [("a\nb", 400_000)]


def test_headers_are_read_without_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffx,y\n1,2\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as file:
        file.write("y,x,,x\n")
    (tmp_path / "c.csv").write_text("")
    found = {Path(k).name: v for k, v in csv_records.header_lines(spark, str(tmp_path)).items()}
    assert found == {"a.csv": "x,y", "b.csv.gz": "y,x,,x", "c.csv": ""}
    assert csv_records.column_names("y,x,,x") == ["y", "x1", "_c2", "x3"]
