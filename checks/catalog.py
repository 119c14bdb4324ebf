"""One query per operator, over whole tables. Names match those in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from mailsift.functions import answers, chat, mime, text
from mailsift.functions.html import html_to_text
from mailsift.operators import assemble, clean, classify, evaluate, growing, parse, policy, prompts
from mailsift.operators.contract import check_contract
from mailsift.operators.dedup import dedup_exact
from mailsift.plans import corpus, prediction, training
from mailsift.plans.evaluation import evaluate_run
from mailsift.sources import published, readers, sinks
from mailsift.sources.scratch import land, scratch_path
from mailsift.streaming import gate as streaming_gate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def S() -> Column:
    return F.col("subject")


def B() -> Column:
    return F.col("body")


def K() -> Column:
    return F.col("key")


def query(make: Query | str):
    """Register a query under its own name, or under the one given."""
    if isinstance(make, str):
        return lambda function: QUERIES.setdefault(make, function)
    return QUERIES.setdefault(make.__name__, make)


# --- inputs -----------------------------------------------------------------------


def raw_mail(spark: SparkSession, sf: str) -> DataFrame:
    """Mail as RFC-822 text; reply marks on every third, no subject on one in fifty."""
    prefixed = F.when(K() % 3 == 0, F.concat(F.lit("RE: Fwd : "), S())).otherwise(S())
    subject_line = F.when(K() % 50 == 0, "").otherwise(F.concat(F.lit("Subject: "), prefixed, F.lit("\n")))
    sender = F.concat(F.lit("From: sender"), (K() % 20).cast("string"), F.lit("@example.com\n"))
    mails = fx.mail(spark, sf)
    return mails.withColumn("message", F.concat(sender, subject_line, F.lit("\n"), B()))


def mbox_lines(mails: DataFrame) -> Column:
    """Mails as mbox records, the key in a header, body lines that begin `From ` quoted."""
    return F.concat(
        F.lit("From sender@example.com Thu Jan  1 00:00:00 2015\nX-Key: "),
        K().cast("string"),
        F.lit("\nSubject: "),
        S(),
        F.lit("\n\n"),
        F.regexp_replace(B(), "(?md)^From ", ">From "),
        F.lit("\n"),
    )


def key_header(message: str = "message") -> Column:
    return F.regexp_extract(message, r"(?md)^X-Key: ([0-9]+)$", 1).cast("long").alias("key")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return land(fx.labelled_mail(spark, sf), "labelled")


def balanced(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.balance(labelled(spark, sf))


def split_mail(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.stratified_split(land(balanced(spark, sf), "balanced"))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    return policy.prediction_rows(fx.pred(spark, sf), index="key")


def p_of(k: Column, step: Column | None = None) -> Column:
    """A made-up but fixed probability between 0 and 1."""
    shifted = k * 7919 if step is None else k * 7919 + step * 131
    return (shifted % 997 + 1) / F.lit(998.0)


# --- scans and sinks ----------------------------------------------------------------


@query
def scan_raw_csv(spark, sf):
    path = scratch_path(spark, "raw_csv")
    sinks.write_csv(raw_mail(spark, sf).select("message"), path)
    return readers.read_raw_csv(spark, path)


@query
def scan_raw_json(spark, sf):
    path = scratch_path(spark, "raw_json")
    raw_mail(spark, sf).select("message").write.json(path)
    return readers.read_raw_json(spark, path)


@query
def scan_mbox(spark, sf):
    path = scratch_path(spark, "mbox")
    mails = fx.mail(spark, sf)
    mails.select(mbox_lines(mails)).write.text(path)
    messages = readers.read_mbox(spark, path)
    body = F.rtrim(mime.body_raw(F.col("message")), F.lit("\n"))
    return messages.select(
        key_header(), mime.subject_of(F.col("message")).alias("subject"), body.alias("body")
    )


@query
def scan_tagged(spark, sf):
    """Files of one folder whose columns stand in different orders."""
    clean_path, poisoned_path = (scratch_path(spark, n) for n in ("tagged3", "tagged4"))
    mails = fx.mail(spark, sf)
    for path, rest in ((clean_path, 0), (poisoned_path, 1)):
        own = mails.filter(K() % 2 == rest)
        sinks.write_csv(own.filter(K() % 3 == 0).select("subject", "body"), f"{path}/a", quote_all=True)
        sinks.write_csv(own.filter(K() % 3 != 0).select("body", "key", "subject"), f"{path}/b", quote_all=True)
    clean_path, poisoned_path = f"{clean_path}/*", f"{poisoned_path}/*"
    tagged = readers.read_tagged(spark, {clean_path: (1, 3), poisoned_path: (1, 4)})
    return tagged.select(
        text.fill_blank(S()).alias("subject"), text.fill_blank(B()).alias("body"), "label", "dataset"
    )


@query
def scan_clean(spark, sf):
    path = scratch_path(spark, "clean")
    sinks.write_csv(clean.to_contract(fx.clean_mail(spark, sf)), path)
    return readers.read_clean(spark, path)


@query
def scan_split(spark, sf):
    """Files with and without a byte-order mark, in two orders of columns."""
    path = scratch_path(spark, "split")
    mails = fx.labelled_mail(spark, sf)
    for name, rest, columns in (("a", 0, clean.CONTRACT), ("b", 1, clean.CONTRACT[::-1]), ("c", 2, clean.CONTRACT)):
        own = clean.to_contract(mails.filter(K() % 3 == rest)).select(*columns)
        marked = own.withColumnRenamed(columns[0], readers.BOM + columns[0]) if rest < 2 else own
        sinks.write_csv(marked, f"{path}/{name}")
    return readers.read_split(spark, f"{path}/*", "test")


@query
def contract_report(spark, sf):
    return check_contract(clean.to_contract(split_mail(spark, sf), "split"))


@query
def roundtrip_csv(spark, sf):
    path = scratch_path(spark, "roundtrip")
    sinks.write_csv(fx.clean_mail(spark, sf).select("key", *clean.CONTRACT), path, quote_all=True)
    schema = "key long, subject string, body string, label int, dataset int"
    return spark.read.csv(path, schema, header=True, multiLine=True, escape='"')


@query
def roundtrip_report(spark, sf):
    path = scratch_path(spark, "report")
    evaluate_run(fx.pred(spark, sf).withColumnRenamed("key", "index"), path)
    return spark.read.parquet(f"{path}/predictions")


@query
def roundtrip_splits(spark, sf):
    """Splits in folders, written over earlier ones; two of them read back."""
    path = scratch_path(spark, "split_folders")
    splits = land(split_mail(spark, sf).select("key", "subject", "label", "split"), "splits")
    sinks.write_splits(splits.filter("label = 0"), path)
    sinks.write_splits(splits, path)
    return spark.read.parquet(path).filter("split <> 'train'").select("key", "subject", "label", "split")


@query
def roundtrip_marked_csv(spark, sf):
    """CSV files that begin with a byte-order mark, read by name."""
    path = scratch_path(spark, "marked")
    sinks.write_csv(clean.to_contract(fx.clean_mail(spark, sf)), path, bom=True)
    return readers.read_clean(spark, path)


@query
def preview(spark, sf):
    return sinks.preview(fx.clean_mail(spark, sf).select("key", "subject", "body", "label"), 5, 300)


@query
def publish_splits(spark, sf):
    """Two versions of the splits; the second one's test mails, by one reader of both."""
    path = scratch_path(spark, "published")
    splits = land(split_mail(spark, sf).select("key", "subject", "label", "split"), "splits")
    published.publish(splits.withColumn("subject", F.lit("of the first version")), path)
    published.publish(splits, path)
    return published.read_published(spark, path, split="test")


# --- message parsing ----------------------------------------------------------------


@query
def parse_subject(spark, sf):
    raw = raw_mail(spark, sf)
    return raw.select("key", mime.subject_of(F.col("message")).alias("subject"))


@query
def parse_body_raw(spark, sf):
    raw = raw_mail(spark, sf)
    return parse.parse_messages(raw.select("key", "message")).select("key", "body", "parsed")


@query
def parse_body_decoded(spark, sf):
    mails = fx.mail(spark, sf)
    message = F.concat(
        F.lit("Subject: mail\nContent-Transfer-Encoding: base64\n\n"), F.base64(B().cast("binary"))
    )
    rows = parse.parse_messages(mails.select("key", message.alias("message")), decode=True)
    return rows.select("key", "subject", "body")


@query
def parse_multipart(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("key"), "html")
    mails = fx.mail(spark, sf).join(pages, "key", "left")
    edge = "\n--mailsift-part\nContent-Type: "
    message = F.concat(
        F.lit('Subject: mail\nContent-Type: multipart/mixed; boundary="mailsift-part"\n'),
        F.lit(f"{edge}text/plain\n\n"),
        S(),
        F.lit(f"{edge}text/html\n\n"),
        text.fill_blank(F.col("html")),
        F.lit(f"{edge}text/plain\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(B().cast("binary")),
        F.lit("\n--mailsift-part--\n"),
    )
    rows = parse.parse_messages(mails.select("key", message.alias("message")), decode=True)
    return rows.select("key", "subject", "body")


def quoted_printable(c):
    """Text with every byte beyond the plainest spelled out, in lines that end softly."""
    spelled = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit(" ")), F.lit("%"), F.lit("="))
    return F.regexp_replace(spelled, "((?:=[0-9A-F]{2}|[^=]){70})", "$1=\n")


@query
def parse_quoted_printable(spark, sf):
    head = "Subject: mail\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"
    message = F.concat(F.lit(head), quoted_printable(B()))
    mails = fx.mail(spark, sf).select("key", message.alias("message"))
    return parse.parse_messages(mails, decode=True).select("key", "subject", "body")


@query
def parse_nested(spark, sf):
    """Alternatives of a text beside an attachment, as mail programs send them."""
    inner = "\n--outer\nContent-Type: multipart/alternative;\n boundary=\"=_inner\"\n\n--=_inner\nContent-Type: "
    message = F.concat(
        F.lit('Subject: mail\nContent-Type: multipart/mixed;\n\tboundary="outer"\n\nnot for mail programs'),
        F.lit(inner),
        F.lit("text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"),
        quoted_printable(B()),
        F.lit("\n--=_inner\nContent-Type: text/html\n\n<p>"),
        S(),
        F.lit("\n--=_inner--\n\n--outer\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(B().cast("binary")),
        F.lit("\n--outer\n\n"),
        S(),
        F.lit("\n--outer--\n"),
    )
    mails = fx.mail(spark, sf).select("key", message.alias("message"))
    return parse.parse_messages(mails, decode=True).select("key", "subject", "body")


@query
def parse_skip_bad(spark, sf):
    damaged = F.when(K() % 10 != 0, F.col("message")).alias("message")
    rows = parse.parse_messages(raw_mail(spark, sf).select("key", damaged))
    return parse.drop_unparsed(rows).select("key", "subject")


@query
def exclude_ordinals(spark, sf):
    path = scratch_path(spark, "ordinals")
    mails = fx.mail(spark, sf).withColumn("part", F.expr("key div 256"))
    files = mails.select("key", "part", mbox_lines(mails).alias("value"))
    ordered = files.repartition("part").sortWithinPartitions("part", "key").select("value", "part")
    ordered.write.partitionBy("part").text(path)
    messages = readers.read_mbox(spark, path, scan_order=True)
    kept = parse.exclude_ordinals(messages, [16, 34, 42])
    return kept.select(key_header(), "ordinal")


@query
def stamp_source(spark, sf):
    return parse.stamp(fx.mail(spark, sf), 1, 2).select("key", "label", "dataset")


# --- cleaning -------------------------------------------------------------------------


@query
def fill_blank(spark, sf):
    holed = F.when(K() % 4 != 0, S())
    return fx.mail(spark, sf).select("key", text.fill_blank(holed).alias("subject"))


@query
def squash_ws(spark, sf):
    odd = F.concat(F.lit(" \t\u2003"), F.regexp_replace("text", " t", " \u3000\xa0 t"), F.lit("\x1c"))
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("key"), text.squash_ws(odd).alias("text"))


@query
def strip_reply_prefix(spark, sf):
    made = F.concat(
        F.when(K() % 3 == 0, "RE: Fwd : fw:re:").when(K() % 3 == 1, " Re: ").otherwise("Re[2]: "), S()
    )
    return fx.mail(spark, sf).select("key", text.strip_reply_prefix(made).alias("subject"))


@query
def clean_subject(spark, sf):
    made = F.concat(F.when(K() % 2 == 0, "FW:\t").otherwise("re : Re:"), S(), F.lit(" \n"))
    return fx.mail(spark, sf).select(
        "key",
        text.clean_subject(made, strip_prefix=True).alias("stripped"),
        text.clean_subject(made).alias("kept"),
    )


# Markup in which tags, text and references are easily mistaken; the SQL has what is seen of it.
HARD_HTML = (
    "a<template><p>T</p></template>b",
    """<a title="x>y" b='>'>q</a>""",
    "<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>",
    "1 < 2 &amp;lt; <!-- <p>c</p> -->",
    """<SCRIPT type="t">if (a</b) "</p>"</SCRIPT >s""",
    "a<template>x<template>y</template>z</template>b",
    "<ruby>漢<rt>k<b>a</b>n</rt></ruby>字",
)


@query("html_to_text")
def html_text(spark, sf):
    """Whole pages, each with a piece of hard markup in front."""
    hard = F.get(F.array(*map(F.lit, HARD_HTML)), (F.col("page_id") % len(HARD_HTML)).cast("int"))
    page = F.concat(hard, F.lit(" "), F.col("html"))
    return fx.table(spark, sf, "pages").select("page_id", html_to_text(page).alias("text"))


# --- filters, de-duplication, funnel ------------------------------------------------


def _cleaned(spark, sf):
    return clean.clean_text(fx.mail(spark, sf))


@query
def filter_subject(spark, sf):
    return _cleaned(spark, sf).filter(clean.has_subject()).select("key", "subject")


@query
def filter_body(spark, sf):
    return _cleaned(spark, sf).filter(clean.has_body()).select("key")


@query
def filter_body_min(spark, sf):
    return _cleaned(spark, sf).filter(clean.has_body(20)).select("key")


@query
def filter_short(spark, sf):
    kept = _cleaned(spark, sf).filter(clean.long_enough(20))
    return kept.select("key", (text.n_chars(S()) + text.n_chars(B())).alias("n_chars"))


@query("dedup_exact")
def dedup_first(spark, sf):
    """Copies under several sources: the lowest source id wins, then the lowest key."""
    kept = dedup_exact(_cleaned(spark, sf), order=["dataset", "key"])
    return kept.select("key", "dataset", "subject", "body")


@query
def clean_funnel(spark, sf):
    return clean.funnel(fx.mail(spark, sf))


@query
def clean_funnel_by_source(spark, sf):
    return clean.funnel(fx.mail(spark, sf), by=["dataset"])


@query
def clean_growing(spark, sf):
    """Mail that arrives in three batches, cleaned against the digests of those before."""
    root = scratch_path(spark, "corpus")
    marked = land(clean.mark(fx.mail(spark, sf)), "marked")
    for batch in range(3):
        growing.admit(marked.filter(K() % 3 == batch), root, batch, ["key"], buckets=8)
    return growing.admitted(spark, root).select("key", *clean.CONTRACT, F.col("batch").cast("int").alias("batch"))


@query
def clean_mail(spark, sf):
    return clean.clean(fx.mail(spark, sf), order=["key"])


@query
def clean_mail_raw(spark, sf):
    """Raw messages parsed, reply marks dropped, filtered and de-duplicated."""
    parsed = parse.parse_messages(raw_mail(spark, sf).select("key", "message"))
    stamped = parse.stamp(parse.drop_unparsed(parsed), 0, 1)
    return clean.clean(stamped, clean.RAW_MESSAGE, order=["key"])


@query
def clean_mail_html(spark, sf):
    """Pages as HTML mail: title from the address, markup removed, short bodies dropped."""
    pages = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("key"), F.col("url").alias("subject"), F.col("html").alias("body")
    )
    return clean.clean(parse.stamp(pages, 1, 2), clean.HTML_MAIL, order=["key"])


# --- assembly ---------------------------------------------------------------------------


@query
def union_sources(spark, sf):
    mails = clean.to_contract(fx.mail(spark, sf), "key")
    legit, phishing = mails.filter("dataset = 1"), mails.filter("dataset > 1")
    return assemble.union_sources(legit, phishing, phishing).select("key", "dataset", "subject")


@query
def balance_classes(spark, sf):
    return balanced(spark, sf).select("key", "label", "dataset", "subject")


@query
def shuffle_order(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return assemble.with_index(docs)


@query
def stratified_split(spark, sf):
    return split_mail(spark, sf).select("key", "label", "split")


@query
def class_counts(spark, sf):
    return assemble.class_counts(split_mail(spark, sf))


@query
def source_label_counts(spark, sf):
    return assemble.source_label_counts(fx.labelled_mail(spark, sf))


@query
def split_sizes(spark, sf):
    return assemble.split_sizes(split_mail(spark, sf))


@query
def sample_at_most(spark, sf):
    return assemble.sample_at_most(labelled(spark, sf), 100).select("key", "label")


@query
def head_n(spark, sf):
    return assemble.head_n(fx.clean_mail(spark, sf), 200).select("key", "subject", "label")


@query
def build_dataset(spark, sf):
    """Legitimate mail and HTML mail cleaned, united, balanced, split and shuffled."""
    legit = parse.stamp(fx.mail(spark, sf).filter("dataset = 1"), 0, 1)
    pages = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("key"), F.col("url").alias("subject"), F.col("html").alias("body")
    )
    cleaned = [
        clean.to_contract(clean.clean(legit, clean.RAW_MESSAGE, ["key"])),
        clean.to_contract(clean.clean(parse.stamp(pages, 1, 2), clean.HTML_MAIL, ["key"])),
    ]
    return corpus.build_dataset(*cleaned).drop("body")


@query
def training_rows(spark, sf):
    rows = training.training_rows(labelled(spark, sf))
    return rows.select("key", "prompt", "full")


# --- prompts and training rows ------------------------------------------------------------


@query
def label_word(spark, sf):
    padded = F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("\n"))
    return fx.mail(spark, sf).select(
        "key", text.label_word(F.col("label")).alias("word"), text.label_word(padded).alias("padded")
    )


@query
def mail_text(spark, sf):
    return fx.mail(spark, sf).select("key", text.mail_text(S(), F.when(K() % 4 != 0, B())).alias("text"))


@query
def tagged_text(spark, sf):
    return fx.mail(spark, sf).select("key", text.tagged_text(F.when(K() % 4 != 0, S()), B()).alias("text"))


@query
def compact_text(spark, sf):
    return fx.mail(spark, sf).select("key", text.compact_text(text.mail_text(S(), B()), 600).alias("text"))


@query
def fill_template(spark, sf):
    tricky = F.concat(F.lit("{body} "), S())
    filled = text.fill_template(chat.CLASSIFIER_TEMPLATE, tricky, B())
    return fx.mail(spark, sf).select("key", filled.alias("prompt"))


@query
def chat_messages_body(spark, sf):
    """What is asked about a pasted text, shortened."""
    rows = prompts.add_messages(fx.mail(spark, sf), chat.EVAL_SYSTEM, with_answer=False, max_chars=600, body_only=True)
    return rows.select("key", chat.render_chat(F.col("messages"), add_cue=True).alias("prompt"))


@query
def chat_messages(spark, sf):
    rows = prompts.add_messages(fx.labelled_mail(spark, sf))
    turn = F.explode("messages").alias("m")
    return rows.select("key", turn).select("key", "m.role", "m.content")


@query
def render_chat(spark, sf):
    """Turns of whole conversations, one piece per turn."""
    return prompts.render_turns(fx.table(spark, sf, "conversations"), add_cue=True)


TOOLS = [
    {
        "type": "function",
        "function": {"name": "look_up", "description": "Finde « Absender »", "parameters": {"type": "object"}},
    }
]


@query
def render_chat_tools(spark, sf):
    """Every third turn a tool reply, so that replies stand alone and side by side."""
    turns = fx.table(spark, sf, "conversations")
    role = F.when((F.col("turn") + F.col("conv_id")) % 3 == 2, "tool").otherwise(F.col("role"))
    role = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") > 1), "tool").otherwise(role)
    look_up = F.struct(F.lit("look_up").alias("name"), F.concat(F.lit('{"turn": '), "turn", F.lit("}")).alias("arguments"))
    # None, one or two calls in a turn, with words before them or without.
    calls = F.array_repeat(look_up, (F.col("conv_id") % 3).cast("int"))
    words = F.when((F.col("conv_id") + F.col("turn")) % 4 == 1, "").otherwise(F.col("text"))
    made = turns.withColumns({"role": role, "calls": calls, "text": words})
    return prompts.render_turns(made, tools=TOOLS, tool_calls="calls")


@query
def render_chat_mail(spark, sf):
    """The chat of each mail as one text, for training and for asking."""
    mails = fx.labelled_mail(spark, sf)
    full = prompts.add_messages(mails).withColumn("full", chat.render_chat(F.col("messages")))
    asked = prompts.add_messages(full, with_answer=False)
    prompt = chat.render_chat(F.col("messages"), add_cue=True)
    return asked.select("key", "full", prompt.alias("prompt"))


@query("instruction_rows")
def instruction_records(spark, sf):
    return prompts.instruction_json(fx.labelled_mail(spark, sf)).select("key", "record")


@query
def answer_only_labels(spark, sf):
    """Tokens are the blank-separated words of the rendered chat, ids their lengths."""

    def ids(c: Column) -> Column:
        return F.transform(F.split(c, " "), F.length)

    mails = prompts.add_messages(fx.labelled_mail(spark, sf), with_answer=False)
    prompt = chat.render_chat(F.col("messages"))
    full = F.concat(prompt, F.lit(" the answer is "), text.label_word(F.col("label")))
    labels = chat.answer_only_labels(ids(prompt), ids(full), 256)
    joined = F.array_join(F.transform(labels, lambda x: x.cast("string")), " ")
    return mails.select("key", F.size(labels).alias("n_labels"), joined.alias("labels"))


@query
def resolve_columns(spark, sf):
    """Documents have a `text` but no subject; without a body the subject stands in."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    with_body = prompts.resolve_mail_columns(docs)
    titled = docs.select("key", fx.before_newline(F.col("text")).alias("title"))
    return with_body.unionByName(prompts.resolve_mail_columns(titled))


@query
def mail_at(spark, sf):
    indexed = assemble.with_index(labelled(spark, sf))
    in_range = prompts.mail_at(indexed, 7)
    return in_range.unionByName(prompts.mail_at(indexed, -1)).select("index", "key", "subject")


@query
def compact_keep_links(spark, sf):
    """Every shipped word, and a link, in place of a common word."""
    words = F.array(*map(F.lit, prompts.SENSITIVE_WORDS))
    word = F.concat(F.lit(" "), F.get(words, (K() % 15).cast("int")), F.lit(" "))
    sign = F.when(K() % 4 == 3, " http://x.example/y?z=1 ").otherwise(word)
    return fx.clean_mail(spark, sf).select(
        "key",
        prompts.compact_keep_links(S(), F.replace(B(), F.lit(" the "), sign), 400).alias("text"),
    )


# --- answers, policy, training ----------------------------------------------------------------


@query
def parse_answer_any(spark, sf):
    answer = F.col("raw_prediction")
    parsed = answers.parse_answer_any(answer)
    return fx.pred(spark, sf).select(
        "key", parsed.alias("label"), answers.invalid_as_text(parsed).alias("as_text")
    )


@query
def parse_answer_first(spark, sf):
    parsed = answers.parse_answer_first(F.col("raw_prediction"))
    return fx.pred(spark, sf).select(
        "key", parsed.alias("label"), answers.invalid_as_number(parsed).alias("as_number")
    )


@query
def prediction_rows(spark, sf):
    return answered(spark, sf).withColumnRenamed("key", "index")


def _gate_input(spark, sf):
    return fx.pred(spark, sf).select(
        "key", "raw_prediction", F.when(K() % 13 == 0, " \n").otherwise(B()).alias("email_text")
    )


GATE_COLUMNS = ("key", "response", "risk_score", "risk_level", "action", "reason")


@query
def policy_gate(spark, sf):
    rows = land(_gate_input(spark, sf), "gate_input")
    outcomes = [
        policy.gate(rows, t, display=True)
        .select(*GATE_COLUMNS, "shown_level", "shown_action", "shown_details")
        .withColumn("threshold", F.lit(t))
        for t in (0.0, 0.5, 0.55, 1.0)
    ]
    return assemble.union_sources(*outcomes)


@query
def classify_batch(spark, sf):
    """Train on all labelled mail and answer for it: what must hold of any trained model."""
    rows = labelled(spark, sf)
    scored = land(classify.score(rows, classify.fit_classifier(rows)), "scored")
    p, answer = F.col("p_phishing"), F.col("raw_prediction")
    unsure = (answer == "unsure") & (F.abs(p - 0.5) < 0.05)
    sure = (answer == F.when(p >= 0.5, "phishing").otherwise("legitimate")) & (F.abs(p - 0.5) >= 0.05)
    right = F.count_if((p >= 0.5).cast("int") == F.col("label"))
    majority = F.greatest(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1))
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(p.between(0, 1)).alias("in_range"),
        F.count_if(unsure | sure).alias("agreeing"),
        (right > majority).alias("beats_majority"),
    )


@query
def score_answers(spark, sf):
    """Answers for made-up probabilities: two margins, and probabilities that are missing."""
    p = p_of(K())
    return fx.labelled_mail(spark, sf).select(
        "key",
        classify.answer_of(p, 0.05).alias("narrow"),
        classify.answer_of(p, 0.4).alias("wide"),
        classify.answer_of(F.when(K() % 5 != 0, p)).alias("holed"),
    )


def _stand_in():
    """A model whose answer depends on the whole prompt."""
    answers_by_size = ["Phishing.", "legitimate", "not legitimate but phishing", "?"]
    return lambda prompts: [answers_by_size[len(p) % 4] for p in prompts]


@query
def predict_run(spark, sf):
    """Mails asked about, answered, parsed and judged in one job."""
    rows = labelled(spark, sf).withColumnRenamed("key", "index")
    tables = prediction.predict_run(rows, _stand_in, parse=answers.parse_answer_first)
    return _rounded(tables["report"], *evaluate.RATIOS).drop("Conservative accuracy")


@query
def predict_resumed(spark, sf):
    """The same in shards: a run that ends after one job, another that answers the rest."""
    rows = labelled(spark, sf).withColumnRenamed("key", "index")
    root = scratch_path(spark, "run")
    shards = prediction.start_run(rows, root, shard_mails=100)
    prediction.resume_run(spark, root, _stand_in, at_once=-(-shards // 3), most_jobs=1)
    prediction.start_run(rows, root, shard_mails=100)
    prediction.resume_run(spark, root, _stand_in)
    tables = prediction.finish_run(spark, root, parse=answers.parse_answer_first)
    return _rounded(tables["report"], *evaluate.RATIOS).drop("Conservative accuracy")


@query
def log_loss(spark, sf):
    rows = fx.labelled_mail(spark, sf).withColumn("p_phishing", p_of(K()))
    loss = classify.log_loss(rows, by=["dataset"])
    return loss.select("dataset", F.round("loss", 6).alias("loss"))


@query
def log_loss_batched(spark, sf):
    rows = assemble.with_index(labelled(spark, sf)).withColumn("p_phishing", p_of(K()))
    capped = classify.log_loss(rows, index="index", batch_size=16, max_batches=10)
    return capped.select(F.round("loss", 6).alias("loss"))


@query
def log_loss_all_batches(spark, sf):
    rows = assemble.with_index(labelled(spark, sf)).withColumn("p_phishing", p_of(K()))
    every = classify.log_loss(rows, index="index", batch_size=16)
    return every.select(F.round("loss", 6).alias("loss"))


@query
def best_candidate(spark, sf):
    epochs = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("epoch")
    rows = fx.labelled_mail(spark, sf).select("key", "label", epochs)
    losses = classify.log_loss(rows.withColumn("p_phishing", p_of(K(), F.col("epoch"))), by=["epoch"])
    best = classify.best_candidate(losses)
    return best.select("epoch", F.round("loss", 6).alias("loss"))


# --- evaluation -----------------------------------------------------------------------------


@query
def confusion(spark, sf):
    return evaluate.confusion(answered(spark, sf))


@query
def validity(spark, sf):
    return evaluate.validity(answered(spark, sf))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


@query
def quality_overall(spark, sf):
    metrics = evaluate.quality(answered(spark, sf))
    return _rounded(metrics, *evaluate.RATIOS).drop("Conservative accuracy")


@query
def quality_conservative(spark, sf):
    metrics = evaluate.quality(answered(spark, sf))
    return _rounded(metrics.select("total", "Conservative accuracy"), "Conservative accuracy")


@query
def quality_by_source(spark, sf):
    metrics = evaluate.quality(answered(spark, sf), ["dataset"])
    return _rounded(metrics, *evaluate.RATIOS).drop("Conservative accuracy").orderBy("dataset")


@query
def quality_report(spark, sf):
    """Overall and per source from one aggregation."""
    metrics = evaluate.quality_report(answered(spark, sf))
    return _rounded(metrics, *evaluate.RATIOS).drop("Conservative accuracy")


@query
def compare_runs(spark, sf):
    rows = land(fx.pred(spark, sf), "runs")
    before = policy.prediction_rows(rows, parse=answers.parse_answer_any, index="key")
    after = policy.prediction_rows(rows, parse=answers.parse_answer_first, index="key")
    runs = {"any mention": evaluate.quality(before), "first mention": evaluate.quality(after)}
    return _rounded(evaluate.compare_runs(runs), *evaluate.RATIOS)


@query
def check_targets(spark, sf):
    metrics = evaluate.quality(answered(spark, sf)).select(*evaluate.RATIOS)
    return _rounded(evaluate.check_targets(metrics), "value")


# --- streaming --------------------------------------------------------------------------------


@query
def gate_stream(spark, sf):
    """HTML mails as a stream of files, cleaned as for training, scored by what is left of them."""
    arriving = scratch_path(spark, "arriving")
    pages = fx.table(spark, sf, "pages")
    body = F.when(F.col("page_id") % 13 == 0, " \n").otherwise(F.col("html")).alias("body")
    pages.select(F.col("page_id").alias("key"), F.col("url").alias("subject"), body).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(arriving)
    path = scratch_path(spark, "decisions")
    state = scratch_path(spark, "gate_state")

    def score(df: DataFrame) -> DataFrame:
        p = F.length("body") % 100 / F.lit(100.0)
        return df.withColumn("raw_prediction", classify.answer_of(p, 0.05))

    running = streaming_gate.gate_stream(
        stream, score, path, state, available_now=True, profile=clean.HTML_MAIL
    )
    running.awaitTermination()
    return spark.read.parquet(path).select(*GATE_COLUMNS)


#: Bytes of mail in a file of a stream, and files of a stream at least.
FILE_BYTES, LEAST_FILES = 64 << 20, 6


def _arriving(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Mails as a stream of files in two batches, in no order, every second one twice; its folder."""
    path = scratch_path(spark, "arriving")
    mails = fx.mail(spark, sf)
    copies = F.explode(F.when(K() % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + (K() * 7919 + F.col("copy") * 611) % 86_400)
    twice = mails.select("key", "subject", "body", copies.alias("copy")).withColumn("arrived", arrived)
    size = F.coalesce(F.octet_length("subject"), F.lit(0)) + F.coalesce(F.octet_length("body"), F.lit(0))
    total = twice.agg(F.sum(size.cast("long")).alias("n")).first().n or 0
    files = max(LEAST_FILES, -(-total // FILE_BYTES))
    twice.repartition(files, "copy", "key").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path), path


def _length_score(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_prediction", classify.answer_of(F.length("body") % 100 / F.lit(100.0), 0.05))


@query
def gate_stream_once(spark, sf):
    """A stream of mails with copies: one decision for each text that passes the filters."""
    stream, _ = _arriving(spark, sf)
    path, state = scratch_path(spark, "decisions"), scratch_path(spark, "state")
    streaming_gate.gate_stream_once(stream, _length_score, path, state, "arrived", available_now=True).awaitTermination()
    return spark.read.parquet(path).select("subject", "body", *GATE_COLUMNS[1:])


@query
def gate_stream_funnel(spark, sf):
    """What became of the mails of a stream, counted while they passed."""
    stream, _ = _arriving(spark, sf)
    counts, path, *state = (scratch_path(spark, n) for n in ("counts", "decisions", "state", "state"))
    streaming_gate.funnel_stream(stream, counts, state[0], "arrived", "1 hour", available_now=True).awaitTermination()
    streaming_gate.gate_stream_once(stream, _length_score, path, state[1], "arrived", available_now=True).awaitTermination()
    return streaming_gate.stream_funnel(spark, counts, path)
