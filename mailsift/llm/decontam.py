"""Benchmark decontamination by templates: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import with_ids
from mailsift.sources.scratch import land

#: Tokens in a window, and the least tokens an item needs to be told from chance.
WINDOW, LEAST_TOKENS = 5, 5
#: Share of an item's windows that a document must hold, or else
COVERAGE = 0.5
#: the share of its tokens that lie in such windows, or else
TOKEN_COVERAGE = 0.8
#: the tokens in a row.
RUN = 13
#: Benchmarks up to this many windows (some 40 bytes each) are broadcast; larger ones are
#: shuffled like any other table.
MOST_BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = "#number", "#name", "#unit"
#: Units of measure and money; a fixed list.
UNITS = (
    "cent cents centimeter centimeters centimetre centimetres cm day days degree degrees dollar dollars euro euros "
    "feet foot gallon gallons gram grams hour hours hr hrs inch inches kg kilogram kilograms kilometer kilometers "
    "kilometre kilometres km kmh lb lbs liter liters litre litres meter meters metre metres mg mile miles "
    "milliliter milliliters millimeter millimeters minute minutes ml mm month months mph ounce ounces oz pence "
    "percent pound pounds second seconds sec secs ton tonne tonnes tons week weeks yard yards year years"
).split()

_STARTED = "\x01"
#: Where a sentence begins; its first word says nothing by its capital.
_SENTENCE = r"(^|[.!?:;\n][ \t\n\r\"'(]*)(\p{Lu})"
_TOKEN = r"\x01?[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*"


def tokens_of(text: Column) -> Column:
    """Words and numbers of a text in order, sentence starts marked."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _SENTENCE, f"$1{_STARTED}$2")
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def symbol_of(token: Column) -> Column:
    """What stands for a token in a template: its type, or the word in lower case.

    Numbers begin with a digit. Units are words of a fixed list. Names begin with a
    capital, go on in small letters, and do not begin a sentence.
    """
    low = F.lower(token)
    first, rest = F.substring(token, 1, 1), F.substring(token, 2, 1)
    plain = F.ltrim(low, F.lit(_STARTED))
    return (
        F.when(first.between("0", "9"), NUMBER)
        .when(plain.isin(UNITS), UNIT)
        .when((first != F.lower(first)) & (rest != "") & (token == F.concat(first, F.substring(low, 2, 1 << 20))), NAME)
        .otherwise(plain)
    )


def _once(*columns: Column) -> Column:
    """Columns that must not be worked out again wherever they are used."""
    return F.inline(F.array(F.struct(*columns)))


def templates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, tokens, symbols`` of every text."""
    taken = df.select(F.col(key).alias("id"), _once(tokens_of(F.col(text)).alias("tokens")))
    return taken.select("id", "tokens", _once(F.transform("tokens", symbol_of).alias("symbols")))


def window_hashes(symbols: Column, width: int = WINDOW) -> Column:
    """``place, hash`` of every run of so many symbols, as an array."""
    last = F.size(symbols) - width
    # A shorter text has no run, and a sequence must not count down.
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def run(i: Column) -> Column:
        return F.struct(i.alias("place"), F.xxhash64(*[F.get(symbols, i + k) for k in range(width)]).alias("hash"))

    return F.transform(at, run)


def _tells(symbols: Column, place: Column) -> Column:
    """Whether a window holds a word: one of placeholders alone is in every table of numbers."""
    return F.exists(F.slice(symbols, place + 1, WINDOW), lambda s: ~F.startswith(s, F.lit("#")))


def benchmark_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item_id, item_windows, item_telling, item_place, hash`` of every item that is long enough.

    Windows of placeholders alone are counted in ``item_windows`` but left out.
    """
    shaped = templates(items, key, text).filter(F.size("symbols") >= LEAST_TOKENS)
    per_item = shaped.groupBy("id").agg(F.max_by("symbols", F.size("symbols")).alias("symbols"))
    telling = F.filter(window_hashes(F.col("symbols")), lambda w: _tells(F.col("symbols"), w["place"]))
    windows = per_item.select(
        F.col("id").alias("item_id"),
        (F.size("symbols") - WINDOW + 1).cast("long").alias("item_windows"),
        _once(telling.alias("w")),
    )
    return windows.select(
        "item_id", "item_windows", F.size("w").cast("long").alias("item_telling"), F.inline("w").alias("item_place", "hash")
    )


def _covered(places: Column) -> Column:
    """The places of an item's tokens that lie in windows at these places."""
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + (WINDOW - 1)))))


def _longest(places: Column) -> Column:
    """Tokens in the longest run of windows that follow each other; places are distinct."""

    def step(run: Column, place: Column) -> Column:
        now = F.when(place == run["last"] + 1, run["now"] + 1).otherwise(1)
        return F.struct(
            place.alias("last"), now.alias("now"), F.greatest(run["most"], now).alias("most")
        )

    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.array_sort(places), start, step, lambda run: run["most"] + (WINDOW - 1))


def _enough_windows(coverage: float) -> Column:
    """The share of an item's windows, or all that have words where those are fewer."""
    return F.least(coverage * F.col("item_windows"), F.col("item_telling").cast("double"))


def _item_tokens() -> Column:
    return F.col("item_windows") + (WINDOW - 1)


def _reported(places: Column, longest: Column, coverage: float) -> Column:
    """Whether an item's matched places, or its longest run, are enough of it."""
    return (
        (F.size(places) >= _enough_windows(coverage))
        | (longest >= RUN)
        | (F.size(_covered(places)) >= TOKEN_COVERAGE * _item_tokens())
    )


_PAIR = ("doc_id", "item_id", "item_windows", "item_telling")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    coverage: float = COVERAGE,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents that hold benchmark items, word for word or with other parameters.

    One row per document and item: ``doc_id, item_id, item_windows, matched, longest_run,
    reworded``. Texts become templates: numbers, names and units turn into typed
    placeholders, other words into lower case, everything else is a separator. Windows of
    five template symbols, of which one is a word, are hash-joined with those of the
    benchmark; ``matched`` counts the item's windows found in the document, and
    ``longest_run`` the tokens in the longest row of them. A pair is reported if at least
    ``coverage`` of the windows are found (all that hold a word, where those are fewer), or
    windows over 80 % of the item's tokens (a word changed here and there), or 13 tokens in
    a row (an excerpt of a long item), by alignments whose slots are consistent: where the
    item repeats a number, name or unit, the document must repeat one too. ``reworded``
    tells whether a slot has other contents than in the item.

    The benchmark's windows are broadcast up to a stated number and shuffled beyond it. A
    document's own hits are counted in the task that reads it, so a passage in a third of
    all documents makes one row per document and item. Slots are compared only for the
    few pairs that are left.

    Null and empty texts hold nothing. Items with fewer than five tokens, or of numbers,
    names and units alone, cannot be told from chance and match nothing. Rows that repeat an id are one document or item (of
    repeated items the longest text counts). Rows with a null id are not reported. Empty
    tables give no rows; extra columns are not read.
    """
    docs = docs.filter(F.col(key).isNotNull())
    items = items.filter(F.col(item_key).isNotNull())
    windows = land(benchmark_windows(items, item_key, item_text), "benchmark_windows")
    few = windows.count() <= MOST_BROADCAST_WINDOWS
    shaped = templates(docs, key, text).select("id", _once(window_hashes(F.col("symbols")).alias("w")))
    found = shaped.select(F.col("id").alias("doc_id"), F.inline("w").alias("place", "hash"))
    hits = (
        found.join(F.broadcast(windows) if few else windows, "hash")
        .groupBy(*_PAIR, (F.col("place") - F.col("item_place")).alias("shift"))
        .agg(F.collect_set("item_place").alias("places"))
    )
    in_all = F.array_distinct(F.flatten(F.col("aligned.places")))
    longest = F.array_max(F.transform("aligned", lambda a: _longest(a["places"])))
    # What any of the three ways needs at least. Stray hits of common words never add up to
    # it; most pairs end here.
    least = F.least(
        _enough_windows(coverage), F.lit(float(RUN - WINDOW + 1)), TOKEN_COVERAGE / WINDOW * _item_tokens()
    )
    pairs = land(
        hits.groupBy(*_PAIR)
        .agg(F.collect_list(F.struct("shift", "places")).alias("aligned"))
        .filter(F.size(in_all) >= least)
        .filter(_reported(in_all, longest, coverage)),
        "aligned",
    )
    return _consistent(pairs, docs, items, coverage, key, text, item_key, item_text)


def _consistent(pairs, docs, items, coverage, key, text, item_key, item_text) -> DataFrame:
    """Keep the alignments whose slots agree, and the pairs they still cover."""
    named = land(pairs.select(F.col("doc_id").alias(key)).distinct(), "named")
    doc_tokens = templates(with_ids(docs, named, key), key, text)
    doc_tokens = doc_tokens.select(F.col("id").alias("doc_id"), F.col("tokens").alias("theirs"))
    # A repeated item id stands for its longest text, as in its windows.
    item_tokens = (
        templates(items, item_key, item_text)
        .groupBy("id")
        .agg(F.max_by(F.struct("tokens", "symbols"), F.size("symbols")).alias("x"))
        .select(F.col("id").alias("item_id"), F.col("x.tokens").alias("ours"), F.col("x.symbols").alias("symbols"))
    )
    one = pairs.select(*_PAIR, F.inline("aligned")).join(item_tokens, "item_id")
    slots = F.filter(_covered(F.col("places")), lambda i: F.substring(F.get("symbols", i), 1, 1) == "#")
    slotted = one.select(*_PAIR, "shift", "places", "ours", slots.alias("slots"))
    plain = slotted.filter(F.size("slots") == 0).select(*_PAIR, "places", F.lit(False).alias("reworded"))
    contents = F.transform(
        "slots",
        lambda i: F.struct(
            F.lower(F.get("ours", i)).alias("item"), F.lower(F.get("theirs", i + F.col("shift"))).alias("doc")
        ),
    )
    filled = (
        slotted.filter(F.size("slots") > 0)
        .join(doc_tokens, "doc_id")
        .select(*_PAIR, "places", F.array_distinct(contents).alias("filled"))
        .filter(F.size("filled") == F.size(F.array_distinct(F.col("filled.item"))))
        .withColumn("reworded", F.exists("filled", lambda s: s["item"] != s["doc"]))
    )
    both = plain.union(filled.select(plain.columns))
    judged = both.groupBy(*_PAIR).agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.max(_longest(F.col("places"))).cast("long").alias("longest_run"),
        F.bool_or("reworded").alias("reworded"),
    )
    matched = F.size("places").cast("long").alias("matched")
    return judged.filter(_reported(F.col("places"), F.col("longest_run"), coverage)).select(
        "doc_id", "item_id", "item_windows", matched, "longest_run", "reworded"
    )
