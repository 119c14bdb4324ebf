"""Quality by perplexity under an n-gram model with modified Kneser-Ney smoothing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.llm.common import kept, rows_of, small_batches, with_ids
from mailsift.sources.scratch import land

ORDER = 4
#: Characters of usual surprise that every text is given besides its own.
PRIOR = 50
#: Trusted documents are dealt into so many folds, each scored by a model of the others.
FOLDS = 4
#: A word's mean surprise is taken over this many characters at least.
LEAST_WORD = 4
#: Bytes of text in a chunk, whose documents ask the model for each n-gram once.
CHUNK = 1 << 22
#: Rows of a chunk that travel together. A row of the shuffle is copied several times by the JVM,
#: and arrays of half a megabyte are garbage that it collects late.
PIECE = 128
_BUFFER = 1 << 20
#: Different n-grams that a task counts for a model, 16 bytes each, before it hands them on.
MOST_COUNTED = 500_000

# The alphabet: letters a-z, accented letters by their base, and classes of characters. In the
# n-grams of documents every other letter is a symbol of its own, by its code point, and so are
# the signs that letters bear: vowels of Indic scripts, points, accents set apart.
_ACCENTED = {
    "a": "àáâãäåæāăą", "c": "çćč", "e": "èéêëēęě", "i": "ìíîïīį", "n": "ñńň", "o": "òóôõöøœō", "s": "ßśš",
    "u": "ùúûüūů", "y": "ýÿžźż",
}
SPACE, LINE, CAPITAL, DIGIT, STOP, COMMA, MARK, SYMBOL, LETTER, OTHER = range(10)
#: Symbols of the alphabet, and n-grams of these alone.
ALPHABET = 10 + 26 + len(_ACCENTED)
GRAMS = ALPHABET**ORDER
_TABLE = 0x3000
#: Bits of a symbol in the key of an n-gram.
BITS = 16
#: Letters beyond 16 bits share, by a hash, the numbers in which no letter is found.
_BEYOND, _SHARED = 0xD800, 0xF900 - 0xD800


def _symbol_table() -> np.ndarray:
    table = np.full(_TABLE + 1, LETTER, np.uint8)
    for code in range(_TABLE):
        c = chr(code)
        if c.isspace():
            table[code] = SPACE
        elif c.isupper():
            table[code] = CAPITAL
        elif c.isnumeric():
            table[code] = DIGIT
        elif not c.isalpha():
            table[code] = OTHER
    for chars, symbol in (("\n\r", LINE), (".!?…", STOP), (",", COMMA), (";:'\"()-’“”„«»–—", MARK), ("#*$%&|<>", SYMBOL)):
        for c in chars:
            table[ord(c)] = symbol
    for i in range(26):
        table[ord("a") + i] = 10 + i
    for i, base in enumerate(_ACCENTED):
        for c in _ACCENTED[base]:
            table[ord(c)] = 36 + i
    return table


def _of_letters(c: str) -> bool:
    """Letters, and the signs they bear; variation selectors only tell how to draw a character."""
    sign = unicodedata.category(c) in ("Mn", "Mc")
    return c.isalpha() or sign and not unicodedata.name(c, "").startswith("VARIATION SELECTOR")


def _letter_table() -> np.ndarray:
    """Symbols of all scripts: those of the alphabet, other letters by their code points."""
    table = np.arange(1 << BITS, dtype=np.int32)
    table[:_TABLE] = _symbol_table()[:_TABLE]
    for code in range(1 << BITS):
        c = chr(code)
        if code < _TABLE:
            other = table[code] == LETTER or (code >= 0x0250 and table[code] in (CAPITAL, OTHER) and _of_letters(c))
            table[code] = code if other else table[code]
        elif c.isspace():
            table[code] = SPACE
        elif not _of_letters(c):
            table[code] = DIGIT if c.isnumeric() else OTHER
    for chars, symbol in (("。!?", STOP), ("、,", COMMA), (":;「」『』《》()", MARK)):
        for c in chars:
            table[ord(c)] = symbol
    return table


def _rolled(symbols: np.ndarray, base: int, dtype: type) -> np.ndarray:
    """Numbers of all n-grams of a sequence that is ``ORDER - 1`` longer than they are many."""
    n = len(symbols) - ORDER + 1
    grams = np.zeros(n, dtype)
    for i in range(ORDER):
        grams *= dtype(base)
        grams += symbols[i : i + n].astype(dtype)
    return grams


class Grams:
    """The n-grams of a text as numbers, one for each character, spaces before the first."""

    def __init__(self):
        self.table, self.letters = _symbol_table(), _letter_table()

    def of(self, text: str) -> np.ndarray:
        """Numbers below ``GRAMS``; all letters outside the alphabet are alike."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        symbols = np.full(len(codes) + ORDER - 1, SPACE, np.int32)
        symbols[ORDER - 1 :] = self.table[np.minimum(codes, _TABLE)]
        return _rolled(symbols, ALPHABET, np.int32)

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams, -1 where one has a letter outside the alphabet, and keys of those."""
        return self.split_symbols(self.symbols(text))

    def symbols(self, text: str) -> np.ndarray:
        """The symbol of each character, of all scripts, behind ``ORDER - 1`` spaces."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        symbols = np.full(len(codes) + ORDER - 1, SPACE, np.int32)
        own = symbols[ORDER - 1 :]
        own[:] = self.letters[np.minimum(codes, (1 << BITS) - 1)]
        for i in np.flatnonzero(codes >= 1 << BITS):
            code = int(codes[i])
            own[i] = _BEYOND + code * 0x9E3779B1 % (1 << 32) % _SHARED if _of_letters(chr(code)) else OTHER
        return symbols

    @staticmethod
    def split_symbols(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``split`` of a text whose symbols are there."""
        if symbols.max() < ALPHABET:
            return _rolled(symbols, ALPHABET, np.int32), np.empty(0, np.int64)
        outside = _rolled((symbols >= ALPHABET).astype(np.int32), 2, np.int32) > 0
        grams = _rolled(np.minimum(symbols, ALPHABET - 1), ALPHABET, np.int32)
        return np.where(outside, -1, grams), _rolled(symbols, 1 << BITS, np.uint64)[outside].view(np.int64)


def _keys(grams: np.ndarray) -> np.ndarray:
    """Keys of n-grams of the alphabet: their symbols, ``BITS`` bits each."""
    keys = np.zeros(len(grams), np.int64)
    for i in range(ORDER):
        keys |= (grams // ALPHABET**i % ALPHABET).astype(np.int64) << (BITS * i)
    return keys


def _numbers(keys: np.ndarray, size: int = ORDER) -> np.ndarray:
    """Numbers of n-grams from keys; -1 where a letter is outside the alphabet."""
    numbers, inside = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for i in range(size):
        symbols = keys >> (BITS * i) & ((1 << BITS) - 1)
        inside &= symbols < ALPHABET
        numbers += symbols * ALPHABET**i
    return np.where(inside, numbers, -1)


def _last(gram: Column, size: int) -> Column:
    """The last symbols of an n-gram."""
    return gram if size == ORDER else gram.bitwiseAND(F.lit((1 << BITS * size) - 1))


def _context(gram: Column) -> Column:
    """An n-gram without its last symbol."""
    return F.shiftrightunsigned(gram, BITS)


# --- counting -----------------------------------------------------------------------


class _Tally:
    """Counts of n-grams, by key: as large as they are different, added up by sorting."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        grams = np.concatenate([g for g, _ in found])
        there, times = np.unique(grams[grams >= 0], return_counts=True)
        keys, counts = np.unique(np.concatenate([k for _, k in found]), return_counts=True)
        more = np.concatenate([self.counts, times, counts])
        self.keys, places = np.unique(np.concatenate([self.keys, _keys(there), keys]), return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, places, more)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.keys, self.counts
        self.__init__()
        return out


def gram_counts(texts: DataFrame) -> DataFrame:
    """``model, gram, n`` over all rows of ``model, text``; each task adds up its own first."""

    def run(batches):
        grams, total, held, size = kept(Grams), {}, {}, 0

        def rows(model, counted):
            keys, counts = counted
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                columns = [np.full(len(part), model, np.int32), part, counts[i : i + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "gram", "n"])

        def add():
            for model, found in held.items():
                tally = total.setdefault(model, _Tally())
                tally.add(found)
                if len(tally.keys) > MOST_COUNTED:
                    yield from rows(model, tally.take())
            held.clear()

        for batch in batches:
            for model, text in rows_of(batch):
                found = grams.split(text or "")
                held.setdefault(model, []).append(found)
                size += len(found[0])
                if size >= _BUFFER:
                    yield from add()
                    size = 0
        yield from add()
        for model, tally in total.items():
            yield from rows(model, tally.take())

    counted = texts.select("model", "text").mapInArrow(run, "model int, gram bigint, n bigint")
    return counted.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def held_out_counts(counts: DataFrame) -> DataFrame:
    """From counts of each fold to those of models: number k without fold k, ``FOLDS`` with all."""
    own = [F.sum(F.when(F.col("model") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
    wide = counts.groupBy("gram").agg(F.sum("n").alias("all"), *own)
    models = [F.struct(F.lit(k).alias("model"), (F.col("all") - F.col(f"n{k}")).alias("n")) for k in range(FOLDS)]
    models.append(F.struct(F.lit(FOLDS).alias("model"), F.col("all").alias("n")))
    return wide.select("gram", F.inline(F.array(*models))).filter("n > 0").select("model", "gram", "n")


def order_counts(counts: DataFrame) -> DataFrame:
    """``model, size, gram, n`` for every order.

    The highest order has the counts themselves; each lower one counts how many symbols
    its n-grams were seen after.
    """
    levels = [counts.select("model", F.lit(ORDER).alias("size"), "gram", "n")]
    for size in range(ORDER - 1, 0, -1):
        shorter = _last(F.col("gram"), size).alias("gram")
        counts = counts.groupBy("model", shorter).agg(F.count("*").alias("n"))
        levels.append(counts.select("model", F.lit(size).alias("size"), "gram", "n"))
    all_levels = levels[0]
    for level in levels[1:]:
        all_levels = all_levels.union(level)
    return all_levels


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from counts of counts.

    Where a count of counts is zero its formula has no value and half the count is taken.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    raw = [k - (k + 1) * y * b / a if a and y else k / 2 for k, a, b in pairs]
    one, two, more = (min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))
    return one, two, more


def smoothed(levels: DataFrame) -> DataFrame:
    """``model, size, gram, kept, context, left``: the parts that interpolation is made of.

    ``kept`` is the discounted share of the n-gram in its context, ``left`` the weight
    that its context leaves to the next lower order. Counts are joined with those of their
    contexts, dealt out by model, order and context.
    """
    spark = levels.sparkSession
    sums = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    # One row for each model and order.
    found = levels.groupBy("model", "size").agg(*sums).collect()
    taken = [(r["model"], r["size"], *discounts(r.n1, r.n2, r.n3, r.n4)) for r in found]
    per_order = spark.createDataFrame(taken, "model int, size int, d1 double, d2 double, d3 double")
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = (
        levels.join(F.broadcast(per_order), ["model", "size"])
        .withColumn("context", _context(F.col("gram")))
        .withColumn("discount", discount)
    )
    contexts = counted.groupBy("model", "size", "context").agg(
        F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("left")
    )
    kept = (F.col("n") - F.col("discount")) / F.col("total")
    joined = counted.join(contexts, ["model", "size", "context"])
    return joined.select("model", "size", "gram", kept.alias("kept"), "context", "left")


class Words:
    """Places of a text's words: runs of letters that touch no digit."""

    @classmethod
    def of_all_scripts(cls, symbols: np.ndarray) -> Words:
        """From ``Grams.symbols``, where only letters and their signs are outside the alphabet."""
        own = symbols[ORDER - 1 :]
        return cls(np.where(own < ALPHABET, own, LETTER))

    def __init__(self, grams: np.ndarray):
        symbols = grams % ALPHABET
        digit = symbols == DIGIT
        inside = (symbols > OTHER) | (symbols == CAPITAL) | (symbols == LETTER) | digit
        edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        digits = np.concatenate([[0], np.cumsum(digit)])
        plain = digits[starts] == digits[ends]
        self.starts, self.ends = starts[plain], ends[plain]


@dataclass(frozen=True)
class Model:
    """Log2 probability of every n-gram's last symbol, given the others."""

    log2: np.ndarray

    def bits(self, grams: np.ndarray) -> float:
        """Bits of a text under the model."""
        return -float(self.log2[grams].sum(dtype=np.float64))

    def strangest(self, grams: np.ndarray, words: Words) -> float | None:
        """Greatest mean bits a character of a text's words."""
        if not len(words.starts):
            return None
        sums = np.concatenate([[0.0], np.cumsum(self.log2[grams], dtype=np.float64)])
        length = words.ends - words.starts
        return float(((sums[words.starts] - sums[words.ends]) / np.maximum(length, LEAST_WORD)).max())


def _interpolated(parts: pa.Table) -> Model:
    """A model of the alphabet alone from the Arrow table of its parts."""
    column = {name: parts[name].to_numpy() for name in parts.column_names}
    p = np.full(1, 1.0 / ALPHABET)  # below the single symbols, all are alike
    for size in range(1, ORDER + 1):
        own = column["size"] == size
        left = np.ones(ALPHABET ** (size - 1))
        kept = np.zeros(ALPHABET**size)
        left[_numbers(column["context"][own], size - 1)] = column["left"][own]
        kept[_numbers(column["gram"][own], size)] = column["kept"][own]
        # Lower orders forget the first symbol of the context.
        lower = np.broadcast_to(p, (ALPHABET, ALPHABET ** (size - 1))).reshape(-1) if size > 1 else p.repeat(ALPHABET)
        p = kept + np.repeat(left, ALPHABET) * lower
    return Model(np.log2(p).astype(np.float32))


def _parts(counts: DataFrame) -> DataFrame:
    return land(smoothed(land(order_counts(counts), "orders")), "smoothed")


def train(texts: DataFrame) -> Model:
    """Train on all rows of ``text``: a table of the alphabet, for texts outside Spark.

    Letters outside the alphabet are one symbol, so it has ``GRAMS`` entries, however large
    the corpus. ``classify`` keeps such letters apart and its counts in Spark tables.
    """
    counts = gram_counts(texts.select(F.lit(0).alias("model"), "text"))
    gram = F.lit(0).cast("long")
    for i in range(ORDER):
        symbol = F.shiftrightunsigned("gram", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))
        symbol = F.when(symbol < ALPHABET, symbol).otherwise(F.lit(LETTER).cast("long"))
        gram = gram.bitwiseOR(F.shiftleft(symbol, BITS * i))
    closed = counts.groupBy("model", gram.alias("gram")).agg(F.sum("n").alias("n"))
    return _interpolated(_parts(land(closed, "gram_counts")).drop("model").toArrow())


def fold(key: str = "id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int")


def train_held_out(texts: DataFrame) -> DataFrame:
    """The parts of models of ``id, text``: one without each fold of ids, and at last one of all rows."""
    with small_batches(texts.sparkSession):
        counts = land(gram_counts(texts.select(fold().alias("model"), "text")), "gram_counts")
    return _parts(held_out_counts(counts))


def probabilities(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """``model, gram, p`` of every n-gram of ``model, gram``, joined order by order.

    Counts lie in tables dealt by n-gram and by context, and so do the n-grams asked for, which
    need not have been seen. Below the single symbols all of the alphabet are alike, and all
    other letters share the place of one of them.
    """
    contexts = parts.groupBy("model", "size", "context").agg(F.first("left").alias("left"))
    lower = None
    for size in range(1, ORDER + 1):
        level = asked.select("model", _last(F.col("gram"), size).alias("gram")).distinct()
        level = level.withColumns({"context": _context(F.col("gram")), "shorter": _last(F.col("gram"), size - 1)})
        own = parts.filter(F.col("size") == size).select("model", "gram", "kept")
        around = contexts.filter(F.col("size") == size).select("model", "context", "left")
        level = level.join(own, ["model", "gram"], "left").join(around, ["model", "context"], "left")
        if lower is None:
            rare = 1.0 / (ALPHABET * ((1 << BITS) - ALPHABET))
            level = level.withColumn("below", F.when(F.col("gram") < ALPHABET, 1.0 / ALPHABET).otherwise(rare))
        else:
            below = lower.select("model", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            level = level.join(below, ["model", "shorter"])
        p = F.coalesce("kept", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("below")
        lower = level.select("model", "gram", p.alias("p"))
    return lower


# --- scoring ------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[pa.RecordBatch]]]:
    """Rows in chunks: a number, the rows, and these in pieces.

    The number is a hash of the rows, so it is the same wherever a chunk is made again.
    """

    def closed(pieces):
        digest = xxhash.xxh3_64()
        for piece in pieces:
            digest.update(piece.serialize())
        return digest.intdigest() - (1 << 63), pa.Table.from_batches(pieces), pieces

    pieces, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            pieces.append(batch.slice(start, PIECE))
            size += pieces[-1].nbytes
            if size >= CHUNK:
                yield closed(pieces)
                pieces, size = [], 0
    if pieces:
        yield closed(pieces)


def _packed(batches):
    """The pieces of chunks, a compressed row each."""
    for number, _, pieces in _chunks(batches):
        for piece in pieces:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["chunk", "payload"],
            )


def _different(texts: pa.ChunkedArray, there: np.ndarray, others: set[int]) -> None:
    """Mark the n-grams of texts: those of the alphabet in a table, the others in a set."""
    grams = kept(Grams)
    for text in texts:
        found, keys = grams.split(text.as_py() or "")
        there[found[found >= 0]] = True
        others.update(keys.tolist())


def _marked(there: np.ndarray, others: set[int]) -> Iterator[np.ndarray]:
    """Keys of marked n-grams, some at a time."""
    keys = np.concatenate([_keys(np.flatnonzero(there)), np.fromiter(others, np.int64, len(others))])
    for i in range(0, len(keys), 1 << 16):
        yield keys[i : i + (1 << 16)]


def _all_grams(batches):
    """The different n-grams of a task; some more than once if they are many."""
    there, others = np.zeros(GRAMS, bool), set()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            _different(batch.slice(start, 256)["text"], there, others)
            if len(others) > common.SMALL_CACHE_ENTRIES:
                for keys in _marked(there[:0], others):
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["gram"])
                others.clear()
    for keys in _marked(there, others):
        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["gram"])


def _chunk_grams(batches):
    """The different n-grams of every chunk."""
    for number, rows, _ in _chunks(batches):
        there, others = np.zeros(GRAMS, bool), set()
        _different(rows["text"], there, others)
        for keys in _marked(there, others):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), number)), pa.array(keys)], names=["chunk", "gram"]
            )


_MEASURED = pa.schema(
    [("id", pa.int64()), ("lang", pa.string()), ("n", pa.int64())]
    + [(name, pa.float64()) for name in ("bits", "word", "held_bits", "held_word")]
)


def _scored(chunks: pa.Table, known: pa.Table) -> pa.Table:
    """Bits of the documents of a chunk from what the models say of its n-grams."""
    grams, keys = kept(Grams), known["gram"].to_numpy()
    order = np.argsort(keys)
    keys, numbers = keys[order], _numbers(keys[order])
    # Places of n-grams among the keys, from 1; 0 is for those that are not there.
    place = np.zeros(GRAMS, np.int32)
    inside = np.flatnonzero(numbers >= 0)
    place[numbers[inside]] = inside + 1
    models = [np.append(np.float32(np.nan), known[f"m{k}"].to_numpy()[order]) for k in range(FOLDS + 1)]
    out = []
    for payload in chunks["payload"]:
        rows = pa.ipc.open_stream(payload.as_buffer()).read_all()
        for i, text, lang, part in zip(*(rows[c] for c in ("id", "text", "lang", "part"))):
            value = text.as_py() or ""
            symbols = grams.symbols(value)
            found, others = grams.split_symbols(symbols)
            at = place[found]
            if len(others):
                near = np.searchsorted(keys, others)
                there = near < len(keys)
                there[there] = keys[near[there]] == others[there]
                at[found < 0] = np.where(there, near + 1, 0)
            words = Words.of_all_scripts(symbols)
            full, held = Model(models[FOLDS]), Model(models[part.as_py()])
            row = (
                i.as_py(), lang.as_py(), len(found), full.bits(at), full.strangest(at, words),
                held.bits(at), held.strangest(at, words),
            )
            if np.isnan(row[3]):
                raise RuntimeError("the documents were not the same when they were read again")
            out.append(row)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MEASURED.types)], schema=_MEASURED)


def measured(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, lang, n, bits, word, held_bits, held_word`` of every row of ``id, text, lang``.

    Characters, their bits and those of the strangest word, under the model of all trusted
    documents and under the one that has not seen the fold of the id.

    Different n-grams of all documents are joined with the counts, order by order. Documents
    then travel in compressed chunks and meet the n-grams of their chunk: each is asked for
    once a chunk, not once a document, and no table of the model comes to a task whole.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "text", F.col("lang").cast("string"), fold().alias("part"))
    with small_batches(docs.sparkSession):
        found = land(rows.select("text").mapInArrow(_all_grams, "gram bigint").distinct(), "grams")
    every = F.explode(F.array([F.lit(k) for k in range(FOLDS + 1)])).alias("model")
    p = probabilities(parts, found.select(every, "gram"))
    log2 = F.log2("p").cast("float")
    own = [F.max(F.when(F.col("model") == k, log2)).alias(f"m{k}") for k in range(FOLDS + 1)]
    table = land(p.groupBy("gram").agg(*own), "probabilities")
    known = rows.mapInArrow(_chunk_grams, "chunk bigint, gram bigint").join(table, "gram")
    chunks = rows.mapInArrow(_packed, "chunk bigint, payload binary")
    schema = "id bigint, lang string, n bigint, bits double, word double, held_bits double, held_word double"
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_scored, schema)


def _by_language(df: DataFrame, *values: Column) -> tuple[DataFrame, dict]:
    """Aggregates of each language as a written table, and over all of them."""
    per = land(df.filter("lang is not null").groupBy("lang").agg(*values), "per_language")
    return per, df.agg(*values).first().asDict()


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _bound(own: Column, pooled: Column, beyond: Column, wider: Callable[..., Column]) -> Column:
    """A language's quantile, as far as enough trusted documents lie beyond it to tell.

    With less than one to be expected ``beyond``, its own is the extreme of a few, which
    is too narrow: the fewer there are, the more the pooled one counts, but only outwards.
    """
    weight = F.least(beyond, F.lit(1.0))
    return wider(own, weight * own + (1 - weight) * F.coalesce(pooled, own))


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    low: float = 0.001,
    high: float = 0.999,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Perplexity of every document, the bounds of its language, and whether it is kept.

    Columns ``doc_id, lang, perplexity, least, most, word, most_word, fluent, strange,
    kept``. ``trusted`` names the
    documents (column ``id``) that the model is trained on: interpolated modified
    Kneser-Ney over characters, all trusted texts whole. A trusted document is scored by a
    model of the other folds, as documents that no model has seen are. A few characters
    say little about a text, so ``PRIOR`` more are added to each, as surprising as the
    language's trusted characters are on average. A language's bounds are the ``low`` and
    ``high`` quantiles of the perplexities of its trusted documents. Where too few of them
    lie beyond a quantile, the bound is widened towards the quantile of all languages'
    distances from their average. Other languages, and documents without one, go by all
    trusted documents. Documents inside the bounds are ``fluent``.

    A few insults hardly move the perplexity of a text, so its strangest word counts too:
    ``word`` is the greatest mean of bits a character over runs of letters, ``most_word``
    the ``high`` quantile of the language's trusted documents, widened in the same way.
    Beyond it a document is ``strange``. Fluent documents that are not strange are kept.
    Words that are spelled like trusted ones pass, whatever they mean.

    Letters of scripts other than Latin are told apart by code point. Counts stay in Spark tables,
    which grow with the scripts and spellings found; texts are shuffled once, compressed in
    chunks, to meet the n-grams they ask for (see ``measured``).

    A null or empty text has no perplexity and is kept, as nothing speaks against it; so
    is every document when none is trusted. Repeated rows and null ids come out as they
    are; an empty table gives no rows; extra columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = land(trusted.select("id").filter("id is not null").distinct(), "trusted_ids")
    parts = train_held_out(with_ids(rows, ids))
    known = ids.withColumn("trusted", F.lit(True))
    few = ids.count() <= common.MOST_BROADCAST_IDS
    marked = measured(rows, parts).join(F.broadcast(known) if few else known, "id", "left")
    with small_batches(docs.sparkSession):
        scored = land(
            marked.select(
                "id", "lang", "n", "trusted", F.col("bits").alias("fitted_bits"),
                *[F.when(F.col("trusted"), F.col(f"held_{c}")).otherwise(F.col(c)).alias(c) for c in ("bits", "word")],
            ),
            "bits",
        )
    usual = (F.sum("bits") / F.sum("n")).alias("usual")
    fitted = (F.sum("fitted_bits") / F.sum("n")).alias("fitted")
    by_language, overall = _by_language(
        scored.filter("trusted AND n > 0"), usual, fitted, F.avg("word").alias("usual_word")
    )
    prior = F.coalesce("usual", _number(overall["usual"]), F.lit(0.0))
    surprise = (F.col("bits") + PRIOR * prior) / (F.col("n") + PRIOR)
    judged = land(
        scored.join(by_language, "lang", "left")
        .withColumn("surprise", F.when(F.col("n") > 0, surprise))
        .select(
            "id", "lang", "trusted", F.pow(F.lit(2.0), "surprise").alias("perplexity"),
            (F.col("surprise") - prior).alias("distance"), "word",
            (F.col("word") - F.coalesce("usual_word", _number(overall["usual_word"]))).alias("word_distance"),
        ),
        "perplexities",
    )
    found, pooled = _by_language(
        judged.filter("trusted AND perplexity IS NOT NULL"),
        F.count("*").alias("documents"),
        F.percentile_approx("perplexity", [low, high], 10_000).alias("bounds"),
        F.percentile_approx("distance", [low, high], 10_000).alias("distances"),
        F.count("word").alias("worded"),
        F.percentile_approx("word", high, 10_000).alias("own_word"),
        F.percentile_approx("word_distance", high, 10_000).alias("word_apart"),
    )
    over_all, apart = ([_number(x) for x in pooled[name] or [None, None]] for name in ("bounds", "distances"))
    own = [F.get("bounds", F.lit(i)) for i in (0, 1)]
    # A document that no model has seen is less of a surprise than the same in a fold left
    # out, and more than a trusted one under the model of all.
    least = _bound(own[0], F.pow(F.lit(2.0), F.col("fitted") + apart[0]), F.col("documents") * low, F.least)
    most = _bound(own[1], F.pow(F.lit(2.0), F.col("usual") + apart[1]), F.col("documents") * (1 - high), F.greatest)
    strange = F.col("usual_word") + _number(pooled["word_apart"])
    most_word = _bound(F.col("own_word"), strange, F.col("worded") * (1 - high), F.greatest)
    bounds = land(
        found.join(by_language, "lang").select(
            "lang", least.alias("least"), most.alias("most"), most_word.alias("most_word")
        ),
        "bounds",
    )
    return (
        judged.join(bounds, "lang", "left")
        .select(
            F.col("id").alias("doc_id"), "lang", "perplexity",
            F.coalesce("least", over_all[0]).alias("least"), F.coalesce("most", over_all[1]).alias("most"),
            "word", F.coalesce("most_word", _number(pooled["own_word"])).alias("most_word"),
        )
        .withColumn("fluent", F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(True)))
        .withColumn("strange", F.coalesce(F.col("word") > F.col("most_word"), F.lit(False)))
        .withColumn("kept", F.col("fluent") & ~F.col("strange"))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not as toxic."""
    good: Column = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter(good).select(F.col("doc_id").alias("id"))
