"""Packing documents into training sequences, shortest pack first over a histogram."""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import SMALL_CACHE_ENTRIES, halve, id_and_text, kept, map_rows, small_batches
from mailsift.llm.tokens import byte_symbols, chunks, read_vocabulary
from mailsift.sources.scratch import land

SEQUENCE_LENGTH, END_ID = 2048, 1
#: How byte-level vocabularies of this kind split text before they merge; a fixed value.
TIKTOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length are numbered in so many parts; a fixed number, whatever the input.
RANK_PARTS = 4096

#: Room for ranks beside a length in one 64-bit number.
_SHIFT = 48
_PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# --- tokens -------------------------------------------------------------------------


#: Longer strings go to the library itself, whose time is bounded for any text.
_LONG_CHUNK = 1000


class Encoded(dict):
    """Ids, as little-endian 32-bit numbers, of a chunk with the space in front of it."""

    def __init__(self, path: str, entries: int | None = None):
        self.entries = entries or SMALL_CACHE_ENTRIES
        self.path = path
        self.merged, self.special = _by_ranks(path)
        self.merged = self.merged or self._by_library

    @functools.cached_property
    def tokenizer(self):
        """The file's own library, read when a text is met that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return _bytes((self.merged if len(text) <= _LONG_CHUNK else self._by_library)(text))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.whole(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                halve(self)
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return _bytes(self._by_library(text))
        parts = iter(chunks(text))
        return self.whole(next(parts)) + b"".join(map(self.__getitem__, parts))


def _by_ranks(path: str):
    """The merges of a vocabulary file as ranks, which a lighter library applies to words.

    Only where ids stand in the order of the merges, so that ranks are ids; the results
    are then those of the file's own library. With the special strings of the file.
    """
    import tiktoken

    ranks, special = read_vocabulary(path)
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    if any(ids.get(a + b) != 256 + rank for (a, b), rank in ranks.items()):
        return None, special
    byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
    as_bytes = {bytes(byte_of[c] for c in token): i for token, i in ids.items() if i < 256 + len(ranks)}
    encoding = tiktoken.Encoding("ranks", pat_str=TIKTOKEN_PATTERN, mergeable_ranks=as_bytes, special_tokens={})
    return encoding.encode_ordinary, special


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def cut(
    docs: DataFrame, vocabulary: str, length: int = SEQUENCE_LENGTH, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenize every text, close it with the end id, and cut it into pieces.

    Full pieces of ``length`` ids come first, the rest is the last piece. A null text is
    an empty one: it has the end id alone.
    """

    def make():
        encoded = kept(Encoded, vocabulary)
        end = _bytes([END_ID])

        def row(i, value):
            ids = encoded.encode(value or "") + end
            n = len(ids) // 4
            for start in range(0, n, length):
                piece = ids[4 * start : 4 * (start + length)]
                yield i, start, len(piece) // 4, zlib.crc32(piece), n

        return row

    return map_rows(id_and_text(docs, key, text), ["id", "text"], make, PIECES)


# --- patterns -----------------------------------------------------------------------


def patterns_of(histogram: dict[int, int], length: int = SEQUENCE_LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (the lengths in a sequence, in order) with how many use each.

    Lengths are placed longest first, each into the emptiest open pack it fits, all packs
    of one pattern at a time; when it fits none, just as many packs open as copies of the
    length fill. So only the counts of patterns change, never single packs, and the work
    depends on the number of lengths alone.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, p in packs.items() if p and r >= size), default=None)
            if room is None:
                each = length // size
                for copies, n in ((each, left // each), (left % each, 1)):
                    if copies and n:
                        packs[length - copies * size].append(((size,) * copies, n))
                break
            pattern, n = packs[room].pop()
            used = min(n, left)
            if n > used:
                packs[room].append((pattern, n - used))
            packs[room - size].append((pattern + (size,), used))
            left -= used
    return sorted((p for group in packs.values() for p in group), reverse=True)


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, ranks, first sequence, offset`` of every slot of every pattern.

    A slot of a pattern that n sequences use takes the next n ranks of its length.
    """
    ranks: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            slots.append((size, ranks[size], n, sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    return slots


def ranked(pieces: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """Number the pieces of each length 0, 1, 2, ...; no length is sorted in one task.

    A length is dealt into a fixed number of parts by hash; counts of parts, at most
    ``parts`` rows a length, give every part its first rank.
    """
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).alias("part")
    dealt = pieces.select("*", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = sizes.select("length", "part", before.alias("first"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(own) - 1)
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .drop("part", "first")
    )


def pack(
    docs: DataFrame, vocabulary: str, length: int = SEQUENCE_LENGTH, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Place all tokens of all documents in sequences of at most ``length``.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Texts are read once, to cut them; only the cut pieces, a few numbers each,
    are written and shuffled. Their lengths form a histogram of at most ``length`` bins,
    over which the packing patterns are made on the driver; pieces then meet the slots of
    the patterns by length and rank.

    A null or empty text is one piece of one token. Long texts are cut, never cropped.
    Repeated rows and null ids are packed like all others, in an order that does not
    depend on partitions. An empty table gives no rows. Extra columns are not read.
    """
    with small_batches(docs.sparkSession):
        pieces = land(cut(docs, vocabulary, length, key, text), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(patterns_of(histogram, length))
    return placed(ranked(pieces), slots)


def placed(pieces: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Give every ranked piece its sequence and offset.

    The slots of a length hold its ranks without gaps, so the slot of a rank is the last
    one that begins at or before it: a search in one sorted array, as large as the
    patterns, whatever the number of pieces.
    """
    if not slots:
        return pieces.selectExpr("*", "0L AS sequence_id", "0L AS offset").drop("rank")
    size, first, _, sequence, offset = np.array(sorted(slots), np.int64).T
    at = pieces.sparkSession.sparkContext.broadcast((size << _SHIFT | first, first, sequence, offset))

    def run(batches):
        starts, first, sequence, offset = at.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(starts, batch.column("length").to_numpy() << _SHIFT | rank, "right") - 1
            found = (sequence[slot] + rank - first[slot], offset[slot])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=_PLACED)

    columns = [f.split()[0] for f in PIECES.split(", ")]
    return pieces.select(*columns, F.col("rank").cast("long")).mapInArrow(
        run, f"{PIECES}, sequence_id bigint, offset bigint"
    )
