"""Token ids of documents in files, compressed by grammars that decode from any place."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.llm.common import id_and_text, kept, rows_of
from mailsift.llm.packing import Encoded, _bytes
from mailsift.sources.scratch import scratch_path

END_ID = 0
#: Ids of a block, which has a grammar of its own. A shard is one block, or more if its last
#: document is longer than that.
BLOCK = 1 << 19
#: A pair becomes a rule if it is found so often; the rarest pairs of a round are so many
#: times rarer than its most frequent; rounds end when one saves less than this share.
LEAST_COUNT, SPREAD, LEAST_GAIN = 8, 64, 1 / 32
#: Words whose ids a task keeps: those of a run of texts, at 16 bytes a word.
CACHE_WORDS = 500_000
RUN_BYTES = 16 * CACHE_WORDS
#: Words of more bytes are encoded one by one.
LONG_WORD = 1000
#: Row groups of a file, so that a reader holds a few shards at a time.
ROW_GROUP = 32 << 20

# --- words --------------------------------------------------------------------------

#: White space, before which no cut can be, in UTF-8: by its first byte if that is all, and as
#: numbers if it has two bytes or three.
_WHITE = [
    c.encode()
    for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
]
_ONE = np.isin(np.arange(256), [c[0] for c in _WHITE if len(c) == 1])
_LEAD = np.isin(np.arange(256), [c[0] for c in _WHITE if len(c) > 1])
_TWO, _THREE = ([int.from_bytes(c, "big") for c in _WHITE if len(c) == n] for n in (2, 3))


def _among(places: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``some`` places stand or would stand among others, both ascending, and which do."""
    at = np.searchsorted(places, some)
    return at, np.append(places, -1)[at] == some


def _cuts(data: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places from ``low`` to ``high`` of spaces before visible characters of the same text."""
    at = low + np.flatnonzero(data[low:high] == 32)
    place, last = _among(at, ends - 1)
    at = np.delete(at, place[last])
    lead = data[at + 1]
    white = _ONE[lead]
    longer = np.flatnonzero(_LEAD[lead])
    first, second, third = (data[np.minimum(at[longer] + n, len(data) - 1)].astype(np.int64) for n in (1, 2, 3))
    two = first << 8 | second
    white[longer] = np.isin(two, _TWO) | np.isin(two << 8 | third, _THREE)
    return at[~white]


class Words:
    """Ids of texts, by their words in UTF-8 with the space in front of them."""

    def __init__(self, path: str):
        self.encoded = Encoded(path)
        with open(path, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        # Bytes that an id stands for; a character of a vocabulary of this kind is a byte.
        self.n_bytes = np.zeros(max(ids.values(), default=0) + 1, np.int64)
        self.n_bytes[list(ids.values())] = [len(token) for token in ids]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text, in the order given. No text is null."""
        offsets, _ = _buffers(texts)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + RUN_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            yield from self._run(texts.slice(start, stop - start))
            start = stop

    def _run(self, texts: pa.Array) -> Iterator[np.ndarray]:
        offsets, data = _buffers(texts)
        marked = np.zeros(len(texts), bool)
        for s in self.encoded.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        parts, sizes, low = [np.empty(0, "<u4")], np.zeros(len(texts), np.int64), 0
        while low < len(data):
            bounds, heads = _words(data, offsets, marked, low)
            ids, counts = self._ids(data, bounds, heads)
            doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
            sizes += np.bincount(doc, counts, len(sizes)).astype(np.int64)
            parts.append(ids)
            low = int(bounds[-1])
        ids = parts[-1] if len(parts) < 3 else np.concatenate(parts)
        del parts
        stops = np.cumsum(sizes).tolist()
        for first, stop in zip([0, *stops], stops):
            yield ids[first:stop]

    def _ids(self, data: np.ndarray, bounds: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between bounds, and how many each has. Every different word is encoded once."""
        words = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        ).dictionary_encode()
        different, which = words.dictionary, words.indices.to_numpy()
        alone = np.diff(_buffers(different)[0]) > LONG_WORD
        alone[which[heads]] = True
        if self.encoded.merged == self.encoded._by_library:
            alone[:] = True
        ids, sizes = self._joined(different.filter(pa.array(~alone)))
        others = [self._alone(word) for word in different.filter(pa.array(alone)).to_pylist()]
        size, first = np.empty(len(different), np.int64), np.empty(len(different), np.int64)
        size[~alone], size[alone] = sizes, [len(i) // 4 for i in others]
        first[~alone] = np.cumsum(sizes) - sizes
        first[alone] = len(ids) + np.cumsum(size[alone]) - size[alone]
        flat = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")])
        counts = size[which]
        at = np.repeat(first[which] - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(at))
        return flat[at], counts

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin at cuts, encoded as one text, and how many each has.

        No id goes beyond a cut, so the bytes of the ids tell where words end.
        """
        offsets, data = _buffers(words)
        ids = np.frombuffer(_bytes(self.encoded.merged(data.tobytes().decode())), "<u4")
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), offsets[1:]) + 1
        return ids, np.diff(stops, prepend=0)

    def _alone(self, word: bytes) -> bytes:
        text = word.decode()
        marked = any(s in text for s in self.encoded.special)
        return self.encoded.encode(text) if marked else self.encoded.whole(text)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes of all."""
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    return offsets - first, np.frombuffer(data, np.uint8, size, first) if size else np.empty(0, np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray, marked: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin from ``low`` on and the last ends, and the places of those not at a cut.

    Words begin with texts and at cuts; a marked text, which holds a special string, is one
    word. They are those of some ``RUN_BYTES``, or one that is longer.
    """
    filled = np.diff(offsets) > 0
    begins, ends = offsets[:-1][filled], offsets[1:][filled]
    width = RUN_BYTES
    while True:
        high = min(low + width, len(data))
        at = _cuts(data, ends, low, high)
        if marked.any():
            at = at[~marked[np.searchsorted(offsets, at, "right") - 1]]
        heads = begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)]
        place, known = _among(at, heads)
        bounds = np.insert(at, place[~known], heads[~known])
        place = place[~known] + np.arange(np.count_nonzero(~known))
        if high == len(data):
            return np.append(bounds, high), place
        if len(bounds) > 1:
            return bounds, place[place < len(bounds) - 1]
        width *= 2


# --- grammars -----------------------------------------------------------------------

#: Pairs that become rules are looked up in so many slots (as a power of two) by their hash.
#: Of two pairs in one slot the rarer waits for the next round, which hashes in another way.
_SLOT_BITS = 16
#: Ids below this are numbered by a table, larger ones by sorting.
_TABLE = 1 << 22


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, ascending, and the place of each id among them."""
    if not len(ids) or int(ids.max()) >= _TABLE:
        return np.unique(ids, return_inverse=True)
    there = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(ids.max()) + 1, np.uint32)
    place[there] = np.arange(len(there))
    return there, place.take(ids)


def _frequent(keys: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that become rules in this round, ascending, and how often each is found."""
    keys = np.sort(keys)
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    counts = np.diff(np.append(first, len(keys)))
    if not len(keys) or not room or counts.max() < LEAST_COUNT:
        return keys[:0], counts[:0]
    often = np.flatnonzero(counts >= max(LEAST_COUNT, counts.max() // SPREAD))
    if len(often) > room:
        often = np.sort(often[np.argsort(-counts[often], kind="stable")[:room]])
    return keys[first[often]], counts[often]


def _places(weights: np.ndarray) -> np.ndarray:
    """Places whose pairs are replaced; no two overlap, the heavier of two goes first.

    ``weights`` has the weight of the pair at each place, 0 for none. Equal weights side by
    side are the same pair over one symbol (aaaa), of which every second place counts.
    """
    again = np.flatnonzero((weights[1:] == weights[:-1]) & (weights[1:] > 0)) + 1
    if len(again):
        begins = np.flatnonzero(np.diff(again, prepend=-2) > 1)
        along = np.arange(len(again)) - np.repeat(begins, np.diff(np.append(begins, len(again))))
        weights[again[along % 2 == 0]] = 0
    best = weights > 0
    best[1:] &= weights[1:] > weights[:-1]
    best[:-1] &= weights[:-1] > weights[1:]
    return np.flatnonzero(best)


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs by new symbols until none is frequent.

    ``ends`` has the places of the last ids of documents; no pair goes beyond one. Returns
    the symbols that are left, the places of document ends among them, the rules as pairs
    of symbols, and the different ids. These are symbols 0, 1, ...; rules are the symbols
    behind them and use earlier symbols only. A round replaces all pairs that are about as
    frequent as the most frequent one.
    """
    terminals, symbols = _numbered(ids)
    made, rules, rounds = len(terminals), [], 0
    half, whole, bits = (np.uint16, np.uint32, 16) if made < 1 << 15 else (np.uint32, np.uint64, 32)
    odd, down = 0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15, whole(2 * bits - _SLOT_BITS)
    symbols = symbols.astype(half)
    while len(symbols) > 1:
        keys = symbols[:-1].astype(whole)
        keys <<= whole(bits)
        keys |= symbols[1:]
        closed = ends[ends < len(keys)]
        pairs, counts = _frequent(np.delete(keys, closed), (1 << bits) - made)
        if not len(pairs):
            break
        # Heavier pairs are written later, so they win their slots.
        rising = np.argsort(counts, kind="stable")
        slot = ((pairs * whole(odd + 2 * rounds)) >> down)[rising]
        owner = np.zeros(1 << _SLOT_BITS, np.int32)
        weight = np.zeros(1 << _SLOT_BITS, np.int32)
        owner[slot], weight[slot] = rising, np.arange(1, len(pairs) + 1)
        key_of = pairs[owner]
        slots = ((keys * whole(odd + 2 * rounds)) >> down).astype(np.intp)
        weights = weight.take(slots)
        weights *= key_of.take(slots) == keys
        weights[closed] = 0
        at = _places(weights)
        which = owner.take(slots.take(at))
        worth = np.bincount(which, minlength=len(pairs)) >= LEAST_COUNT // 2
        still = np.flatnonzero(worth.take(which))
        at, which = at.take(still), which.take(still)
        if not len(at):
            break
        symbols[at] = (made + np.cumsum(worth) - 1).astype(half).take(which)
        ends = ends - np.searchsorted(at + 1, ends, "right")
        n = len(symbols)
        left = np.ones(n, bool)
        left[at + 1] = False
        symbols = symbols.take(np.flatnonzero(left))
        rules.append(pairs[worth])
        made, rounds = made + int(worth.sum()), rounds + 1
        if len(at) < LEAST_GAIN * n:
            break
    joined = np.concatenate(rules) if rules else np.empty(0, whole)
    return symbols, ends, np.stack([joined >> whole(bits), joined & whole((1 << bits) - 1)], 1), terminals


def expansion_lengths(rules: np.ndarray, n_terminals: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    lengths = [1] * n_terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids that symbols stand for; where they are few, only the rules that they need are written out."""
    n = len(terminals)
    needed = np.ones(len(rules), bool)
    if len(symbols) < len(rules):
        needed[:] = False
        needed[symbols[symbols >= n] - n] = True
        for i in range(len(rules) - 1, -1, -1):
            if needed[i]:
                for s in rules[i].tolist():
                    if s >= n:
                        needed[s - n] = True
    chosen = np.flatnonzero(needed)
    written = [t.to_bytes(4, "little") for t in terminals.tolist()] + [b""] * len(rules)
    for i, (a, b) in zip(chosen.tolist(), rules[chosen].tolist()):
        written[n + i] = written[a] + written[b]
    flat = np.frombuffer(b"".join(written), "<u4")
    there = np.concatenate([np.ones(n, bool), needed])
    size = np.where(there, lengths, 0)
    origin, out_size = (np.cumsum(size) - size)[symbols], lengths[symbols]
    out_start = np.cumsum(out_size) - out_size
    return flat[np.repeat(origin - out_start, out_size) + np.arange(int(out_size.sum()))]


# --- shards -------------------------------------------------------------------------

# A shard, all numbers little-endian: magic, documents, blocks; then per document its id
# (64 bits), whether that is null (8 bits), and the first id and first symbol of each and of
# the end (64 bits); then the blocks, each with: different ids, rules, symbols, bytes of a
# symbol (32 bits each), the different ids, the pairs and the expansion lengths of the rules
# (32 bits each), the symbols.
_MAGIC = b"RPG1"
_HEAD, _BLOCK_HEAD = struct.Struct("<4sII"), struct.Struct("<4I")


def write_shard(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard of whole documents: their ids, how many tokens each has, and all tokens."""
    upto = np.cumsum(sizes)
    blocks, last = [], []
    before = 0
    for start in range(0, len(ids), block):
        piece = ids[start : start + block]
        ends = upto[(upto > start) & (upto <= start + len(piece))] - 1 - start
        symbols, ends, rules, terminals = compress(piece, ends)
        last.append(before + ends + 1)
        before += len(symbols)
        width = 2 if symbols.dtype == np.uint16 else 4
        blocks += [
            _BLOCK_HEAD.pack(len(terminals), len(rules), len(symbols), width),
            terminals.astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, len(terminals))[len(terminals) :].astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    tokens = np.concatenate(([0], upto)).astype("<u8")
    first = np.concatenate([[0], *last]).astype("<u8")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(blocks) // 5)
    return b"".join([head, known.tobytes(), null.tobytes(), tokens.tobytes(), first.tobytes(), *blocks])


class _Block:
    def __init__(self, data: memoryview, at: int):
        n, n_rules, self.n_symbols, width = _BLOCK_HEAD.unpack_from(data, at)
        at += _BLOCK_HEAD.size
        self.terminals = np.frombuffer(data, "<u4", n, at)
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at + 4 * n).reshape(-1, 2)
        lengths = np.frombuffer(data, "<u4", n_rules, at + 4 * n + 8 * n_rules)
        self.lengths = np.concatenate([np.ones(n, np.int64), lengths])
        at += 4 * n + 12 * n_rules
        self.symbols = np.frombuffer(data, f"<u{width}", self.n_symbols, at).astype(np.int64)
        self.end = at + width * self.n_symbols

    def expand(self, first: int, stop: int) -> np.ndarray:
        return expand(self.symbols[first:stop], self.rules, self.terminals, self.lengths)


class Shard:
    """Documents of a shard: all of them, one, or some tokens of one."""

    def __init__(self, payload: bytes):
        data = memoryview(payload)
        magic, n, n_blocks = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        known = np.frombuffer(data, "<i8", n, at).tolist()
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if gone else i for i, gone in zip(known, null)]
        at += 9 * n
        self.tokens = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.first = np.frombuffer(data, "<u8", n + 1, at + 8 * (n + 1)).astype(np.int64)
        self._at, self._n_blocks, self._data = at + 16 * (n + 1), n_blocks, data

    @cached_property
    def blocks(self) -> list[_Block]:
        out, at = [], self._at
        for _ in range(self._n_blocks):
            out.append(_Block(self._data, at))
            at = out[-1].end
        return out

    def all_ids(self) -> Iterator[np.ndarray]:
        """Tokens of all documents, block by block."""
        for b in self.blocks:
            yield b.expand(0, b.n_symbols)

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of a document, by its place in the shard.

        Expansion lengths tell which symbols hold them; no others are expanded.
        """
        size = int(self.tokens[doc + 1] - self.tokens[doc])
        start, stop, _ = slice(start, stop).indices(size)
        out, seen, before = [np.empty(0, np.uint32)], 0, 0
        for b in self.blocks:
            low = max(int(self.first[doc]) - before, 0)
            high = min(int(self.first[doc + 1]) - before, b.n_symbols)
            before += b.n_symbols
            if low >= high:
                continue
            upto = seen + np.cumsum(b.lengths[b.symbols[low:high]])
            i, j = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left")
            if start < stop and i < len(upto):
                first = int(upto[i - 1]) if i else seen
                part = b.expand(low + int(i), min(low + int(j) + 1, high))
                out.append(part[max(start - first, 0) : max(stop - first, 0)])
            seen = int(upto[-1])
        return np.concatenate(out)


# --- files --------------------------------------------------------------------------

SHARDS = "part int, part_start bigint, docs int, n_ids bigint, payload binary"
_SHARD_FIELDS = pa.schema(
    [("part", pa.int32()), ("part_start", pa.int64()), ("docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]
)


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> None:
    """Write the tokens of all documents, each closed by the end id, in ascending order of id.

    The folder holds Parquet files of shards, one row each: ``part`` and ``part_start``
    place the shard (parts follow each other in order of id), ``payload`` is a grammar
    compressed block with the table of its documents.
    """
    spread = F.xxhash64("text")
    ordered = (
        id_and_text(docs, key, text)
        .select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("id").asc_nulls_first(), spread)
        .sortWithinPartitions(F.col("id").asc_nulls_first(), spread)
    )

    def run(batches):
        words = kept(Words, vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        part, written = TaskContext.get().partitionId(), 0
        doc_ids, sizes, held = [], [], bytearray()

        def flush():
            nonlocal written, doc_ids, sizes, held
            ids = np.frombuffer(held, "<u4")
            row = [[part], [written], [len(doc_ids)], [len(ids)], [write_shard(doc_ids, sizes, ids, block)]]
            written += len(ids)
            doc_ids, sizes, held = [], [], bytearray()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, _SHARD_FIELDS.types)], schema=_SHARD_FIELDS
            )

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                if held and len(held) + 4 * len(ids) + len(end) > 4 * block:
                    yield flush()
                doc_ids.append(i)
                sizes.append(len(ids) + 1)
                held += ids.data
                held += end
        if held:
            yield flush()

    shards = ordered.mapInArrow(run, SHARDS)
    shards.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: ``doc_id, start, n_tokens, ids_crc32``.

    Every shard is decoded where it is read. Only the first id of every part, one row a
    part, is made from sums over all shards.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = sums.select("part", before.alias("before"))  # as many rows as files
    placed = shards.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "payload"
    )
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for start, payload in rows_of(batch, 1):
                shard = Shard(payload)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(start + shard.tokens[:-1]),
                        pa.array(np.diff(shard.tokens)),
                        pa.array(checksums(shard), pa.int64()),
                    ],
                    schema=out,
                )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def checksums(shard: Shard) -> list[int]:
    """CRC-32 of the tokens of every document, from its blocks as they are decoded."""
    out, doc, crc, at = [], 0, 0, 0
    ends = shard.tokens[1:].tolist()
    for ids in shard.all_ids():
        data, low, upto = memoryview(ids.astype("<u4", copy=False)).cast("B"), at, at + len(ids)
        while doc < len(ends) and ends[doc] <= upto:
            crc = zlib.crc32(data[4 * (low - at) : 4 * (ends[doc] - at)], crc)
            out.append(crc)
            doc, crc, low = doc + 1, 0, ends[doc]
        crc = zlib.crc32(data[4 * (low - at) :], crc)
        at = upto
    return out


def roundtrip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the tokens of all documents to compressed files and tell what is read back:
    ``doc_id, start, n_tokens, ids_crc32``.

    Tokens are those of the vocabulary's own library without special ones, closed by id 0.
    Documents are dealt by ranges of id; a task writes shards of about half a million ids, one
    after another, so it holds one shard and a run of texts of some 8 MB, or one document that
    is longer. Every different word of a run is encoded once. In every block of a shard,
    frequent pairs of ids are replaced by new symbols, round after round; rules and the
    lengths that they expand to are stored, so a document, or some tokens of it, is decoded
    without the rest. ``start`` counts the ids of all documents before it in the files.

    A null or empty text has the end id alone. A text longer than a block is cut into
    blocks of one shard, never cropped. Null ids come first; repeated ids follow each other
    by a hash of their text, and repeated rows stay. An empty table gives no rows. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_tokens(docs, vocabulary, path, key, text)
    return read_documents(spark, path)
