"""Token counts of a byte-level BPE vocabulary, by merging on a heap."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import CACHE_ENTRIES, halve, id_and_text, kept, map_rows

#: How byte-level vocabularies of this kind split text before they merge; a fixed value.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_PIECES = regex.compile(PATTERN)
#: A space before a visible character always begins a piece, so a text can be cut there.
_CUT = regex.compile(r" (?=\P{White_Space})")
_LOOSE = regex.compile(r" (?:\p{White_Space}|$)")
#: Longer texts are split one piece at a time instead of into one list.
LONG_TEXT = 1_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind.

    Printable Latin-1 characters stand for themselves, all others for 256, 257, ...
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Rank of every pair that merges, and the special strings looked for in texts."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    return {m: i for i, m in enumerate(merges)}, [t["content"] for t in data["added_tokens"]]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: initial symbols minus merges.

    A heap holds the adjacent pairs by rank, then place; links join the symbols that are
    left. n symbols make at most 2n heap entries, so long pieces take n log n.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # Out of date when either symbol has been merged since.
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


def chunks(text: str) -> Iterator[str] | list[str]:
    """Cut a text before spaces that begin a piece; the space itself is left out.

    No piece crosses such a cut, and far fewer strings have to be looked at than pieces.
    """
    if len(text) > LONG_TEXT:
        return _lazily(text)
    return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")


def _lazily(text: str) -> Iterator[str]:
    start = 0
    for cut in _CUT.finditer(text):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class _Pieces(dict):
    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        count = count_merged([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES // 2:
                halve(self)
            self[piece] = count
        return count


class _Chunks(dict):
    """Tokens of a chunk with the space in front of it."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.pieces = _Pieces(ranks)

    def whole(self, chunk: str) -> int:
        if len(chunk) > LONG_TEXT:
            return sum(self.pieces[m.group()] for m in _PIECES.finditer(chunk))
        return sum(map(self.pieces.__getitem__, _PIECES.findall(chunk)))

    def __missing__(self, chunk: str) -> int:
        count = self.whole(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                halve(self)
            self[chunk] = count
        return count


def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; special strings are one token each."""
    ranks, special = read_vocabulary(path)
    by_chunk = _Chunks(ranks)
    marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> int:
        parts = iter(chunks(text))
        return by_chunk.whole(next(parts)) + sum(map(by_chunk.__getitem__, parts))

    def count(text: str) -> int:
        if marks is None or not marks.search(text):
            return plain(text)
        segments = marks.split(text)
        return len(segments) - 1 + sum(map(plain, segments))

    return count


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file, the same on every machine.
    Merging starts from bytes and always takes the lowest rank, leftmost first, so counts
    equal those of the vocabulary's own library; no identifiers are made. One pass, no
    shuffle: each worker keeps the counts of strings it has seen, up to a bound.

    A null or empty text has 0 bytes and 0 tokens. Texts of any length are counted whole.
    Rows are neither merged nor dropped: repeated rows and null ids come out as they are;
    extra columns are not read.
    """

    def make():
        count = kept(counter, vocabulary)

        def row(i, value):
            value = value or ""
            yield i, len(value.encode()), count(value)

        return row

    counted = map_rows(
        id_and_text(docs, key, text), ["id", "text"], make, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", over(F.col("n_tokens"), limit))


def over(n: Column, limit: int) -> Column:
    return n > limit
