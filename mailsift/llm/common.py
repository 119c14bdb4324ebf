"""What the operators share: batches of rows in Python, hashes of words and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as `bytes.split` and `bytes.strip` take it.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries that a Python worker keeps in a cache, some 200 bytes each, and of those for
#: which looking them up saves little.
CACHE_ENTRIES, SMALL_CACHE_ENTRIES = 1_000_000, 250_000
#: Hashes of words that are kept; one is soon made anew.
WORD_HASHES = 100_000

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names."""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"))


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., Iterator[tuple]]],
    schema: str,
) -> DataFrame:
    """Run a Python generator over each row, in Arrow batches.

    ``make()`` is called once per task and returns a function of the named columns that
    yields output rows.
    """
    out = df.select(*columns)
    arrow = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches):
        function = make()
        for batch in batches:
            rows = []
            for values in rows_of(batch):
                rows.extend(function(*values))
                if len(rows) >= 4096:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return out.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, few: int = 256) -> Iterator[tuple]:
    """Rows as Python values, a few at a time: a batch may hold many long texts."""
    for start in range(0, batch.num_rows, few):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, few).columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema
    )


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    struct = spark.createDataFrame([], schema).schema
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in struct]


#: Ids up to this many (8 bytes each) are broadcast to a scan; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is among those of a written table."""
    few = ids.count() <= MOST_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def halve(cache: dict) -> None:
    """Forget the younger half: what came first is what comes most often."""
    older = list(islice(cache.items(), len(cache) // 2))
    cache.clear()
    cache.update(older)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_HASHES:
            halve(self)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_kept: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """What ``make`` makes, kept by this worker process for later tasks of the same kind.

    Only one such thing is kept: a task of another operator lets go of it, before its own
    is made, so the caches of several operators do not add up.
    """
    key = (make, *args)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(*args)
    return _kept[key]


#: Rows of an Arrow batch of texts. A batch lies whole in the JVM, outside its heap, and in Python.
BATCH_ROWS = 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, texts go to Python in batches of few rows; the session's setting comes back after."""
    before = spark.conf.get(_BATCH_CONF)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def word_hashes() -> WordHashes:
    return kept(WordHashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter sequence is one run as a whole."""
    width = min(width, len(words))
    if width == 0:
        return np.empty(0, np.uint64)
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        part = words[i : len(words) - width + 1 + i]
        total += mixed(part * _ODD[i % 8] + np.uint64(i))
    return mixed(total)
