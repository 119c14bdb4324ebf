"""Near-duplicate documents: MinHash bands, odd sketches, confirmation on full sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import WordHashes, id_and_text, map_rows, mixed, small_batches, window_hashes, with_ids, word_hashes
from mailsift.llm.components import components
from mailsift.sources.scratch import land


@dataclass(frozen=True)
class Scheme:
    """How alike documents must be, and how they are looked for.

    Two sets of Jaccard similarity s share a band with chance 1 - (1 - s^rows)^bands: for
    the default 0.99997 at 0.8, and 0.03 at 0.2.
    """

    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4
    sketch_words: int = 4  # of 64 bits each
    parity_words: int = 16

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_bits(self) -> int:
        return 64 * self.sketch_words

    def most_odd_bits(self) -> int:
        """Differing sketch bits beyond which a pair at the threshold is all but impossible.

        Of n samples, n·s agree on average; each that does not puts two odd elements into
        the XOR of the sketches. Allows 4.5 standard deviations of the samples and 3 of
        the bits.
        """
        s, n, bits = self.percent / 100, self.samples, self.sketch_bits
        agreeing = n * s - 4.5 * math.sqrt(n * s * (1 - s))
        odd = bits / 2 * (1 - (1 - 2 / bits) ** (2 * (n - max(agreeing, 0))))
        return math.ceil(odd + 3 * math.sqrt(odd / 2))


class Signer:
    """MinHash samples of a set of 64-bit hashes, folded into bands and an odd sketch."""

    def __init__(self, scheme: Scheme):
        self.scheme = scheme
        seeds = mixed(np.arange(1, 2 * scheme.samples + 1, dtype=np.uint64))
        self.factor, self.shift = (seeds[0::2] | np.uint64(1))[:, None], seeds[1::2][:, None]
        self.place = mixed(np.arange(scheme.samples, dtype=np.uint64) + np.uint64(1 << 32))
        self.band = mixed(np.arange(scheme.bands, dtype=np.uint64) + np.uint64(1 << 40))

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.scheme.samples, np.iinfo(np.uint64).max, np.uint64)
        # In blocks: a very long text has more shingles than a matrix should have columns.
        for i in range(0, len(hashes), 1024):
            block = hashes[None, i : i + 1024] * self.factor + self.shift
            np.minimum(least, block.min(axis=1), out=least)
        return least

    def bands(self, samples: np.ndarray) -> np.ndarray:
        rows = mixed(samples ^ self.place).reshape(self.scheme.bands, self.scheme.rows)
        return mixed(rows.sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Odd sketch: every (place, sample) flips the bit that it hashes to."""
        return _flipped(mixed(mixed(samples) + self.place), self.scheme.sketch_words)

    def parity(self, hashes: np.ndarray) -> np.ndarray:
        """The same over the whole set: no more bits can differ than elements do."""
        return _flipped(mixed(hashes + np.uint64(1)), self.scheme.parity_words)


def _flipped(hashes: np.ndarray, words: int) -> np.ndarray:
    bits = (hashes % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, sorted; A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    return np.unique(window_hashes(hashes.of(words), width))


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``id, n, set_key, bands, sketch, parity`` of every row of ``id, text``."""

    def make():
        hashes, signer = word_hashes(), Signer(scheme)

        def row(i, text):
            found = shingles(text, scheme.words, hashes)
            if not len(found):
                yield i, 0, None, None, None, None
                return
            samples = signer.samples(found)
            yield (
                i,
                len(found),
                xxhash.xxh3_128_digest(found.tobytes()),
                signer.bands(samples),
                signer.sketch(samples),
                signer.parity(found),
            )

        return row

    return map_rows(
        docs, ["id", "text"], make,
        "id bigint, n bigint, set_key binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>",
    )


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, shingles``: the full set of every row of ``id, text``."""

    def make():
        hashes = word_hashes()

        def row(i, text):
            yield i, shingles(text, width, hashes).view(np.int64)

        return row

    return map_rows(docs, ["id", "text"], make, "id bigint, shingles array<bigint>")


# --- candidates ---------------------------------------------------------------------


def odd_bits(a: str, b: str, words: int) -> Column:
    """Bits in which two bitmaps differ."""
    counts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)]
    return sum(counts[1:], counts[0])


def may_be_alike(a: str, b: str, scheme: Scheme) -> Column:
    """Sizes allow the similarity, and neither bitmap speaks against it.

    Of similar sets, at most (1 - s) / (1 + s) of the elements differ, and each flips one
    bit of the parity bitmap: more odd bits than that rule a pair out for certain.
    """
    n, m, s = F.col(f"{a}.n"), F.col(f"{b}.n"), scheme.percent
    sizes = 100 * F.least(n, m) >= s * F.greatest(n, m)
    sketches = odd_bits(f"{a}.sketch", f"{b}.sketch", scheme.sketch_words) <= scheme.most_odd_bits()
    differing = odd_bits(f"{a}.parity", f"{b}.parity", scheme.parity_words)
    return sizes & sketches & ((100 + s) * differing <= (100 - s) * (n + m))


def confirmed(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``a, b`` that are alike by their full shingle sets.

    Only the texts of documents in some pair are read and taken apart again. The joins
    are on ids, so a document in very many pairs is a skewed key that Spark splits.
    """
    pairs = land(pairs, "pairs")
    named = land(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named")
    with small_batches(docs.sparkSession):
        sets = land(shingle_sets(with_ids(docs, named), scheme.words), "sets")
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    alike = pairs.join(first, "a").join(second, "b").filter(100 * both >= scheme.percent * either)
    return alike.select("a", "b")


def _bucketed(reps: DataFrame) -> DataFrame:
    return reps.select("id", F.explode("bands").alias("bucket"))


def star_pairs(reps: DataFrame, buckets: DataFrame, scheme: Scheme) -> DataFrame:
    """Every document with the first one of each of its buckets: linear in the buckets."""
    met = _bucketed(reps).join(buckets, "bucket").filter("id <> leader")
    pairs = met.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    sketches = reps.select("id", "n", "sketch", "parity")
    return (
        pairs.join(sketches.alias("x"), F.col("a") == F.col("x.id"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.id"))
        .filter(may_be_alike("x", "y", scheme))
        .select("a", "b")
    )


def bridge_pairs(reps: DataFrame, buckets: DataFrame, found: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs that share a bucket but no component yet, and may be alike.

    In each bucket with several components, all documents outside the one with the most
    members are compared with all others that are not in their own component. Documents
    that the stars have joined already, which are nearly all in a group of near copies,
    are not compared again, so a large group costs no square. Buckets are divided by size
    class, of which alike sets have the same or the next one.
    """
    members = (
        _bucketed(reps)
        .join(buckets.select("bucket"), "bucket")
        .join(found, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    members = land(members, "members")
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed_buckets = (
        parts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most"))
        .filter("parts > 1")
        .select("bucket", F.col("most.component").alias("bulk"))
    )
    step = math.log(100 / scheme.percent) if scheme.percent < 100 else 1.0
    size_class = F.floor(F.log("n") / step).cast("int")
    sides = (
        members.join(mixed_buckets, "bucket")
        .join(reps.select("id", "n", "sketch", "parity"), "id")
        .withColumn("rest", F.col("component") != F.col("bulk"))
        .withColumn("class", size_class)
        .drop("bulk")
    )
    sides = land(sides, "sides")
    near = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])).alias("class")
    own = sides.filter("rest").select("bucket", "id", "component", "n", "sketch", "parity", near).alias("x")
    other = sides.alias("y")
    on = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.class") == F.col("y.class"))
        & (F.col("x.component") != F.col("y.component"))
        & (~F.col("y.rest") | (F.col("x.id") < F.col("y.id")))
        & may_be_alike("x", "y", scheme)
    )
    ids = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    return own.join(other, on).select(*ids).distinct()


def near_duplicates(
    docs: DataFrame, scheme: Scheme = Scheme(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Components of documents linked by similar shingle sets, one row per document.

    Columns ``doc_id, n_shingles, component_id, kept``. A document's set holds the
    distinct runs of ``scheme.words`` words of its whole text, split at ASCII white space
    with A-Z lower-cased; with fewer words the whole sequence is its one shingle. Two
    documents are linked if their Jaccard similarity is at least ``scheme.percent``;
    ``component_id`` is the smallest id that links lead to, and its document is kept.

    Documents with equal sets are one class from the start, whatever their number. Of each
    class one representative enters the buckets of its MinHash bands. The samples are also
    folded into an odd sketch, a parity bitmap; the bits of the XOR of two sketches count
    the samples that differ, precisely so for high similarities, and drop most false
    candidates; a parity bitmap of the set itself drops those it can rule out for certain.
    Those left are confirmed on full sets. Every pair in a bucket is
    either tried or already connected, so no group is capped and none is spelled out in
    pairs. Fingerprints, links and components stay in tables; loops only ask whether a
    table is empty.

    Null, empty and blank texts have no shingles, are linked with nothing and kept. Rows
    that repeat an id are one document. Rows with a null id take the component of equal
    sets that have an id, else null with ``kept`` true. An empty table gives no rows;
    extra columns are not read.
    """
    docs = id_and_text(docs, key, text)
    with small_batches(docs.sparkSession):
        signed = land(signatures(docs, scheme), "signatures")
    classes = land(
        signed.filter("n > 0")
        .groupBy("set_key")
        .agg(
            F.min("id").alias("id"),
            F.count("*").alias("members"),
            F.min_by(F.struct("n", "bands", "sketch", "parity"), "id").alias("of"),
        )
        .select("set_key", "id", "members", "of.*"),
        "classes",
    )
    reps = classes.filter("id is not null")
    buckets = land(
        _bucketed(reps)
        .groupBy("bucket")
        .agg(F.min("id").alias("leader"), F.count("*").alias("members"))
        .filter("members > 1")
        .select("bucket", "leader"),
        "buckets",
    )
    links = land(confirmed(star_pairs(reps, buckets, scheme), docs, scheme), "links")
    found = land(components(links), "found")
    more = land(confirmed(bridge_pairs(reps, buckets, found, scheme), docs, scheme), "bridges")
    if not more.isEmpty():
        found = land(components(links.union(more)), "found")
    # Only classes that say more than "its own component" have to meet the documents.
    named = (
        classes.select("set_key", "id", "members")
        .join(found, "id", "left")
        .filter("members > 1 OR component IS NOT NULL")
        .select("set_key", F.coalesce("component", "id").alias("component"))
    )
    component = F.coalesce("component", "id")
    return signed.select("id", "n", "set_key").join(named, "set_key", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
