"""Product quantization of integer vectors, nearest entries found by a tree of split points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.sources.scratch import land

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node; groups of at most so many entries are compared one by one.
DEGREE, LEAF = 8, 8
#: Components beyond this count as this, so that sums of them are exact numbers.
LARGEST = 2**60
#: Below this, sums of squares of a part are exact as 64-bit floats and as integers.
_SMALL = 2**20
_LONG_MAX = 2**63 - 1


# --- the tree -----------------------------------------------------------------------


@dataclass
class Node:
    """Split points, the entries nearest to each, and how far those are from each point.

    ``low[i, j]`` and ``high[i, j]`` bound the distances from split point i to all entries
    below child j, its own split point included. A leaf has entries and no children.
    """

    entries: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] | None = None


def _down(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(d, -np.inf), -np.inf)


def _up(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(d, np.inf), np.inf)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y.

    Small integers multiply as floats without an error; any others as Python's integers.
    """
    most = max((int(abs(v).max()) for v in (x, y) if v.size), default=0)
    if most < _SMALL and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), y.astype(object)
    return np.array([[((u - v) ** 2).sum() for v in b] for u in a], object).reshape(len(a), len(b))


def build(points: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A geometric near-neighbour access tree over the rows of ``points``.

    Split points are picked far apart, the first being the first entry; every other entry
    goes below the split point nearest to it. The same points give the same tree.
    """
    entries = np.arange(len(points)) if entries is None else entries
    if len(entries) <= max(LEAF, DEGREE):
        return Node(entries)
    chosen, nearest = [0], squared(points[entries], points[entries[:1]])[:, 0]
    while len(chosen) < DEGREE and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(points[entries], points[entries[chosen[-1:]]])[:, 0])
    if len(chosen) == 1:
        return Node(entries)  # all alike
    between = squared(points[entries[chosen]], points[entries])
    owner = np.argmin(between, axis=0)
    owner[chosen] = np.arange(len(chosen))
    distance = _roots(between)
    inside = [owner == j for j in range(len(chosen))]
    low = np.stack([_down(distance[:, m].min(1)) for m in inside], 1)
    high = np.stack([_up(distance[:, m].max(1)) for m in inside], 1)
    split = np.zeros(len(entries), bool)
    split[chosen] = True
    below = [entries[m & ~split] for m in inside]
    return Node(entries[chosen], low, high, [build(points, e) if len(e) else None for e in below])


def nearest(tree: Node, points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each query; ties to the lower index.

    All queries of a batch go down the tree together. A subtree is left out for a query only
    if, from some split point, all of it lies strictly beyond the best entry so far: square
    roots are rounded against leaving it out, and what is met is compared by exact integers,
    so an equally near entry with a lower index is always met.
    """
    best = np.full(len(queries), -1, np.int64)
    exact = squared(queries[:0], points).dtype if _fits(points, queries) else np.dtype(object)
    least = np.empty(len(queries), exact)

    def meet(node: Node, who: np.ndarray) -> None:
        d = squared(queries[who], points[node.entries])
        order = np.argsort(node.entries, kind="stable")
        at = order[np.argmin(d[:, order], axis=1)]
        found, index = d[np.arange(len(who)), at], node.entries[at]
        old, old_least = best[who], least[who]
        closer = old < 0
        known = ~closer
        closer[known] = (found[known] < old_least[known]) | (
            (found[known] == old_least[known]) & (index[known] < old[known])
        )
        best[who[closer]], least[who[closer]] = index[closer], found[closer]
        if node.children is None:
            return
        root = _roots(d)
        inner, outer = _down(root), _up(root)
        # Nearest children first: they bring the best distance down for the others.
        for j in np.argsort(root.mean(0), kind="stable"):
            if node.children[j] is None:
                continue
            reach = _up(_roots(least[who]))[:, None]
            beyond = (node.low[:, j] > _up(outer + reach)) | (node.high[:, j] < _down(inner - reach))
            left = who[~beyond.any(1)]
            if len(left):
                meet(node.children[j], left)

    if len(queries) and len(points):
        meet(tree, np.arange(len(queries)))
    return best, least


def _fits(*arrays: np.ndarray) -> bool:
    return all(not a.size or abs(a).max() < _SMALL for a in arrays) and arrays[0].shape[1] <= 1024


# --- vectors ------------------------------------------------------------------------


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a whole vector, and these as integers floor(1024 * x), zeros behind.

    A vector with a null or non-finite component is none.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(there)) if len(there) < len(column) else column
    values = lists.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls turn into NaN
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(there)), sizes)
    bad = np.zeros(len(there), bool)
    bad[row[~np.isfinite(flat)]] = True
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = ~bad[row]
    out = np.zeros((len(there), width), np.int64)
    whole = np.clip(np.floor(SCALE * flat[keep]), -float(LARGEST), float(LARGEST))
    out[row[keep], place[keep]] = whole.astype(np.int64)
    return there[~bad], out[~bad]


def _cut(vectors: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, PARTS, axis=1)


Codebooks = list[np.ndarray]


def _assigned(batch: pa.RecordBatch, books: Codebooks, trees: list[Node], width: int):
    rows, vectors = integers(batch.column("vector"), width)
    parts = _cut(vectors)
    return rows, parts, [nearest(t, b, p) for t, b, p in zip(trees, books, parts)]


def _first_codebooks(vectors: DataFrame) -> tuple[Codebooks, int]:
    """The parts of the first entries, and the width of all vectors, a multiple of the parts."""
    finite = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    kept = vectors.filter(finite)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    chosen = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector")
    column = pa.array([r.vector for r in chosen.collect()], pa.list_(pa.float64()))
    return _cut(integers(column, width)[1]), width


def _moved(vectors: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: assign all parts, then move every entry to the floored mean of its parts.

    A task sums up its own parts first, so what is shuffled is bounded by tasks and entries.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((books, [build(b) for b in books]))

    def sums(batches) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, parts, found = _assigned(batch, books, trees, width)
            for p, (part, (index, _)) in enumerate(zip(parts, found)):
                count[p] += np.bincount(index, minlength=len(books[p]))
                exact = part if not part.size or abs(part).max() < 2**40 else part.astype(object)
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.diff(index[order], prepend=-1))
                if len(starts) and part.shape[1]:
                    total[p][index[order][starts]] += np.add.reduceat(exact[order], starts).astype(object)
        for p, n in enumerate(count):
            used = np.flatnonzero(n)
            for e in used:
                columns = [[p], [int(e)], [int(n[e])], [[Decimal(int(v)) for v in total[p][e]]]]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["part", "entry", "n", "sums"]
                )

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    placed = partial.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "value"))
    summed = placed.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    moved = [b.copy() for b in books]
    for r in summed.collect():  # at most parts x entries x places of a part
        if r.place is not None:
            moved[r.part][r.entry, r.place] = int(r.value) // r.n
    shared.unpersist()
    return moved


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks after all rounds. ``vectors`` has columns ``id, vector, label``."""
    books, width = _first_codebooks(vectors)
    if len(books[0]):
        for _ in range(rounds):
            books = _moved(vectors, books, width)
    return books, width


def digest(books: Codebooks) -> str:
    numbers = ",".join(str(int(v)) for b in books for v in b.ravel())
    return hashlib.sha256(numbers.encode()).hexdigest()


def assign(vectors: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """``vec_id, label, code, error`` of every whole vector."""
    shared = vectors.sparkSession.sparkContext.broadcast((books, [build(b) for b in books]))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches):
        books, trees = shared.value
        for batch in batches:
            rows, _, found = _assigned(batch, books, trees, width)
            if not len(rows):
                continue
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(index.tolist() for index, _ in found))]
            errors = [min(sum(map(int, row)), _LONG_MAX) for row in zip(*(least.tolist() for _, least in found))]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("label").take(at), pa.array(codes), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return vectors.mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def label_errors(coded: DataFrame, few: int = 4096) -> DataFrame:
    """Add ``label_error``: errors summed over rows of the same label, nulls being one label.

    Labels with more than one in ``few`` of all rows, so at most ``few`` of them, meet their
    rows by broadcast; only rows of other labels are dealt by label.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG_MAX))).cast("long")
    sums = land(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "label_errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * few > rows

    def met(left, right):
        right = right.select(F.col("label").alias("same"), "label_error")
        return left.join(right, F.col("label").eqNullSafe(F.col("same")), "left").drop("same")

    hot = met(coded, F.broadcast(sums.filter(often)))
    rest = met(hot.filter("label_error IS NULL").drop("label_error"), sums.filter(~often))
    return hot.filter("label_error IS NOT NULL").unionByName(rest)


def quantize(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """Codes of all vectors: ``vec_id, code, error, label_error, codebooks_sha256``.

    Components become integers floor(1024 x); vectors are cut into four parts. The parts
    of the 256 smallest ids are the first codebooks; each round assigns all parts to their
    nearest entries (ties to the lower index) and moves the entries to floored means. All
    vectors are read in every round. What meets on the driver is the codebooks alone.
    Nearest entries are found by a geometric near-neighbour access tree over the entries of
    a codebook, with the same results as comparing them all.

    Null vectors and those with null or non-finite components are left out. Of vectors of
    different lengths all count as the longest, rounded up to a multiple of four, with zeros
    behind; empty ones have code 00000000. Components beyond 2^60 count as 2^60 and errors
    beyond 2^63 - 1 as that. Repeated rows stay; null ids and equal ids take part, null ids
    last and equal ids by their components where the first entries are chosen. With fewer
    than 256 vectors all of them are entries. An empty table gives no rows. Extra columns
    are not read.
    """
    rows = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books, width = fit(rows, rounds)
    coded = land(assign(rows, books, width), "codes")
    return label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
