"""Cheapest repair of the turn structure of conversations, by a chunked Viterbi search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import SPACES, kept, rows_of
from mailsift.sources.scratch import land

#: Turns of a chunk; a conversation of any length is worked on in chunks of so many.
CHUNK = 65_536

# --- the search ---------------------------------------------------------------------

#: Cost of each edit, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What may follow: no turn yet, after the system turn, after a user, after an assistant.
#: The first and the last state may end a conversation.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where inserting or rerolling leads; the only role of the two that may follow.
_FORCED = tuple(n.get("u") or n["a"] for n in _NEXT)
_ROLE = {2: "user", 3: "assistant"}
#: A turn is one byte: which initial its role has, and its first fault.
INITIALS, FAULTS = "sua?", ("clean", "truncated", "blank", "duplicate")

Vector = tuple[int, int, int, int]


def symbol(initial: str, fault: int) -> int:
    return INITIALS.find(initial if initial in ("s", "u", "a") else "?") + 4 * fault


def _closed(costs: list[int]) -> tuple[Vector, int]:
    """Costs once turns may be inserted first, less their minimum, and that minimum."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_FORCED[s]]) for s, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


_FAR = 1_000_000
#: Costs from each state to an allowed end, behind the last turn; and the speculative ones.
END: Vector = _closed([0, _FAR, _FAR, 0])[0]
ANY: Vector = (0, 0, 0, 0)


def edits(turn: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, state`` of every edit of a turn, in the order of the letters."""
    initial, fault = INITIALS[turn & 3], turn >> 2
    found = [("D", DELETE, state)]
    if fault < 2:
        extra = TRUNCATED if fault == 1 else 0
        if initial in _NEXT[state]:
            found.append(("K", KEEP + extra, _NEXT[state][initial]))
        found.append(("R", REROLE + extra, _FORCED[state]))
    return found


class Steps(dict):
    """Costs before a turn, by costs behind it: ``[vector, turn] -> vector``.

    Vectors differ by constants exactly if they are equal here, as minima are taken off.
    There are few of them, so a step is a look-up.
    """

    def __missing__(self, key: tuple[Vector, int]) -> Vector:
        after, turn = key
        costs = [min(cost + after[to] for _, cost, to in edits(turn, s)) for s in range(4)]
        value = self[key] = _closed(costs)[0]
        return value


class Traces(dict):
    """Least edits of a turn: ``[vector behind it, turn, state] -> letters, cost, state``."""

    def __missing__(self, key: tuple[Vector, int, int]) -> tuple[str, int, int]:
        after, turn, state = key
        costs = [min(cost + after[to] for _, cost, to in edits(turn, s)) for s in range(4)]
        for _ in range(2):
            costs = [min(c, INSERT + costs[_FORCED[s]]) for s, c in enumerate(costs)]
        letters, total, at = "", 0, state
        while True:
            ways = edits(turn, at)
            ways.insert(1, ("I", INSERT, _FORCED[at]))
            for letter, cost, to in ways:
                rest = costs[to] if letter == "I" else after[to]
                if cost + rest == costs[at]:
                    break
            letters, total, at = letters + letter, total + cost, to
            if letter != "I":
                break
        value = self[key] = (letters, total, at)
        return value


def last_edits(state: int) -> str:
    """Insertions behind the last turn."""
    letters = ""
    while state not in (0, 3):
        letters, state = letters + "I", _FORCED[state]
    return letters


def before(steps: Steps, turns: bytes, after: Vector) -> Vector:
    """Costs before a chunk, given those behind it."""
    for turn in reversed(turns):
        after = steps[after, turn]
    return after


def fixed_up(steps: Steps, turns: bytes, known: tuple[Vector, Vector], after: Vector) -> Vector:
    """Costs before a chunk for other costs behind it than those of an earlier run.

    ``known`` is what an earlier run assumed behind and found before the chunk. Both runs
    go back together until their vectors differ only by a constant; from there on the
    earlier result holds.
    """
    old, found = known
    for turn in reversed(turns):
        if old == after:
            return found
        old, after = steps[old, turn], steps[after, turn]
    return after


def trace(steps: Steps, traces: Traces, turns: bytes, after: Vector, states) -> list[tuple[str, int, int]]:
    """Least edits of a chunk from each state in front of it: letters, cost, state behind."""
    behind = [after]
    for turn in reversed(turns[1:]):
        behind.append(steps[behind[-1], turn])
    behind.reverse()
    out = []
    for at in states:
        letters, total = [], 0
        for turn, vector in zip(turns, behind):
            step, cost, at = traces[vector, turn, at]
            letters.append(step)
            total += cost
        out.append(("".join(letters), total, at))
    return out


# --- turns --------------------------------------------------------------------------


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Turns with the faults that their checksum asks for, as ``conv, turn, role, text, copies``.

    No copies: the turn is gone. Null role and text become a space.
    """
    kind = F.pmod(F.crc32(F.concat(_or_space(F.col("conv")), F.lit(":"), _or_space(F.col("turn")))), F.lit(20))
    text = _or_space(F.col("text"))
    return turns.select(
        "conv",
        "turn",
        F.when(kind == 4, "user").otherwise(_or_space(F.col("role"))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _marked(turns: DataFrame) -> DataFrame:
    """``conv, turn, digest, mark, copies``, one row for equal turns; texts are left behind.

    ``mark`` is the byte of the turn, blank or not; later copies are duplicates, as are
    turns whose digest an earlier one has.
    """
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    end = F.substring(shown, -1, 1)
    fault = F.when(shown == "", 2).when(~end.isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = turns.filter("copies > 0").select(
        "conv", "turn", _digest().alias("digest"), (code + 4 * fault).cast("int").alias("mark"), "copies"
    )
    rows = narrow.groupBy("conv", "turn", "digest", "mark").agg(F.sum("copies").alias("copies"))
    rows = land(rows, "turns")
    # False, for no turn, comes before true: null turns are the first.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn"))["turn"]
    firsts = rows.groupBy("conv", "digest").agg(first.alias("turn"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv", "turn", "digest")]
    met = rows.alias("r").join(firsts.alias("f"), same[0] & same[1] & same[2], "left")
    return met.select("r.*", F.col("f.digest").isNotNull().alias("first"))


def _chunks(marked: DataFrame, chunk: int) -> DataFrame:
    """Turns in order, one byte each, in chunks: ``conv, part, seq, last_of_part, turns``.

    A range partitioning deals the turns out, so a conversation may go through several
    parts; a part holds one chunk of it at a time.
    """
    kind = marked.schema["conv"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, seq, held, began = None, 0, bytearray(), False

        def row(last):
            return conv, part, seq, last, bytes(held)

        for batch in batches:
            out = []
            for c, _, _, mark, copies, first in rows_of(batch, 4096):
                if not began or c != conv:
                    if began:
                        out.append(row(True))
                    conv, seq, held, began = c, 0, bytearray(), True
                again = mark if mark >> 2 == 2 else mark & 3 | 12
                turn = mark if first else again
                while copies:
                    if len(held) >= chunk:
                        out.append(row(False))
                        seq, held = seq + 1, bytearray()
                    n = 1 if turn != again else min(copies, chunk - len(held))
                    held += bytes([turn]) * n
                    copies, turn = copies - n, again
            if out:
                yield _rows(out, schema)
        if began:
            yield _rows([row(True)], schema)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _arrow(marked, "conv", [("part", pa.int32()), ("seq", pa.int32()), ("last_of_part", pa.bool_()), ("turns", pa.binary())])
    return dealt.select("conv", "turn", "digest", "mark", "copies", "first").mapInArrow(
        run, f"conv {kind}, part int, seq int, last_of_part boolean, turns binary"
    )


def _arrow(df: DataFrame, column: str, more: list) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([pa.field(column, to_arrow_type(df.schema[column].dataType)), *(pa.field(*m) for m in more)])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _text(vector: Vector) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(",")))


def _solved(chunks: DataFrame) -> DataFrame:
    """Add ``behind``: the costs behind every chunk, but for a constant.

    All chunks start at once. The last of a conversation knows what is behind it; others
    assume that all states cost the same. In fix-up passes each chunk looks at what its
    follower found; where that differs by more than a constant from what it assumed, it
    runs again, as far back as the difference is felt. There are as many passes as the
    longest run of chunks that a difference goes through.
    """
    spot = [F.struct("part", "seq").alias("spot"), F.col("conv")]
    follower = F.when(
        F.col("last_of_part"), F.struct((F.col("part") + 1).alias("part"), F.lit(0).alias("seq"))
    ).otherwise(F.struct("part", (F.col("seq") + 1).alias("seq")))
    named = chunks.select(*spot, follower.alias("follower"), "turns")
    there = chunks.select(F.col("conv").alias("c"), F.struct("part", "seq").alias("s"))
    linked = named.join(there, F.col("conv").eqNullSafe(F.col("c")) & (F.col("follower") == F.col("s")), "left")
    started = linked.select(
        "conv", "spot", F.when(F.col("s").isNotNull(), F.col("follower")).alias("follower"), "turns",
        F.when(F.col("s").isNull(), _text(END)).otherwise(_text(ANY)).alias("behind"),
        F.lit(None).cast("string").alias("assumed"), F.lit(None).cast("string").alias("found"),
    )
    solved = land(_run(started), "vectors")
    while True:
        known = solved.select(F.col("conv").alias("c"), F.col("spot").alias("s"), F.col("found").alias("told"))
        met = solved.filter("follower IS NOT NULL").join(
            known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("follower") == F.col("s"))
        )
        wrong = land(met.filter("told <> behind").select("conv", "spot", "told"), "wrong")
        if wrong.isEmpty():
            return solved
        new = wrong.select(F.col("conv").alias("c"), F.col("spot").alias("s"), "told")
        joined = solved.join(new, F.col("conv").eqNullSafe(F.col("c")) & (F.col("spot") == F.col("s")), "left")
        again = joined.filter("told IS NOT NULL").select(
            "conv", "spot", "follower", "turns", F.col("told").alias("behind"), F.col("behind").alias("assumed"), "found"
        )
        solved = land(_run(again).unionByName(joined.filter("told IS NULL").select(solved.columns)), "vectors")


_SPOT = pa.struct([("part", pa.int32()), ("seq", pa.int32())])


def _run(chunks: DataFrame) -> DataFrame:
    """Costs ``found`` in front of each chunk, from those ``behind`` it."""
    schema = _arrow(chunks, "conv", [("spot", _SPOT), ("follower", _SPOT), ("turns", pa.binary()), ("behind", pa.string()), ("found", pa.string())])

    def run(batches):
        steps = kept(Steps)
        for batch in batches:
            out = []
            for conv, spot, follower, turns, behind, assumed, found in rows_of(batch):
                vector = _vector(behind)
                if found is None:
                    vector = before(steps, turns, vector)
                else:
                    vector = fixed_up(steps, turns, (_vector(assumed), _vector(found)), vector)
                out.append((conv, spot, follower, turns, behind, _text(vector)))
            if out:
                yield _rows(out, schema)

    kind = chunks.schema["conv"].dataType.simpleString()
    spot = "struct<part:int,seq:int>"
    columns = ["conv", "spot", "follower", "turns", "behind", "assumed", "found"]
    return chunks.select(*columns).mapInArrow(
        run, f"conv {kind}, spot {spot}, follower {spot}, turns binary, behind string, found string"
    )


# --- conversations ------------------------------------------------------------------


class _Conversation:
    """What is known of a conversation while its chunks, then its turns, go by."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, 0, 0
        self.letters: list[str] = []
        self.faults, self.illegal, self.end = [0, 0, 0, 0], 0, None
        self.edits: Iterator[str] | None = None
        self.at, self.sha, self.some = 0, hashlib.sha256(), False
        self.low = self.high = self.turn = None
        self.distinct = 0

    def chunk(self, steps: Steps, traces: Traces, turns: bytes, behind: Vector) -> None:
        letters, cost, self.state = trace(steps, traces, turns, behind, [self.state])[0]
        self.letters.append(letters)
        self.cost += cost
        for t in set(turns):
            self.faults[t >> 2] += turns.count(t)
        roles = bytes(t & 3 for t in turns)
        legal = sum(roles.count(pair) for pair in _LEGAL)
        self.illegal += len(roles) - 1 - legal
        if self.end is not None:
            self.illegal += bytes([self.end, roles[0]]) not in _LEGAL
        self.end = roles[-1]

    def begin(self) -> None:
        self.letters.append(last_edits(self.state))
        self.cost += INSERT * len(self.letters[-1])
        self.audit = "".join(self.letters)
        self.edits, self.at = iter(self.audit), 0

    def write(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
        self.some = True

    def insert(self) -> None:
        self.at = _FORCED[self.at]
        self.write(_ROLE[self.at], "")

    def row(self, turn, role: str, text: str, copies: int) -> None:
        if self.edits is None:
            self.begin()
        if copies and turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.distinct += 1
        for _ in range(copies):
            while (letter := next(self.edits)) == "I":
                self.insert()
            if letter == "K":
                self.at = _NEXT[self.at][role[0]]
                self.write(role, text)
            elif letter == "R":
                self.at = _FORCED[self.at]
                self.write(_ROLE[self.at], text)

    def result(self) -> tuple:
        for _ in self.edits:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        _, truncated, blank, duplicate = self.faults
        return (self.conv, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit, self.sha.hexdigest())


_LEGAL = tuple(bytes(map(INITIALS.index, pair)) for pair in ("su", "ua", "au"))
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """One row per conversation: its chunks go by first, then its turns, in order.

    Nothing of a conversation but its edits, a byte each, is held; its turns are hashed as
    they pass.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    nothing = F.lit(None)
    chunks = solved.select(
        "conv", "spot", nothing.cast(turns.schema["turn"].dataType).alias("turn"), nothing.cast("binary").alias("digest"),
        nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), F.lit(0).alias("copies"), "turns", "behind",
    )
    texts = turns.select(
        "conv", nothing.cast("struct<part:int,seq:int>").alias("spot"), "turn", _digest().alias("digest"), "role", "text", "copies",
        nothing.cast("binary").alias("turns"), nothing.cast("string").alias("behind"),
    )
    order = [
        F.col("conv").asc_nulls_first(), F.col("spot").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("digest"),
    ]
    stream = chunks.unionByName(texts).repartition("conv").sortWithinPartitions(*order)
    schema = _arrow(turns, "conv", [*((c, pa.int64()) for c in _RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        steps, traces = kept(_tables)
        now = None
        for batch in batches:
            out = []
            for conv, turns, behind, turn, role, text, copies in rows_of(batch):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                if turns is not None:
                    now.chunk(steps, traces, turns, _vector(behind))
                else:
                    now.row(turn, role, text, copies)
            if out:
                yield _rows(out, schema)
        if now is not None:
            yield _rows([now.result()], schema)

    numbers = ", ".join(f"{c} bigint" for c in _RESULT)
    return stream.select("conv", "turns", "behind", "turn", "role", "text", "copies").mapInArrow(
        run, f"conv {kind}, {numbers}, audit string, repaired_sha256 string"
    )


def _tables() -> tuple[Steps, Traces]:
    return Steps(), Traces()


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cheapest edits that make turns ``conv, turn, role, text, copies`` follow each other.

    See ``repair_conversations`` for what counts as a fault, and for the results.
    """
    chunks = land(_chunks(_marked(turns), chunk), "chunks")
    return _repaired(turns, _solved(chunks)).withColumnRenamed("conv", "conv_id")


def repair_conversations(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Damage conversations by rule and repair them again, one row per conversation:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A repaired conversation is empty, or an optional system turn and then pairs of a user
    and an assistant turn, told by the initials of roles. Turns are kept, given the other
    role, deleted or inserted; blank turns and those seen earlier must go. ``audit`` has the
    edits of the cheapest repair, the least in ASCII order of all that cost the same.

    The search goes back over chunks of turns, all at once, from speculative costs; fix-up
    passes run until costs behind every chunk are right but for a constant, which is all
    that the choice of edits depends on. Turns take part as one byte each. Texts are
    shuffled once, by conversation, to be hashed in order; a task holds a batch of texts and
    the edits of one conversation, whatever the length of a conversation.

    Null roles and texts are a space, and so is a null id or turn in the checksum. Null ids
    are one conversation; null turns come first, equal turns by the digest of role and text.
    Empty and very long texts are nothing special; roles with other initials, and empty
    ones, can only be changed or deleted. A conversation without turns has zeros, an empty
    audit and the hash of nothing. An empty table gives no rows. Extra columns are not read.
    """
    named = conversations.select(
        F.col(key).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    return repair(damage(named), chunk)
