"""Linking tool calls with their results: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.sources.scratch import land

#: Calls of a conversation are numbered in blocks of so many turns.
BLOCK = 1024
#: A whole argument of this form stands for the result of another call.
_REFERENCE = r'"\$result:([^"\\]+)"'


#: What JSON text is made of: strings, numbers, and runs of anything else.
_TOKEN = r'(?s)"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|.'
#: A number with an exponent, and up to so many digits that a double tells them all.
_EXPONENT, _WITH_EXPONENT = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?[eE][+-]?[0-9]+\z", r"[0-9][eE][+-]?[0-9]"
_DIGITS = 17


def plain_numbers(arguments: Column) -> Column:
    """JSON text whose numbers with an exponent are spelled out: 1e2 becomes 100.

    The variant type reads plain numbers as exact decimals and spells equal ones alike, but
    takes any with an exponent for a double. Those of more than 17 digits, or beyond 38
    digits when spelled out, stay as they are.
    """

    def plain(token: Column) -> Column:
        value = token.try_cast("double")
        fine, whole = token.try_cast("decimal(38,18)"), token.try_cast("decimal(38,0)")
        short = F.length(F.regexp_replace(token, "[eE].*|[^0-9]", "")) <= _DIGITS
        spelled = (
            F.when(fine.cast("double") == value, F.regexp_replace(fine.cast("string"), r"\.?0+$", ""))
            .when(fine.isNull() & (whole.cast("double") == value), whole.cast("string"))
            .otherwise(token)
        )
        return F.when(token.rlike(_EXPONENT) & short, spelled).otherwise(token)

    tokens = F.regexp_extract_all(arguments, F.lit(_TOKEN), F.lit(0))
    spelled = F.array_join(F.transform(tokens, plain), "")
    return F.when(arguments.rlike(_WITH_EXPONENT), spelled).otherwise(arguments)


def references(arguments: Column) -> Column:
    """Ids of the calls whose results the arguments ask for."""
    return F.array_distinct(F.regexp_extract_all(arguments, F.lit(_REFERENCE), F.lit(1)))


def argument_types(calls: DataFrame) -> DataFrame:
    """``conversation, call_id, tool, parameter, type`` of every argument of every call."""
    spark = calls.sparkSession
    parsed = calls.filter("arguments IS NOT NULL").select(
        "conversation", "call_id", "tool", F.try_parse_json("arguments").alias("v")
    )
    objects = parsed.filter(F.schema_of_variant("v").startswith("OBJECT"))
    exploded = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    named = (
        F.when((kind == "STRING") & F.variant_get("value", "$", "string").startswith("$result:"), "reference")
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "OBJECT", "object")
        .when(kind == "ARRAY", "array")
        .otherwise("null")
    )
    return exploded.select(
        "conversation", "call_id", "tool", F.col("key").alias("parameter"), named.alias("type")
    )


def argument_problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conversation, call_id, problems``: what is wrong with the arguments of a call.

    Arguments meet the parameters of their tool by hash joins on tool and parameter; a
    missing one is a required parameter that no argument meets.
    """
    given = land(argument_types(calls), "arguments")
    declared = schemas.select("tool", "parameter", F.col("type").alias("wanted"), "required").distinct()
    ids = ["conversation", "call_id"]
    checked = given.join(declared, ["tool", "parameter"], "left")
    # An argument that asks for a result has the type of whatever comes back.
    wrong = checked.filter("wanted IS NULL OR (wanted <> type AND type <> 'reference')").select(
        *ids,
        F.when(F.col("wanted").isNull(), F.concat(F.lit("unknown "), "parameter"))
        .otherwise(F.concat(F.lit("type of "), "parameter"))
        .alias("problem"),
    )
    needed = calls.select(*ids, "tool").distinct().join(declared.filter("required"), "tool")
    missing = needed.join(given.select(*ids, "parameter"), [*ids, "parameter"], "left_anti").select(
        *ids, F.concat(F.lit("missing "), "parameter").alias("problem")
    )
    tools = declared.select("tool").distinct()
    no_tool = calls.join(tools, "tool", "left_anti").select(*ids, F.lit("unknown tool").alias("problem"))
    malformed = calls.filter(
        ~F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    ).select(*ids, F.lit("malformed arguments").alias("problem"))
    found = wrong.union(missing).union(no_tool).union(malformed)
    return found.groupBy(*ids).agg(F.sort_array(F.collect_set("problem")).alias("problems"))


#: Lengths of ways stop growing here: on a cycle they would double for ever.
_FAR = 1 << 40


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conversation, call_id, level`` of the calls of conversations out of turn order.

    ``edges`` says which call needs which (``call_id, needs``). A call's level is one more
    than the highest of those it needs; calls on a cycle, or behind one, have none. Each
    round settles the calls that only need settled ones, and lets every need of a call that
    itself has a single need point on to that one, the way between them counted. Chains
    halve with each round, so rounds grow with the logarithm of their length, and with the
    number of calls of several needs that follow each other.
    """
    ids = ["conversation", "call_id"]
    settled = calls.join(edges.select(*ids).distinct(), ids, "left_anti").select(*ids, F.lit(0).cast("long").alias("level"))
    settled = land(settled, "settled")
    ways = land(edges.select(*ids, "needs", F.lit(1).cast("long").alias("way"), F.lit(None).cast("long").alias("level")), "ways")
    fresh = settled
    while not fresh.isEmpty() and not ways.isEmpty():
        known = fresh.select("conversation", F.col("call_id").alias("needs"), F.col("level").alias("found"))
        met = ways.join(known, ["conversation", "needs"], "left")
        found = land(met.select(*ids, "needs", "way", F.coalesce("level", "found").alias("level")), "found")
        ready = found.groupBy(*ids).agg(
            F.bool_and(F.col("level").isNotNull()).alias("ready"), F.max(F.col("level") + F.col("way")).alias("level")
        )
        fresh = land(ready.filter("ready").select(*ids, "level"), "fresh")
        left = land(found.join(fresh.select(*ids), ids, "left_anti"), "left")
        single = left.groupBy(*ids).agg(
            F.count("*").alias("n"), F.min("needs").alias("next"), F.min("way").alias("more")
        )
        onwards = single.filter("n = 1 AND next <> call_id").select(
            "conversation", F.col("call_id").alias("needs"), "next", "more"
        )
        jumped = left.join(onwards, ["conversation", "needs"], "left").select(
            *ids,
            F.coalesce("next", "needs").alias("needs"),
            F.least(F.col("way") + F.coalesce("more", F.lit(0)), F.lit(_FAR)).alias("way"),
            "level",
        )
        ways = land(jumped.groupBy(*ids, "needs").agg(F.max("way").alias("way"), F.max("level").alias("level")), "ways")
        settled = settled.union(fresh)
    return settled


def positions(calls: DataFrame) -> DataFrame:
    """Number the calls of each conversation 0, 1, 2, … by ``level, turn, call_id``.

    Blocks of turns are numbered on their own; a table with one row per block gives their
    first numbers, so a conversation of any length is spread over many tasks.
    """
    block = F.expr(f"turn div {BLOCK}")
    dealt = calls.withColumn("block", block)
    sizes = dealt.groupBy("conversation", "level", "block").agg(F.count("*").alias("n"))
    along = Window.partitionBy("conversation").orderBy(F.col("level").asc_nulls_last(), "block")
    starts = sizes.select(
        F.col("conversation").alias("c"), F.col("level").alias("l"), F.col("block").alias("b"),
        (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"),
    )
    own = Window.partitionBy("conversation", "level", "block").orderBy("turn", "call_id")
    same = (
        F.col("conversation").eqNullSafe(F.col("c"))
        & F.col("level").eqNullSafe(F.col("l"))
        & F.col("block").eqNullSafe(F.col("b"))
    )
    numbered = dealt.withColumn("rank", F.row_number().over(own) - 1).join(starts, same)
    return numbered.withColumn("position", F.col("rank") + F.col("first")).drop(
        "c", "l", "b", "block", "rank", "first"
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with their results, in an order that their references allow, as canonical JSON.

    ``calls``: ``conversation, turn, call_id, tool, arguments`` (JSON text). ``results``:
    ``conversation, call_id, content``. ``schemas``: ``tool, parameter, type, required``,
    types being string, number, boolean, object, array and null.

    One row per call: ``conversation, call_id, tool, position, cyclic, n_results, problems,
    valid, json``. ``position`` numbers the calls of a conversation in topological order
    (an argument ``"$result:ID"`` needs the call ID): by turn where no call needs a later
    one, else by level of need, then turn; calls on or behind a cycle come last with
    ``cyclic`` true. ``problems`` lists what is wrong: unknown tool, malformed arguments,
    unknown, missing or ill-typed parameters, unknown reference, no result, several
    results; ``valid`` calls have none. ``json`` has sorted keys and no spaces: arguments, id,
    name, and the result if there is just one. Nulls inside arguments stay, as they are
    values; equal numbers are spelled alike (100, 1e2 and 100.0 as 100; see
    ``plain_numbers``).

    All links are hash joins on conversation and call id. No conversation is gathered in
    one task.

    Null or malformed arguments are a problem and are left out of the JSON; so is a null
    tool. Repeated ids within a conversation are one call, the first by turn, then by
    content; identical results are one result. Calls without conversation, turn or id are
    left out. Empty tables give no rows; extra columns are not read.
    """
    ids = ["conversation", "call_id"]
    named = F.col("conversation").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "tool", "arguments")).alias("x")
    calls = calls.filter(named & F.col("turn").isNotNull())
    calls = calls.groupBy(*ids).agg(first).select(*ids, "x.*")
    calls = land(calls.withColumn("arguments", plain_numbers(F.col("arguments"))), "calls")
    answered = (
        results.filter(named)
        .select(*ids, F.coalesce("content", F.lit("")).alias("content"))
        .distinct()
        .groupBy(*ids)
        .agg(F.count("*").alias("n_results"), F.min("content").alias("content"))
    )
    needs = land(
        calls.select(*ids, "turn", F.explode(references(F.col("arguments"))).alias("needs"))
        .join(
            calls.select("conversation", F.col("call_id").alias("needs"), F.col("turn").alias("needed_turn")),
            ["conversation", "needs"],
            "left",
        ),
        "needs",
    )
    unknown = needs.filter("needed_turn IS NULL").select(*ids).distinct()
    edges = needs.filter("needed_turn IS NOT NULL")
    late = land(edges.filter("needed_turn >= turn").select("conversation").distinct(), "late")
    out_of_turn = levels(
        calls.join(late, "conversation", "left_semi"),
        edges.join(late, "conversation", "left_semi").select(*ids, "needs"),
    )
    in_order = calls.join(late, "conversation", "left_anti").withColumn("level", F.lit(0).cast("long"))
    sorted_out = calls.join(late, "conversation", "left_semi").join(out_of_turn, ids, "left")
    placed = positions(in_order.union(sorted_out.select(in_order.columns)))
    everything = (
        placed.join(answered, ids, "left")
        .join(argument_problems(calls, schemas), ids, "left")
        .join(unknown.withColumn("unknown", F.lit(True)), ids, "left")
        .withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
    )
    own = F.coalesce("problems", F.array().cast("array<string>"))
    more = F.array_compact(
        F.array(
            F.when(F.col("unknown"), "unknown reference"),
            F.when(F.col("n_results") == 0, "no result"),
            F.when(F.col("n_results") > 1, "several results"),
        )
    )
    variant = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    member = F.struct(
        F.when(is_object, variant).alias("arguments"),
        F.col("call_id").alias("id"),
        F.col("tool").alias("name"),
        F.when(F.col("n_results") == 1, F.col("content")).alias("result"),
    )
    # Numbers that are doubles still, such as 1e300, get no needless fraction.
    text = F.regexp_replace(F.to_json(member), r'("(?:[^"\\]|\\.)*+")|(-?\d+)\.0(?=[E,}\]])', "$1$2")
    return everything.select(
        *ids, "tool", F.col("position").cast("long").alias("position"), F.col("level").isNull().alias("cyclic"),
        "n_results", F.sort_array(F.concat(own, more)).alias("problems"), text.alias("json"),
    ).withColumn("valid", (F.size("problems") == 0) & ~F.col("cyclic"))
