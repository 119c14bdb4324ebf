"""One query per operator with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import (
    decontam, html_density, langid, lines, minhash, packing, pq, quality, rules, structure, token_files, tokens, toolcalls,
)
from mailsift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(make: Query) -> Query:
    return QUERIES.setdefault(make.__name__, make)


@query
def op1_minhash_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), minhash.Scheme(words=4, percent=80))


ORACLE["op1_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id,
        unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS s
    FROM words WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


@query
def op2_token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_line_dedup(spark, sf):
    kept = lines.drop_shared_lines(table(spark, sf, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


ORACLE["op3_line_dedup"] = r"""
WITH places AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM places
), shared AS (
    SELECT k, max(doc_id) AS keeper FROM keyed
    WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT p.doc_id, p.line, p.place, s.k IS NOT NULL AND s.keeper <> p.doc_id AS lost
    FROM keyed p LEFT JOIN shared s ON p.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op4_benchmark_decontamination(spark, sf):
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# Units of measure and money; a fixed list.
_UNITS = """
    'cent', 'cents', 'dollar', 'dollars', 'euro', 'euros', 'pence', 'pound', 'pounds', 'percent',
    'sec', 'secs', 'second', 'seconds', 'minute', 'minutes', 'hr', 'hrs', 'hour', 'hours', 'day', 'days',
    'week', 'weeks', 'month', 'months', 'year', 'years',
    'mm', 'cm', 'km', 'millimeter', 'millimeters', 'centimeter', 'centimeters', 'centimetre', 'centimetres',
    'meter', 'meters', 'metre', 'metres', 'kilometer', 'kilometers', 'kilometre', 'kilometres',
    'inch', 'inches', 'foot', 'feet', 'yard', 'yards', 'mile', 'miles', 'kmh', 'mph', 'degree', 'degrees',
    'mg', 'kg', 'gram', 'grams', 'kilogram', 'kilograms', 'ton', 'tons', 'tonne', 'tonnes', 'lb', 'lbs', 'oz',
    'ounce', 'ounces', 'ml', 'milliliter', 'milliliters', 'liter', 'liters', 'litre', 'litres', 'gallon', 'gallons'"""
_TOKENS = r"""regexp_extract_all(
    regexp_replace(coalesce(text, ''), '(^|[.!?:;\n][ \t\n\r"''(]*)(\p{Lu})', '\1' || chr(1) || '\2', 'g'),
    '\x01?[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*')"""
_SYMBOLS = f"""[
    CASE WHEN substr(t, 1, 1) BETWEEN '0' AND '9' THEN '#number'
         WHEN ltrim(lower(t), chr(1)) IN ({_UNITS}) THEN '#unit'
         WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND length(t) > 1
              AND substr(t, 2) = lower(substr(t, 2)) THEN '#name'
         ELSE ltrim(lower(t), chr(1)) END
    FOR t IN tokens]"""
ORACLE["op4_benchmark_decontamination"] = f"""
WITH d AS (
    SELECT doc_id, tokens, {_SYMBOLS} AS symbols FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)
), b AS (
    SELECT item_id, tokens, {_SYMBOLS} AS symbols FROM (SELECT item_id, {_TOKENS} AS tokens FROM benchmark)
    WHERE len(tokens) >= 5
), dw AS (
    SELECT doc_id, unnest(range(1, len(symbols) - 3)) AS p,
           unnest([array_to_string(symbols[i:i + 4], ' ') FOR i IN range(1, len(symbols) - 3)]) AS s FROM d
), bw AS (
    SELECT *, count(*) OVER (PARTITION BY item_id) AS telling FROM (
        SELECT item_id, len(symbols) - 4 AS item_windows, unnest(range(1, len(symbols) - 3)) AS q,
               unnest([array_to_string(symbols[i:i + 4], ' ') FOR i IN range(1, len(symbols) - 3)]) AS s FROM b)
    WHERE NOT regexp_full_match(s, '(#[a-z]+ ?)+')
), hits AS (
    SELECT doc_id, item_id, telling, item_windows, p, q, p - q AS shift FROM dw JOIN bw USING (s)
), enough AS (
    SELECT doc_id, item_id FROM hits GROUP BY ALL
    HAVING count(DISTINCT q) >= least(0.5 * any_value(item_windows), any_value(telling), 9, 0.16 * any_value(item_windows + 4))
), slots AS (
    SELECT DISTINCT doc_id, item_id, shift, lower(b.tokens[i]) AS ours, lower(d.tokens[i + shift]) AS theirs
    FROM (SELECT DISTINCT doc_id, item_id, shift, unnest(range(q, q + 5)) AS i
          FROM hits JOIN enough USING (doc_id, item_id))
    JOIN b USING (item_id) JOIN d USING (doc_id)
    WHERE b.symbols[i] LIKE '#%'
), alignments AS (
    SELECT doc_id, item_id, shift, bool_or(ours <> theirs) AS reworded
    FROM slots GROUP BY ALL HAVING count(*) = count(DISTINCT ours)
), judged AS (
    SELECT h.*, coalesce(a.reworded, false) AS reworded
    FROM hits h JOIN enough USING (doc_id, item_id)
    LEFT JOIN alignments a ON a.doc_id = h.doc_id AND a.item_id = h.item_id AND a.shift = h.shift
    WHERE a.shift IS NOT NULL
       OR NOT EXISTS (FROM slots s WHERE s.doc_id = h.doc_id AND s.item_id = h.item_id AND s.shift = h.shift)
), runs AS (
    SELECT doc_id, item_id, count(*) + 4 AS run FROM (
        SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS island
        FROM (SELECT DISTINCT doc_id, item_id, shift, q FROM judged))
    GROUP BY doc_id, item_id, shift, island
), covers AS (
    SELECT doc_id, item_id, count(DISTINCT i) AS covered
    FROM (SELECT doc_id, item_id, unnest(range(q, q + 5)) AS i FROM judged) GROUP BY ALL
)
SELECT doc_id, item_id, item_windows, matched, longest_run, reworded FROM (
    SELECT doc_id, item_id, telling, item_windows, count(DISTINCT q) AS matched, bool_or(reworded) AS reworded
    FROM judged GROUP BY ALL)
JOIN (SELECT doc_id, item_id, max(run) AS longest_run FROM runs GROUP BY ALL) USING (doc_id, item_id)
JOIN covers USING (doc_id, item_id)
WHERE matched >= least(0.5 * item_windows, telling) OR longest_run >= 13 OR covered >= 0.8 * (item_windows + 4)
"""


@query
def op5_quality_classifier(spark, sf):
    return quality.classify(table(spark, sf, "documents"), quality.trusted_ids(table(spark, sf, "labels")))


# Conversations have no tool calls, so each user or system turn is read as a call with its
# whole text, whose answer is the next assistant turn. Some arguments are ill-typed, missing
# or unknown; numbers are spelled in several ways. In every fifth conversation each call
# needs the next one, in every fifth two calls need each other, and in the others some calls
# need the result of the call before or of the one after.
def _calls(turns: DataFrame) -> DataFrame:
    length, turn, conv = F.coalesce(F.length("text"), F.lit(0)), F.col("turn"), F.col("conv_id")

    def reference(to):
        return F.concat(F.lit(', "after": "$result:'), "conv_id", F.lit("-"), to, F.lit('"'))

    later = (
        F.when(conv % 5 == 0, 2)
        .when(conv % 5 == 1, F.when(turn % 4 < 2, 2).otherwise(-2))
        .when(turn % 6 == 2, -2)
        .when(turn % 12 == 4, 2)
    )
    more = F.when(later.isNotNull(), reference(turn + later)).when(length % 11 == 0, ', "lang": null').otherwise("")
    spelled = F.when(length % 4 == 1, ".0").when(length % 4 == 2, "e0").when(length % 4 == 3, ".000E+0").otherwise("")
    arguments = F.concat(
        F.lit('{"text": '),
        F.regexp_extract(F.to_json(F.array("text")), r"(?s)\A\[(.*)\]\z", 1),
        F.lit(', "limit": '),
        F.when(length % 7 == 0, '"many"').otherwise(F.concat(length.cast("string"), spelled)),
        more,
        F.lit("}"),
    )
    tool = (
        F.when(F.col("role") == "system", "configure")
        .when(turn % 10 == 8, "browse")
        .when(length % 3 == 0, "search")
        .otherwise("translate")
    )
    return turns.filter("role IN ('user', 'system')").select(
        F.col("conv_id").alias("conversation"),
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("call_id"),
        tool.alias("tool"),
        arguments.alias("arguments"),
    )


def _results(turns: DataFrame) -> DataFrame:
    asked = F.concat_ws("-", "conv_id", F.col("turn") - 1)
    return turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("conversation"), asked.alias("call_id"), F.col("text").alias("content")
    )


SCHEMAS = [
    ("configure", "text", "string", True),
    ("configure", "limit", "number", True),
    ("configure", "after", "string", False),
    ("search", "text", "string", True),
    ("search", "limit", "number", False),
    ("search", "after", "string", False),
    ("translate", "text", "string", True),
    ("translate", "limit", "number", False),
    ("translate", "after", "number", False),
    ("translate", "lang", "string", True),
]


@query
def op6_tool_calls(spark, sf):
    turns = table(spark, sf, "conversations")
    schemas = spark.createDataFrame(SCHEMAS, "tool string, parameter string, type string, required boolean")
    linked = toolcalls.link_tool_calls(_calls(turns), _results(turns), schemas)
    return linked.withColumn("problems", F.array_join("problems", "; "))


ORACLE["op6_tool_calls"] = r"""
WITH RECURSIVE calls AS (
    SELECT conv_id AS conversation, turn, conv_id || '-' || turn AS call_id, text, coalesce(length(text), 0) AS n,
           CASE WHEN role = 'system' THEN 'configure' WHEN turn % 10 = 8 THEN 'browse'
                WHEN n % 3 = 0 THEN 'search' ELSE 'translate' END AS tool,
           CASE WHEN conv_id % 5 = 0 THEN turn + 2
                WHEN conv_id % 5 = 1 THEN CASE WHEN turn % 4 < 2 THEN turn + 2 ELSE turn - 2 END
                WHEN turn % 6 = 2 THEN turn - 2 WHEN turn % 12 = 4 THEN turn + 2 END AS needs,
           n % 11 = 0 AND needs IS NULL AS has_lang,
           CASE WHEN n % 7 = 0 THEN '"many"' ELSE n::VARCHAR END AS wanted
    FROM conversations WHERE role IN ('user', 'system') AND turn IS NOT NULL AND conv_id IS NOT NULL
), answers AS (
    SELECT conv_id AS conversation, conv_id || '-' || (turn - 1) AS call_id,
           count(DISTINCT coalesce(text, '')) AS n_results, min(coalesce(text, '')) AS content
    FROM conversations WHERE role = 'assistant' GROUP BY ALL
), linked AS (
    SELECT c.*, o.turn AS found, coalesce(a.n_results, 0) AS n_results, a.content
    FROM calls c
    LEFT JOIN calls o ON o.conversation = c.conversation AND o.turn = c.needs
    LEFT JOIN answers a ON a.conversation = c.conversation AND a.call_id = c.call_id
), late AS (
    SELECT DISTINCT conversation FROM linked WHERE found >= turn
), ways AS (
    SELECT conversation, turn AS begun, turn AS at, 0 AS level FROM linked
    UNION ALL
    SELECT w.conversation, w.begun, l.found, w.level + 1
    FROM ways w JOIN linked l ON l.conversation = w.conversation AND l.turn = w.at
    WHERE l.found IS NOT NULL AND w.level <= (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY conversation))
), depths AS (
    SELECT w.conversation, begun AS turn, max(level) AS level, max(level) >= any_value(size) AS cyclic
    FROM ways w JOIN (SELECT conversation, count(*) AS size FROM calls GROUP BY ALL) USING (conversation) GROUP BY ALL
), levelled AS (
    SELECT l.*, CASE WHEN l.conversation NOT IN (FROM late) THEN 0 WHEN cyclic THEN NULL ELSE level END AS level
    FROM linked l JOIN depths USING (conversation, turn)
)
SELECT conversation, call_id, tool,
       row_number() OVER (PARTITION BY conversation ORDER BY level NULLS LAST, turn) - 1 AS position,
       level IS NULL AS cyclic, n_results,
       array_to_string(list_sort(list_filter([
           CASE WHEN tool = 'translate' AND NOT has_lang THEN 'missing lang' END,
           CASE WHEN n_results = 0 THEN 'no result' END,
           CASE WHEN n_results > 1 THEN 'several results' END,
           CASE WHEN tool = 'translate' AND has_lang THEN 'type of lang' END,
           CASE WHEN tool <> 'browse' AND n % 7 = 0 THEN 'type of limit' END,
           CASE WHEN tool <> 'browse' AND text IS NULL THEN 'type of text' END,
           CASE WHEN needs IS NOT NULL AND tool = 'browse' THEN 'unknown after' END,
           CASE WHEN tool <> 'translate' AND has_lang THEN 'unknown lang' END,
           CASE WHEN tool = 'browse' THEN 'unknown limit' END,
           CASE WHEN needs IS NOT NULL AND found IS NULL THEN 'unknown reference' END,
           CASE WHEN tool = 'browse' THEN 'unknown text' END,
           CASE WHEN tool = 'browse' THEN 'unknown tool' END], lambda x: x IS NOT NULL)), '; ') AS problems,
       '{"arguments":{'
           || CASE WHEN needs IS NOT NULL THEN '"after":"$result:' || conversation || '-' || needs || '",' ELSE '' END
           || CASE WHEN has_lang THEN '"lang":null,' ELSE '' END
           || '"limit":' || wanted || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '},"id":"' || call_id
           || '","name":"' || tool || '"'
           || CASE WHEN n_results = 1 THEN ',"result":' || to_json(content) ELSE '' END || '}' AS json,
       problems = '' AND level IS NOT NULL AS valid
FROM levelled
"""


@query
def op7_language_id(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query
def op8_html_extraction(spark, sf):
    return html_density.extract_text(table(spark, sf, "pages"))


@query
def op9_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_quality_rules(spark, sf):
    return rules.judge_quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )


@query
def op11_token_files(spark, sf):
    return token_files.roundtrip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_conversation_repair(spark, sf):
    return structure.repair_conversations(table(spark, sf, "conversations"))


@query
def op13_vector_codes(spark, sf):
    return pq.quantize(table(spark, sf, "embeddings"))


# One round after the other, each as the assignment of all parts and the entries that follow.
def _pq_sql() -> str:
    def assigned(entries: str) -> str:
        return f"""
    SELECT vec_id, p, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) AS best FROM (
        SELECT x.vec_id, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts x JOIN {entries} c USING (p)) GROUP BY ALL"""

    rounds = "".join(
        f"""), a{i} AS MATERIALIZED ({assigned(f"c{i}")}
), c{i + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT p, e, list(floored ORDER BY k) AS v FROM (
            SELECT p, e, k, (s - ((s % n) + n) % n) // n AS floored FROM (
                SELECT p, best.e AS e, k, sum(x)::BIGINT AS s, count(*) AS n
                FROM (SELECT vec_id, p, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM parts) JOIN a{i} USING (vec_id, p)
                GROUP BY ALL)) GROUP BY ALL) m ON m.p = c.p AND m.e = c.e
"""
        for i in range(pq.ROUNDS)
    )
    last = f"c{pq.ROUNDS}"
    return f"""
WITH vectors AS (
    SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM vectors, range(4) AS t(p)
), c0 AS MATERIALIZED (
    SELECT p, e, v FROM parts JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vectors ORDER BY vec_id LIMIT 256) USING (vec_id)
{rounds}), coded AS (
    SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM ({assigned(last)}) GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
FROM coded JOIN vectors USING (vec_id)
"""


ORACLE["op13_vector_codes"] = _pq_sql()
