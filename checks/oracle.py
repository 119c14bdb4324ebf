"""The SQL counterpart of every query that SQL can express, for DuckDB."""

from __future__ import annotations

from checks import expected as ex

# Whitespace as one character class of the RE2 dialect.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(value: str) -> str:
    """A string literal; control characters are spelled as chr(n)."""
    parts, plain = [], ""
    for ch in value:
        if ch < " ":
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += "''" if ch == "'" else ch
    parts += [f"'{plain}'"] if plain or not parts else []
    return "(" + " || ".join(parts) + ")"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def strip_prefix(x: str) -> str:
    return f"regexp_replace({x}, '(?i)^(?:(?:re|fw|fwd){WS}*:{WS}*)+', '')"


def seeded(x: str = "key") -> str:
    return f"md5('42|' || {x})"


_TAG = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>])?)*>"""
_MARKUP = "(?is)<(?:" + "|".join(
    [
        r"!--.*?-->",
        rf"script(?:[\s/]{_TAG}|>).*?(?:</script\s*>|\z)",
        rf"style(?:[\s/]{_TAG}|>).*?(?:</style\s*>|\z)",
        rf"/?[a-z]{_TAG}",
        r"[!?][^>]*>",
        r"/[^a-z>][^>]*>",
    ]
) + ")"


def html_text(x: str) -> str:
    out = f"regexp_replace({x}, '{_MARKUP}', ' ', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = rf"regexp_replace({out}, '&{name}(?:;|\b)', '{char}', 'g')"
    return squash(out)


MAIL = """mail AS (
  SELECT d.doc_id AS key, split_part(d.text, chr(10), 1) AS subject,
    CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1)
         ELSE '' END AS body,
    l.toxic AS label,
    CAST(CASE WHEN coalesce(l.toxic, 0) = 0 THEN 1 ELSE 2 + d.doc_id % 3 END AS INTEGER) AS dataset
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CLEANED = f"""cleaned AS (
  SELECT key, {squash('subject')} AS subject, {squash('body')} AS body, label, dataset
  FROM mail)"""

DEDUPED = """deduped AS (
  SELECT * FROM cleaned
  WHERE subject <> '' AND body <> '' AND length(subject) + length(body) >= 20
  QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY key) = 1)"""

LABELLED = "labelled AS (SELECT * FROM deduped WHERE label IS NOT NULL)"

PRED = """pred AS (
  SELECT *, CASE key % 11 WHEN 0 THEN 'unsure' WHEN 1 THEN NULL
    WHEN 2 THEN 'legitimate, not phishing' WHEN 3 THEN ' Phishing.'
    ELSE CASE WHEN label = 1 THEN 'phishing' ELSE 'Legitimate' END END AS raw_prediction
  FROM labelled)"""

ANY_LABEL = """CAST(CASE WHEN contains(lower(raw_prediction), 'phishing') THEN 1
  WHEN contains(lower(raw_prediction), 'legitimate') THEN 0 END AS INTEGER)"""

FIRST_LABEL = """CAST(CASE
  WHEN strpos(lower(raw_prediction), 'phishing') > 0
   AND (strpos(lower(raw_prediction), 'legitimate') = 0
     OR strpos(lower(raw_prediction), 'phishing') < strpos(lower(raw_prediction), 'legitimate')) THEN 1
  WHEN strpos(lower(raw_prediction), 'legitimate') > 0 THEN 0 END AS INTEGER)"""

ANSWERED = f"answered AS (SELECT *, {ANY_LABEL} AS predicted_label FROM pred)"

BALANCED = f"""balanced AS (
  SELECT * FROM labelled
  QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY {seeded()}, key)
    <= (SELECT count(*) FROM labelled WHERE label = 1))"""

# Exact quotas by largest remainder, ties to the smaller class; train first, then valid.
SPLIT = f"""sizes AS (
  SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM balanced GROUP BY label),
parts AS (SELECT *, CAST(ceil(n * 2 / 10.0) AS BIGINT) AS held FROM sizes),
train_exact AS (SELECT *, ((n - held) * c) // n AS base, ((n - held) * c) % n AS rest FROM parts),
train_quota AS (
  SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
    <= (n - held) - sum(base) OVER () THEN 1 ELSE 0 END AS train FROM train_exact),
valid_exact AS (
  SELECT *, held - CAST(ceil(held / 2.0) AS BIGINT) AS v, c - train AS h FROM train_quota),
valid_parts AS (SELECT *, (v * h) // held AS vbase, (v * h) % held AS vrest FROM valid_exact),
quota AS (
  SELECT label, train, vbase + CASE WHEN row_number() OVER (ORDER BY vrest DESC, label)
    <= v - sum(vbase) OVER () THEN 1 ELSE 0 END AS valid FROM valid_parts),
split_mail AS (
  SELECT b.*, CASE WHEN r <= q.train THEN 'train' WHEN r <= q.train + q.valid THEN 'valid'
    ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded()}, key) AS r
        FROM balanced) b
  JOIN quota q ON q.label = b.label)"""

RAW = """raw AS (
  SELECT *, 'From: sender' || (key % 20) || '@example.com' || chr(10)
    || CASE WHEN key % 50 = 0 THEN '' ELSE 'Subject: '
       || CASE WHEN key % 3 = 0 THEN 'RE: Fwd : ' ELSE '' END || subject || chr(10) END
    || chr(10) || body AS message
  FROM mail)"""

_LABELLED = (MAIL, CLEANED, DEDUPED, LABELLED)
_PRED = (*_LABELLED, PRED)
_ANSWERED = (*_PRED, ANSWERED)
_SPLIT = (*_LABELLED, BALANCED, SPLIT)


def using(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def mail_text_sql(s: str = "subject", b: str = "body") -> str:
    return f"'Subject: ' || coalesce({s}, '') || chr(10) || 'Body: ' || coalesce({b}, '')"


WORD = "CASE WHEN label = 1 THEN 'phishing' ELSE 'legitimate' END"

VALIDITY = """count(*) AS total,
  count(*) FILTER (predicted_label IN (0, 1)) AS n,
  count(*) FILTER (predicted_label IS NULL) AS invalid"""

COUNTS = """count(*) FILTER (label = 1 AND predicted_label = 1) AS "TP",
  count(*) FILTER (label = 0 AND predicted_label = 0) AS "TN",
  count(*) FILTER (label = 0 AND predicted_label = 1) AS "FP",
  count(*) FILTER (label = 1 AND predicted_label = 0) AS "FN" """


def ratios(source: str, keep: str = "*") -> str:
    """Quality ratios over a table of counts, zero where the denominator is."""
    return f"""SELECT {keep}, round("Accuracy", 6) AS "Accuracy", round("Precision", 6) AS "Precision",
  round("Recall", 6) AS "Recall",
  round(CASE WHEN "Precision" + "Recall" = 0 THEN 0.0
    ELSE 2 * "Precision" * "Recall" / ("Precision" + "Recall") END, 6) AS "F1-score"
FROM (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE ("TP" + "TN")::DOUBLE / n END AS "Accuracy",
  CASE WHEN "TP" + "FP" = 0 THEN 0.0::DOUBLE ELSE "TP"::DOUBLE / ("TP" + "FP") END AS "Precision",
  CASE WHEN "TP" + "FN" = 0 THEN 0.0::DOUBLE ELSE "TP"::DOUBLE / ("TP" + "FN") END AS "Recall"
  FROM ({source}))"""


_KEEP_COUNTS = 'total, n, invalid, "TP", "TN", "FP", "FN"'


def gate_sql(threshold: float, display: bool = False) -> str:
    unusable, how = ("BLOCK", "strict") if threshold <= 0.5 else ("PASS", "lenient")

    def text(i: int) -> str:
        shown = {k: v[i].replace("{threshold}", str(threshold)) for k, v in ex.GATE_TEXTS.items()}
        return f"""replace(CASE WHEN blank THEN {lit(shown['blank'])} WHEN answer LIKE '%phishing%' THEN
          {lit(shown['phishing'])} WHEN answer LIKE '%legitimate%' THEN {lit(shown['legitimate'])}
          ELSE {lit(shown[how])} END, '{{answer}}', answer)"""

    names = ("reason", "shown_level", "shown_action", "shown_details")
    texts = "".join(f"{text(i)} AS {n}, " for i, n in enumerate(names[: 4 if display else 1]))
    return f"""SELECT key, {texts}
  CASE WHEN blank THEN NULL ELSE answer END AS response,
  CASE WHEN blank THEN 0.0 WHEN answer LIKE '%phishing%' THEN 1.0
    WHEN answer LIKE '%legitimate%' THEN 0.0 ELSE 0.5 END::DOUBLE AS risk_score,
  CASE WHEN blank THEN 'NONE' WHEN answer LIKE '%phishing%' THEN 'HIGH'
    WHEN answer LIKE '%legitimate%' THEN 'LOW' ELSE 'UNKNOWN' END AS risk_level,
  CASE WHEN blank THEN 'ERROR' WHEN answer LIKE '%phishing%' THEN 'BLOCK'
    WHEN answer LIKE '%legitimate%' THEN 'PASS' ELSE '{unusable}' END AS action"""


GATE_INPUT = f"""gate_input AS (
  SELECT key, trim(lower(coalesce(raw_prediction, '')), ' ') AS answer,
    key % 13 = 0 OR {squash('body')} = '' AS blank FROM pred)"""

def score_sql(p: str, margin: float) -> str:
    return f"""CASE WHEN ({p}) IS NULL OR abs(({p}) - 0.5) < {margin} THEN 'unsure'
      WHEN ({p}) >= 0.5 THEN 'phishing' ELSE 'legitimate' END"""


LOSS = "-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)"


def p_sql(step: str = "") -> str:
    return f"((key * 7919{step}) % 997 + 1) / 998.0::DOUBLE"


def funnel_sql(by: str = "") -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}count(*) AS original, count(*) AS parsed,
  count(*) FILTER (step = 1) AS empty_subject, count(*) FILTER (step = 2) AS empty_body,
  count(*) FILTER (step = 3) AS short,
  count(*) FILTER (step = 4) - count(DISTINCT (subject, body)) FILTER (step = 4) AS duplicate,
  count(DISTINCT (subject, body)) FILTER (step = 4) AS final
FROM (SELECT *, CASE WHEN subject = '' THEN 1 WHEN body = '' THEN 2
  WHEN length(subject) + length(body) < 20 THEN 3 ELSE 4 END AS step FROM cleaned) {group}"""


def turns_sql(source: str, cue: str, spec: str = "") -> str:
    listed = f"{ex.TOOLS_INTRO}\n{spec}{ex.TOOLS_OUTRO}" if spec else ""
    return f"""SELECT conv_id, turn,
  CASE WHEN before IS NULL THEN {lit(ex.TURN_START + "system" + chr(10))}
    || CASE WHEN role = 'system' THEN text ELSE {lit(ex.DEFAULT_SYSTEM)} END
    || {lit(listed + ex.TURN_END)} ELSE '' END
  || CASE WHEN role = 'system' AND before IS NULL THEN ''
    WHEN role = 'assistant' AND calls <> ''
      THEN '<|im_start|>assistant' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END
        || calls || '<|im_end|>' || chr(10)
    WHEN role IN ('system', 'user', 'assistant')
      THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
    WHEN role = 'tool' THEN CASE WHEN before = 'tool' THEN '' ELSE '<|im_start|>user' END
      || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>'
      || CASE WHEN after = 'tool' THEN '' ELSE '<|im_end|>' || chr(10) END
    ELSE '' END
  || CASE WHEN after IS NULL THEN {lit(cue)} ELSE '' END AS piece
FROM (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM ({source})
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def chat_sql(with_answer: bool) -> str:
    turns = f"""'<|im_start|>system' || chr(10) || {lit(ex.TRAIN_SYSTEM)} || '<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || {mail_text_sql()} || '<|im_end|>' || chr(10)"""
    if with_answer:
        turns += f" || '<|im_start|>assistant' || chr(10) || {WORD} || '<|im_end|>' || chr(10)"
    return turns


def compact_sql(x: str, size: int) -> str:
    return f"""CASE WHEN length({x}) > {size} THEN substr({x}, 1, {int(size * 0.65)})
  || {lit(ex.TRUNCATION_MARK)} || right({x}, {int(size * 0.25)}) ELSE {x} END"""


def keep_links_sql(size: int, words: list[str]) -> str:
    head, tail = int(size * 0.65), int(size * 0.25)
    marked = rf"""(?i)(?:https?://|www\.)[^\s<>"'']+|(?i)\b(?:{'|'.join(words)})"""
    mark = lit(ex.TRUNCATION_MARK)
    return f"""SELECT key, CASE WHEN n <= {size} THEN t ELSE
    substr(t, 1, first) || {mark} || coalesce(array_to_string(list_transform(
      list_filter(range(1, len(s) + 1), lambda i: hit[i] OR coalesce(hit[i - 1] AND i > 1, false)
        OR coalesce(hit[i + 1], false)), lambda i: s[i]), ' '), '')
    || {mark} || substr(t, greatest(first, last) + 1) END AS text
FROM (SELECT *, list_transform(s, lambda x: regexp_matches(x, '{marked}')) AS hit
  FROM (SELECT *, string_split(regexp_replace(
      substr(t, first + 1, greatest(last - first, 0)), '([.!?\\n])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS s
    FROM (SELECT *, {head} + length(regexp_extract(substr(t, {head + 1}), '^\\S*')) AS first,
        n - {tail} - length(regexp_extract(substr(t, 1, greatest(n - {tail}, 0)), '\\S*$')) AS last
      FROM (SELECT key, {mail_text_sql()} AS t, length({mail_text_sql()}) AS n FROM warned))))"""


def labels_sql() -> str:
    ids = "list_transform(string_split({}, ' '), lambda w: length(w))"
    prompt = chat_sql(False)
    return f"""SELECT key, CAST(len(labels) AS INTEGER) AS n_labels, array_to_string(labels, ' ') AS labels
FROM (SELECT key, CASE WHEN hidden >= len(f) THEN
    list_concat(list_transform(f[1:len(f) - 1], lambda x: -100), f[len(f):len(f)])
    ELSE list_transform(range(1, len(f) + 1), lambda i: CASE WHEN i <= hidden THEN -100 ELSE f[i] END) END AS labels
  FROM (SELECT key, f[1:256] AS f, least(len(p[1:256]), len(f[1:256])) AS hidden
    FROM (SELECT key, {ids.format(f"({prompt})")} AS p,
      {ids.format(f"({prompt} || ' the answer is ' || {WORD})")} AS f FROM labelled)))"""


def bands_sql() -> str:
    rows = [
        f"""SELECT '{m}' AS metric, "{m}" AS value, {low}::DOUBLE AS low, {high}::DOUBLE AS high FROM metrics"""
        for m, (low, high) in ex.TARGET_BANDS.items()
    ]
    return "SELECT *, CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'within' END AS verdict FROM (" + " UNION ALL ".join(rows) + ")"


CONV = "SELECT *, '' AS calls FROM conversations"
CONV_TOOLS = """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 1 THEN '' ELSE text END AS text,
  repeat(chr(10) || '<tool_call>' || chr(10) || '{"name": "look_up", "arguments": {"turn": ' || turn || '}}'
    || chr(10) || '</tool_call>', CAST(conv_id % 3 AS INTEGER)) AS calls, CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 'tool'
  WHEN (turn + conv_id) % 3 = 2 THEN 'tool' ELSE role END AS role FROM conversations"""

COUNTED = f"counted AS (SELECT {VALIDITY}, {COUNTS} FROM answered)"

_RAW_CLEAN = f"""cleaned AS (
  SELECT key, {squash(strip_prefix(f"CASE WHEN key % 50 = 0 THEN '' ELSE ltrim(CASE WHEN key % 3 = 0 THEN 'RE: Fwd : ' ELSE '' END || subject, ' ' || chr(9)) END"))} AS subject,
    {squash('body')} AS body, 0 AS label, 1 AS dataset FROM mail)"""

def digest_sql(*columns: str) -> str:
    parts = (f"length({c}::VARCHAR) || '|' || {c}::VARCHAR" for c in columns)
    return f"upper(sha256({' || '.join(parts)}))"


# Two cleaned corpora under content keys, cut down to equal classes.
_BUILT = f"""legit AS (
  SELECT subject, body, 0 AS label, 1 AS dataset FROM (
    SELECT key, {squash(strip_prefix('subject'))} AS subject, {squash('body')} AS body
    FROM mail WHERE dataset = 1)
  WHERE subject <> '' AND body <> '' AND length(subject) + length(body) >= 20
  QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY key) = 1),
html_mail AS (
  SELECT subject, body, 1 AS label, 2 AS dataset FROM (
    SELECT page_id, {squash('url')} AS subject, {html_text('html')} AS body FROM pages)
  WHERE subject <> '' AND length(body) >= 20
  QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY page_id) = 1),
labelled AS (
  SELECT *, {digest_sql('dataset', 'subject', 'body')} AS key
  FROM (FROM legit UNION ALL FROM html_mail))"""

_RUN = """SELECT '{name}' AS "Model", {validity}, {counts}
  FROM (SELECT *, {label} AS predicted_label FROM pred)"""

ORACLE: dict[str, str] = {
    "scan_raw_csv": using(MAIL, RAW, select="SELECT message FROM raw"),
    "scan_raw_json": using(MAIL, RAW, select="SELECT message FROM raw"),
    "scan_mbox": using(
        MAIL,
        select=r"""SELECT key, ltrim(subject, ' ' || chr(9)) AS subject,
          rtrim(regexp_replace(body, '(?m)^From ', '>From ', 'g'), chr(10)) AS body FROM mail""",
    ),
    "scan_tagged": using(
        MAIL,
        select="SELECT subject, body, 1 AS label, CASE WHEN key % 2 = 0 THEN 3 ELSE 4 END AS dataset FROM mail",
    ),
    "scan_clean": using(MAIL, CLEANED, DEDUPED, select="SELECT subject, body, label, dataset FROM deduped"),
    "scan_split": using(
        *_LABELLED, select="SELECT subject, body, label, dataset, 'test' AS split FROM labelled"
    ),
    "contract_report": using(
        *_SPLIT, select='SELECT split, label, count(*) AS n, 4 AS "columns" FROM split_mail GROUP BY ALL'
    ),
    "roundtrip_csv": using(MAIL, CLEANED, DEDUPED, select="SELECT key, subject, body, label, dataset FROM deduped"),
    "roundtrip_report": using(
        *_ANSWERED,
        select=f"""SELECT key AS index, dataset, subject, label, {WORD} AS expected, raw_prediction,
          predicted_label, coalesce(predicted_label = label, false) AS correct FROM answered""",
    ),
    "publish_splits": using(*_SPLIT, select="SELECT key, subject, label, split FROM split_mail WHERE split = 'test'"),
    "roundtrip_splits": using(*_SPLIT, select="SELECT key, subject, label, split FROM split_mail WHERE split <> 'train'"),
    "roundtrip_marked_csv": using(MAIL, CLEANED, DEDUPED, select="SELECT subject, body, label, dataset FROM deduped"),
    "preview": using(
        MAIL, CLEANED, DEDUPED,
        select="SELECT key, subject, substr(body, 1, 300) AS body, label FROM deduped ORDER BY key LIMIT 5",
    ),
    "parse_subject": using(
        MAIL, RAW,
        select=r"""SELECT key, regexp_extract(split_part(message, chr(10) || chr(10), 1),
          '(?im)^Subject:[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)', 1) AS subject FROM raw""",
    ),
    "parse_body_raw": using(
        MAIL, RAW,
        select="""SELECT key, substr(message, strpos(message, chr(10) || chr(10)) + 2) AS body, true AS parsed FROM raw""",
    ),
    "parse_body_decoded": using(MAIL, select="SELECT key, 'mail' AS subject, body FROM mail"),
    "parse_multipart": using(MAIL, select="SELECT key, 'mail' AS subject, subject || body AS body FROM mail"),
    "parse_quoted_printable": using(MAIL, select="SELECT key, 'mail' AS subject, body FROM mail"),
    "parse_nested": using(MAIL, select="SELECT key, 'mail' AS subject, body || subject AS body FROM mail"),
    "parse_skip_bad": using(
        MAIL, RAW,
        select=r"""SELECT key, regexp_extract(split_part(message, chr(10) || chr(10), 1),
          '(?im)^Subject:[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)', 1) AS subject FROM raw WHERE key % 10 <> 0""",
    ),
    "exclude_ordinals": """SELECT key, ordinal FROM (SELECT doc_id AS key,
        row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) - 1 AS ordinal FROM documents)
      WHERE ordinal NOT IN (16, 34, 42)""",
    "stamp_source": "SELECT doc_id AS key, 1 AS label, 2 AS dataset FROM documents",
    "fill_blank": using(
        MAIL, select="SELECT key, CASE WHEN key % 4 <> 0 THEN subject ELSE '' END AS subject FROM mail"
    ),
    "squash_ws": f"""SELECT doc_id AS key,
      {squash("' ' || chr(9) || ' ' || replace(text, ' t', ' ' || chr(12288) || chr(160) || 't') || chr(28)")} AS text
      FROM documents""",
    "strip_reply_prefix": using(
        MAIL,
        select=f"""SELECT key, {strip_prefix("CASE key % 3 WHEN 0 THEN 'RE: Fwd : fw:re:' WHEN 1 THEN ' Re: ' ELSE 'Re[2]: ' END || subject")} AS subject FROM mail""",
    ),
    "clean_subject": using(
        MAIL,
        f"""made AS (SELECT key, CASE WHEN key % 2 = 0 THEN 'FW:' || chr(9) ELSE 're : Re:' END
          || subject || ' ' || chr(10) AS x FROM mail)""",
        select=f"SELECT key, {squash(strip_prefix('x'))} AS stripped, {squash('x')} AS kept FROM made",
    ),
    "html_to_text": f"""SELECT page_id, (['a b', 'q', '漢', '1 < 2 &lt;', 's', 'a b', '漢 字'])[1 + page_id % 7] || ' ' || {html_text('html')} AS text
      FROM pages""",
    "filter_subject": using(MAIL, CLEANED, select="SELECT key, subject FROM cleaned WHERE subject <> ''"),
    "filter_body": using(MAIL, CLEANED, select="SELECT key FROM cleaned WHERE body <> ''"),
    "filter_body_min": using(MAIL, CLEANED, select="SELECT key FROM cleaned WHERE length(body) >= 20"),
    "filter_short": using(
        MAIL, CLEANED,
        select="""SELECT key, CAST(length(subject) + length(body) AS INTEGER) AS n_chars FROM cleaned
          WHERE length(subject) + length(body) >= 20""",
    ),
    "dedup_exact": using(
        MAIL, CLEANED,
        select="""SELECT key, dataset, subject, body FROM cleaned
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY dataset, key) = 1""",
    ),
    "clean_funnel": using(MAIL, CLEANED, select=funnel_sql()),
    "clean_funnel_by_source": using(MAIL, CLEANED, select=funnel_sql("dataset")),
    "clean_growing": using(
        MAIL, CLEANED,
        select="""SELECT key, subject, body, label, dataset, CAST(key % 3 AS INTEGER) AS batch FROM cleaned
          WHERE subject <> '' AND body <> '' AND length(subject) + length(body) >= 20
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY key % 3, key) = 1""",
    ),
    "clean_mail": using(MAIL, CLEANED, DEDUPED, select="SELECT key, subject, body, label, dataset FROM deduped"),
    "clean_mail_raw": using(
        MAIL, _RAW_CLEAN, DEDUPED, select="SELECT key, subject, body, label, dataset FROM deduped"
    ),
    "clean_mail_html": using(
        f"""cleaned AS (SELECT page_id AS key, {squash('url')} AS subject, {html_text('html')} AS body,
          1 AS label, 2 AS dataset FROM pages)""",
        select="""SELECT key, subject, body, label, dataset FROM cleaned
          WHERE subject <> '' AND length(body) >= 20
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY key) = 1""",
    ),
    "union_sources": using(
        MAIL,
        select="""SELECT key, dataset, subject FROM mail
          UNION ALL SELECT key, dataset, subject FROM mail WHERE dataset > 1""",
    ),
    "balance_classes": using(*_LABELLED, BALANCED, select="SELECT key, label, dataset, subject FROM balanced"),
    "shuffle_order": f"""SELECT doc_id AS key,
      row_number() OVER (ORDER BY {seeded('doc_id')}, doc_id) - 1 AS index FROM documents""",
    "stratified_split": using(*_SPLIT, select="SELECT key, label, split FROM split_mail"),
    "class_counts": using(
        *_SPLIT,
        select="""SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, label, count(*) AS n
          FROM split_mail GROUP BY GROUPING SETS ((split, label), (label))""",
    ),
    "source_label_counts": using(*_LABELLED, select="SELECT dataset, label, count(*) AS n FROM labelled GROUP BY ALL"),
    "split_sizes": using(*_SPLIT, select="SELECT split, count(*) AS n FROM split_mail GROUP BY split"),
    "sample_at_most": using(
        *_LABELLED, select=f"SELECT key, label FROM labelled ORDER BY {seeded()}, key LIMIT 100"
    ),
    "head_n": using(
        MAIL, CLEANED, DEDUPED, select="SELECT key, subject, label FROM deduped ORDER BY key LIMIT 200"
    ),
    "build_dataset": using(
        MAIL, _BUILT, BALANCED, SPLIT,
        select=f"""SELECT key, subject, label, dataset, split,
          row_number() OVER (ORDER BY {seeded()}, key) - 1 AS index FROM split_mail""",
    ),
    "training_rows": using(
        *_LABELLED,
        f"""drawn AS (SELECT *, {mail_text_sql()} AS text FROM labelled),
        asked AS (SELECT key, label, '<|im_start|>system' || chr(10) || {lit(ex.TRAIN_SYSTEM)}
          || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
          || '<|im_start|>assistant' || chr(10) AS prompt FROM drawn)""",
        select=f"""SELECT key, prompt, prompt || {WORD} || '<|im_end|>' || chr(10) AS "full" FROM asked""",
    ),
    "label_word": using(MAIL, select=f"SELECT key, {WORD} AS word, {WORD} AS padded FROM mail"),
    "mail_text": using(
        MAIL, select=f"SELECT key, {mail_text_sql(b='CASE WHEN key % 4 <> 0 THEN body END')} AS text FROM mail"
    ),
    "tagged_text": using(
        MAIL,
        select="""SELECT key, '[SUBJECT] ' || CASE WHEN key % 4 <> 0 THEN subject ELSE '' END
          || ' [BODY] ' || body AS text FROM mail""",
    ),
    "compact_text": using(
        MAIL, select=f"SELECT key, {compact_sql('t', 600)} AS text FROM (SELECT key, {mail_text_sql()} AS t FROM mail)"
    ),
    "fill_template": using(
        MAIL,
        select=f"""SELECT key, {lit('System:' + chr(10) + ex.EVAL_SYSTEM + chr(10) * 2 + 'User:' + chr(10) + 'Subject: ')}
          || '{{body}} ' || subject || chr(10) || 'Body: ' || body || chr(10) AS prompt FROM mail""",
    ),
    "chat_messages_body": using(
        MAIL,
        select=f"""SELECT key, '<|im_start|>system' || chr(10) || {lit(ex.EVAL_SYSTEM)} || {lit(ex.TURN_END)}
          || '<|im_start|>user' || chr(10) || {compact_sql('t', 600)} || {lit(ex.TURN_END)}
          || '<|im_start|>assistant' || chr(10) AS prompt FROM (SELECT key, 'Body: ' || coalesce(body, '') AS t FROM mail)""",
    ),
    "chat_messages": using(
        *_LABELLED,
        select=f"""SELECT key, 'system' AS role, {lit(ex.TRAIN_SYSTEM)} AS content FROM labelled
          UNION ALL SELECT key, 'user', {mail_text_sql()} FROM labelled
          UNION ALL SELECT key, 'assistant', {WORD} FROM labelled""",
    ),
    "render_chat": turns_sql(CONV, f"{ex.TURN_START}assistant\n"),
    "render_chat_tools": turns_sql(CONV_TOOLS, "", ex.TOOL_SPEC),
    "render_chat_mail": using(
        *_LABELLED,
        select=f"""SELECT key, {chat_sql(True)} AS "full",
          {chat_sql(False)} || '<|im_start|>assistant' || chr(10) AS prompt FROM labelled""",
    ),
    "instruction_rows": using(
        *_LABELLED,
        select=f"""SELECT key, CAST(json_object('instruction', {lit(ex.TRAIN_SYSTEM)},
          'input', {mail_text_sql()}, 'output', {WORD}) AS VARCHAR) AS record FROM labelled""",
    ),
    "answer_only_labels": using(*_LABELLED, select=labels_sql()),
    "resolve_columns": f"""SELECT doc_id AS key, '{ex.NO_SUBJECT}' AS subject, text AS email_text FROM documents
      UNION ALL SELECT doc_id, split_part(text, chr(10), 1),
        {lit(ex.SUBJECT_AS_BODY)} || split_part(text, chr(10), 1) FROM documents""",
    "mail_at": using(
        *_LABELLED,
        select=f"""SELECT index, key, subject FROM (SELECT *,
          row_number() OVER (ORDER BY {seeded()}, key) - 1 AS index FROM labelled) WHERE index = 7""",
    ),
    "compact_keep_links": using(
        MAIL, CLEANED, DEDUPED,
        f"""warned AS (SELECT key, subject, replace(body, ' the ', CASE WHEN key % 4 = 3 THEN ' http://x.example/y?z=1 '
          ELSE ' ' || ({ex.SENSITIVE_WORDS})[1 + key % 15] || ' ' END) AS body FROM deduped)""",
        select=keep_links_sql(400, ex.SENSITIVE_WORDS),
    ),
    "parse_answer_any": using(
        *_ANSWERED,
        select="""SELECT key, predicted_label AS label,
          coalesce(CAST(predicted_label AS VARCHAR), 'invalid') AS as_text FROM answered""",
    ),
    "parse_answer_first": using(
        *_PRED,
        select=f"SELECT key, {FIRST_LABEL} AS label, coalesce({FIRST_LABEL}, -1) AS as_number FROM pred",
    ),
    "prediction_rows": using(
        *_ANSWERED,
        select=f"""SELECT key AS index, dataset, subject, label, {WORD} AS expected, raw_prediction,
          predicted_label, coalesce(predicted_label = label, false) AS correct FROM answered""",
    ),
    "policy_gate": using(
        *_PRED, GATE_INPUT,
        select=" UNION ALL ".join(
            f"{gate_sql(t, True)}, {t}::DOUBLE AS threshold FROM gate_input" for t in (0.0, 0.5, 0.55, 1.0)
        ),
    ),
    "log_loss": using(
        *_LABELLED,
        select=f"""SELECT dataset, round(avg({LOSS}), 6) AS loss
          FROM (SELECT *, {p_sql()} AS p FROM labelled) GROUP BY dataset""",
    ),
    "log_loss_batched": using(
        *_LABELLED,
        select=f"""SELECT round(avg(loss), 6) AS loss FROM (SELECT avg({LOSS}) AS loss
          FROM (SELECT *, {p_sql()} AS p,
            (row_number() OVER (ORDER BY {seeded()}, key) - 1) // 16 AS batch FROM labelled)
          WHERE batch < 10 GROUP BY batch)""",
    ),
    "log_loss_all_batches": using(
        *_LABELLED,
        select=f"""SELECT round(avg(loss), 6) AS loss FROM (SELECT avg({LOSS}) AS loss
          FROM (SELECT *, {p_sql()} AS p,
            (row_number() OVER (ORDER BY {seeded()}, key) - 1) // 16 AS batch FROM labelled)
          GROUP BY batch)""",
    ),
    "best_candidate": using(
        *_LABELLED,
        select=f"""SELECT epoch, round(loss, 6) AS loss FROM (SELECT epoch, avg({LOSS}) AS loss
          FROM (SELECT *, {p_sql(' + epoch * 131')} AS p
            FROM (SELECT *, unnest([1, 2, 3]) AS epoch FROM labelled)) GROUP BY epoch)
          ORDER BY loss, epoch LIMIT 1""",
    ),
    "confusion": using(*_ANSWERED, select=f"SELECT {COUNTS} FROM answered"),
    "validity": using(*_ANSWERED, select=f"SELECT {VALIDITY} FROM answered"),
    "quality_overall": using(*_ANSWERED, COUNTED, select=ratios("SELECT * FROM counted", _KEEP_COUNTS)),
    "quality_conservative": using(
        *_ANSWERED,
        select="""SELECT count(*) AS total, round(count(*) FILTER (predicted_label = label)::DOUBLE
          / count(*), 6) AS "Conservative accuracy" FROM answered""",
    ),
    "quality_by_source": using(
        *_ANSWERED,
        select=ratios(f"SELECT dataset, {VALIDITY}, {COUNTS} FROM answered GROUP BY dataset", "dataset, " + _KEEP_COUNTS),
    ),
    "quality_report": using(
        *_ANSWERED,
        select=ratios(
            f"""SELECT dataset, CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE 'group' END AS scope,
              {VALIDITY}, {COUNTS} FROM answered GROUP BY GROUPING SETS ((dataset), ())""",
            "dataset, scope, " + _KEEP_COUNTS,
        ),
    ),
    "compare_runs": using(
        *_PRED,
        select=ratios(
            " UNION ALL ".join(
                _RUN.format(name=name, validity=VALIDITY, counts=COUNTS, label=label)
                for name, label in (("any mention", ANY_LABEL), ("first mention", FIRST_LABEL))
            ),
            '"Model", "TP", "TN", "FP", "FN"',
        ),
    ),
    "check_targets": using(
        *_ANSWERED, COUNTED,
        f"metrics AS ({ratios('SELECT * FROM counted', 'n')})",
        select=bands_sql(),
    ),
    "gate_stream": using(
        f"""arrived AS (SELECT page_id AS key, CASE WHEN page_id % 13 = 0 THEN '' ELSE {html_text('html')} END AS body
          FROM pages)""",
        f"""gate_input AS (SELECT key, body = '' AS blank, {score_sql("(length(body) % 100) / 100.0::DOUBLE", 0.05)} AS answer
          FROM arrived)""",
        select=f"{gate_sql(0.5)} FROM gate_input",
    ),
    "gate_stream_once": using(
        MAIL, CLEANED, DEDUPED,
        f"""gate_input AS (SELECT key, subject, body, false AS blank,
          {score_sql("(length(body) % 100) / 100.0::DOUBLE", 0.05)} AS answer FROM deduped)""",
        select=f"SELECT * EXCLUDE (key) FROM ({gate_sql(0.5).replace('SELECT key,', 'SELECT key, subject, body,', 1)} FROM gate_input)",
    ),
    "gate_stream_funnel": using(
        MAIL,
        f"""cleaned AS (SELECT {squash('subject')} AS subject, {squash('body')} AS body
          FROM mail, range(2) c(i) WHERE i = 0 OR key % 2 = 0)""",
        select=f"SELECT original, empty_subject, empty_body, short, duplicate, final FROM ({funnel_sql()})",
    ),
    "score_answers": using(
        *_LABELLED,
        select=f"""SELECT key, {score_sql('p', 0.05)} AS narrow, {score_sql('p', 0.4)} AS wide,
          {score_sql('CASE WHEN key % 5 <> 0 THEN p END', 0.0)} AS holed FROM (SELECT key, {p_sql()} AS p FROM labelled)""",
    ),
    "classify_batch": using(
        *_LABELLED,
        select="""SELECT count(*) AS n, count(*) AS in_range, count(*) AS agreeing, true AS beats_majority
          FROM labelled""",
    ),
    "predict_run": using(
        *_LABELLED,
        f"""asked AS (SELECT *, '<|im_start|>system' || chr(10) || {lit(ex.EVAL_SYSTEM)} || {lit(ex.TURN_END)}
          || '<|im_start|>user' || chr(10) || {mail_text_sql()} || {lit(ex.TURN_END)}
          || '<|im_start|>assistant' || chr(10) AS prompt FROM labelled)""",
        """pred AS (SELECT *, CASE length(prompt) % 4 WHEN 0 THEN 'Phishing.' WHEN 1 THEN 'legitimate'
          WHEN 2 THEN 'not legitimate but phishing' ELSE '?' END AS raw_prediction FROM asked)""",
        f"answered AS (SELECT *, {FIRST_LABEL} AS predicted_label FROM pred)",
        select=ratios(
            f"""SELECT dataset, CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE 'group' END AS scope,
              {VALIDITY}, {COUNTS} FROM answered GROUP BY GROUPING SETS ((dataset), ())""",
            "dataset, scope, " + _KEEP_COUNTS,
        ),
    ),
}

# A run that is stopped and goes on ends with the same tables.
ORACLE["predict_resumed"] = ORACLE["predict_run"]
