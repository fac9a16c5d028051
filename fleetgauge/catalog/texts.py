"""Text, number and presentation queries."""

from pyspark.sql import functions as F

from fleetgauge.catalog.adapters import ANSWERS, epoch_seconds, raw_answers, with_
from fleetgauge.catalog.registry import query
from fleetgauge.fixed_values import (
    DROPPED_LINE_PREFIXES,
    ERROR_MARKERS,
    EXPLANATION_WORDS,
    PREFACES,
)
from fleetgauge.functions import numbers, present, text
from fleetgauge.functions.whitespace import WHITESPACE

# The whitespace set in the syntax of the comparison engine's regular expressions.
WS_INLINE_CLASS = (
    r"[\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CLASS = rf"[\n{WS_INLINE_CLASS[1:]}"
_W = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _trim(x: str, side: str = "trim") -> str:
    return f"{side}({x}, {_W})"


def _lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def _join(x: str) -> str:
    return f"array_to_string({x}, chr(10))"


def _fences(x: str) -> str:
    a = f"regexp_replace({_trim(x)}, {_q(f'^(?i:```python{WS_CLASS}*)')}, '')"
    b = f"regexp_replace({a}, {_q(f'^```{WS_CLASS}*')}, '')"
    close = r"```\n?\z"
    return _trim(f"regexp_replace({b}, {_q(close)}, '')")


def _preface(x: str) -> str:
    phrases = "|".join(p.replace(" ", f"{WS_CLASS}+") for p in PREFACES)
    return _trim(f"regexp_replace({x}, {_q(f'^(?i:{phrases})[:.]?{WS_CLASS}*')}, '')")


_SIGNATURE = _q(rf"\A[\s\S]*?:{WS_INLINE_CLASS}*(\n|\z)")


def _after(x: str) -> str:
    cut = f"substr({x}, strpos({x}, 'def ' || entry_point) + length('def ' || entry_point))"
    return f"regexp_replace({cut}, {_SIGNATURE}, '')"


def _docstrings(x: str) -> str:
    dq, sq = "chr(34) || chr(34) || chr(34)", "chr(39) || chr(39) || chr(39)"
    line = _trim("b.o[1]")

    def two(mark: str) -> str:
        return f"(length({line}) - length(replace({line}, {mark}, '')) = 6)"

    opens = f"(starts_with({line}, {dq}) OR starts_with({line}, {sq}))"
    states = f"list_transform({_lines(x)}, lambda l: {{'d': false, 'o': [l]}})"
    start = "[{'d': false, 'o': CAST([] AS VARCHAR[])}]"
    step = (
        f"CASE WHEN {opens} THEN CASE WHEN a.d THEN {{'d': false, 'o': a.o}}"
        f" ELSE {{'d': NOT ({two(dq)} OR {two(sq)}), 'o': a.o}} END"
        f" WHEN a.d THEN a ELSE {{'d': false, 'o': a.o || b.o}} END"
    )
    return _join(f"(list_reduce(list_concat({start}, {states}), lambda a, b: {step})).o")


def _statements(x: str) -> str:
    starts = "|".join(DROPPED_LINE_PREFIXES)
    keep = f"NOT regexp_matches({_trim('l')}, {_q(f'^({starts})')})"
    return _join(f"list_filter({_lines(x)}, lambda l: {keep})")


def _bare(x: str) -> str:
    return f"regexp_replace({_trim(x, 'rtrim')}, {_q(rf'\A{WS_CLASS}*\n')}, '')"


def _cut(x: str, edge: str = r"([^\p{L}\p{N}_]|\z)") -> str:
    stop = _q(rf"^(```|(?i:{'|'.join(EXPLANATION_WORDS)}){edge})")
    at = f"list_position(list_transform({_lines(x)}, lambda l: regexp_matches({_trim('l')}, {stop})), true)"
    kept = f"CASE WHEN coalesce({at}, 0) = 0 THEN {_lines(x)} ELSE {_lines(x)}[1:{at} - 1] END"
    return _trim(_join(kept), "rtrim")


def _width(line: str) -> str:
    return f"(length({line}) - length({_trim(line, 'ltrim')}))"


def _reindent(x: str, base: int = 4) -> str:
    full = f"list_filter({_lines(x)}, lambda l: {_trim('l')} <> '')"
    least = f"list_min(list_transform({full}, lambda m: {_width('m')}))"
    moved = (
        f"list_transform({full}, lambda k: repeat(' ', CAST({_width('k')} - {least} + {base} AS INT))"
        f" || {_trim('k', 'ltrim')})"
    )
    return _trim(_join(moved), "rtrim")


def _dedent(x: str) -> str:
    full = f"list_filter({_lines(x)}, lambda l: {_trim('l')} <> '')"
    least = f"coalesce(list_min(list_transform({full}, lambda m: {_width('m')})), 0)"
    moved = (
        f"list_transform({_lines(x)}, lambda k: CASE WHEN {_trim('k')} = '' THEN ''"
        f" ELSE substr(k, {least} + 1) END)"
    )
    return _join(moved)


_PLAIN = f"plain AS (SELECT *, {_preface('fenceless')} AS plain FROM (SELECT *, {_fences('answer')} AS fenceless FROM answers) f)"
_CLEANED = f"""{_PLAIN},
cut0 AS (SELECT *, strpos(plain, 'def ' || entry_point) > 0 AS found FROM plain),
cut1 AS (SELECT *, CASE WHEN found THEN {_after('plain')} END AS after FROM cut0),
cut2 AS (SELECT *, CASE WHEN found THEN {_docstrings('after')} END AS undoc FROM cut1),
cut3 AS (SELECT *, CASE WHEN found THEN {_bare('undoc')} ELSE plain END AS body FROM cut2),
cut4 AS (SELECT *, {_statements('body')} AS stated FROM cut3),
cut5 AS (SELECT *, {_bare('stated')} AS kept FROM cut4),
cut6 AS (SELECT *, {_cut('kept')} AS code FROM cut5),
cleaned AS (SELECT doc_id, plain, after, undoc, CASE WHEN {_trim('code')} = '' THEN '' ELSE {_reindent('code')} END
  AS completion FROM cut6)"""


@query("strip_fences", "I1", sql=with_(ANSWERS) + f"SELECT doc_id, {_fences('answer')} AS plain FROM answers")
def strip_fences(t):
    return raw_answers(t).select("doc_id", text.strip_fences(F.col("answer")).alias("plain"))


@query("strip_preface", "I2", sql=with_(ANSWERS, _PLAIN) + "SELECT doc_id, plain FROM plain")
def strip_preface(t):
    plain = text.strip_preface(text.strip_fences(F.col("answer")))
    return raw_answers(t).select("doc_id", plain.alias("plain"))


@query(
    "body_after_def",
    "I3",
    sql=with_(ANSWERS)
    + f"""SELECT doc_id, CASE WHEN strpos(answer, 'def ' || entry_point) > 0 THEN {_after('answer')} ELSE answer END AS body
FROM answers""",
)
def body_after_def(t):
    return raw_answers(t).select(
        "doc_id", text.body_after_def(F.col("answer"), F.col("entry_point")).alias("body")
    )


@query(
    "drop_docstrings",
    "I4",
    sql=with_(ANSWERS) + f"SELECT doc_id, {_docstrings('answer')} AS body FROM answers",
)
def drop_docstrings(t):
    return raw_answers(t).select("doc_id", text.drop_docstrings(F.col("answer")).alias("body"))


@query(
    "drop_statements",
    "I5",
    sql=with_(ANSWERS) + f"SELECT doc_id, {_trim(_statements('answer'))} AS body FROM answers",
)
def drop_statements(t):
    return raw_answers(t).select(
        "doc_id", text.drop_leading_statements(F.col("answer")).alias("body")
    )


@query(
    "cut_explanation",
    "I6",
    sql=with_(ANSWERS)
    + f"SELECT doc_id, {_cut('answer')} AS body, {_cut('answer', '')} AS prefix_body FROM answers",
)
def cut_explanation(t):
    return raw_answers(t).select(
        "doc_id",
        text.cut_explanation(F.col("answer")).alias("body"),
        text.cut_explanation(F.col("answer"), compat=True).alias("prefix_body"),
    )


@query(
    "reindent", "I7", sql=with_(ANSWERS) + f"SELECT doc_id, {_reindent('answer')} AS body FROM answers"
)
def reindent(t):
    return raw_answers(t).select("doc_id", text.reindent(F.col("answer")).alias("body"))


@query("dedent", "I10", sql=with_(ANSWERS) + f"SELECT doc_id, {_dedent('answer')} AS body FROM answers")
def dedent(t):
    return raw_answers(t).select("doc_id", text.dedent(F.col("answer")).alias("body"))


@query(
    "extract_completion",
    "I8",
    sql=with_(ANSWERS, _CLEANED) + "SELECT doc_id, completion FROM cleaned",
)
def extract_completion(t):
    return raw_answers(t).select(
        "doc_id",
        text.extract_completion(F.col("answer"), F.col("entry_point")).alias("completion"),
    )


def _marked(t):
    """Documents, some holding an error marker, some cut to a few characters by their own words."""
    d = F.col("doc_id")
    marker = F.element_at(
        F.array(*[F.lit(m) for m in ERROR_MARKERS]), (d % len(ERROR_MARKERS) + 1).cast("int")
    )
    body = (
        F.when(d % 4 == 0, F.concat("text", F.lit(" "), marker))
        .when(d % 9 == 1, F.lit("  x \n"))
        .when(d % 9 == 2, F.lit("return x"))
        .otherwise(F.concat(F.lit("if a:\n    b\n"), "text"))
    )
    return t.documents.select("doc_id", "source", body.alias("output"))


_MARKED = (
    "marked AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN text || ' ' || (["
    + ", ".join(_q(m) for m in ERROR_MARKERS)
    + """])[doc_id % 6 + 1] WHEN doc_id % 9 = 1 THEN '  x ' || chr(10) WHEN doc_id % 9 = 2 THEN 'return x'
  ELSE 'if a:' || chr(10) || '    b' || chr(10) || text END AS output FROM documents)"""
)
_HAS_MARKER = " OR ".join(f"contains(output, {_q(m)})" for m in ERROR_MARKERS)


@query(
    "sanitized_completions",
    "P10",
    sql=with_(_MARKED)
    + f"""SELECT doc_id, CASE WHEN {_HAS_MARKER} OR length({_trim('output')}) < 5 THEN '    pass'
  ELSE {_reindent('output')} END AS completion FROM marked""",
)
def sanitized_completions(t):
    return _marked(t).select(
        "doc_id", text.sanitize_completion(F.col("output")).alias("completion")
    )


@query(
    "sanitized_completions_flat",
    "P10",
    sql=with_(_MARKED)
    + f"""SELECT doc_id, CASE WHEN {_HAS_MARKER} OR length({_trim('output')}) < 5 THEN '    pass'
  ELSE {_join(f"list_transform({_lines(_trim('output'))}, lambda l: CASE WHEN {_trim('l')} = '' THEN l ELSE '    ' || {_trim('l', 'ltrim')} END)")}
  END AS completion FROM marked""",
)
def sanitized_completions_flat(t):
    return _marked(t).select(
        "doc_id", text.sanitize_completion(F.col("output"), compat=True).alias("completion")
    )


@query(
    "success_rate",
    "P11",
    sql=with_(_MARKED)
    + f"""SELECT source, count(*) AS total, count(*) FILTER (length({_trim('output')}) >= 10) AS successes
FROM marked GROUP BY 1""",
)
def success_rate(t):
    return (
        _marked(t)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(text.long_enough(F.col("output"))).alias("successes"),
        )
    )


_NUMBERS = """numbers AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS VARCHAR) || ',' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0')
    WHEN 2 THEN l_linenumber || '.5%' WHEN 3 THEN '<not' ELSE CAST(l_partkey AS VARCHAR) END AS word FROM lineitem)"""


def _number_words(t):
    n = F.col("l_linenumber")
    word = (
        F.when(
            n == 1,
            F.concat(
                F.col("l_suppkey").cast("string"),
                F.lit(","),
                F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
            ),
        )
        .when(n == 2, F.concat(n.cast("string"), F.lit(".5%")))
        .when(n == 3, F.lit("<not"))
        .otherwise(F.col("l_partkey").cast("string"))
    )
    return t.lineitem.withColumn("word", word)


@query(
    "clean_numbers",
    "I11",
    sql=with_(_NUMBERS)
    + """SELECT word, TRY_CAST(rtrim(replace(word, ',', ''), '%') AS DOUBLE) AS number, count(*) AS words
FROM numbers GROUP BY 1, 2""",
)
def clean_numbers(t):
    words = _number_words(t).select("word", numbers.clean_number(F.col("word")).alias("number"))
    return words.groupBy("word", "number").agg(F.count(F.lit(1)).alias("words"))


@query(
    "first_numbers",
    "I12",
    sql=with_(_NUMBERS)
    + """SELECT line, TRY_CAST(regexp_extract(line, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS number, count(*) AS lines
FROM (SELECT 'avg = ' || word || ' usecs ' || l_linenumber AS line FROM numbers) n GROUP BY 1, 2""",
)
def first_numbers(t):
    line = F.concat(F.lit("avg = "), "word", F.lit(" usecs "), F.col("l_linenumber").cast("string"))
    lines = _number_words(t).select(line.alias("line"))
    return (
        lines.select("line", numbers.first_number(F.col("line")).alias("number"))
        .groupBy("line", "number")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "bucket_midpoints",
    "I13",
    sql="""SELECT bucket, (lo + hi) / 2.0::DOUBLE AS midpoint, count(*) AS buckets FROM (
  SELECT CAST(floor(l_quantity) AS BIGINT) AS lo,
    CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey END + CAST(floor(l_quantity) AS BIGINT) AS hi,
    CASE WHEN l_linenumber = 1 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
      WHEN l_linenumber = 2 THEN CAST(floor(l_quantity) AS BIGINT) || '-' || (l_partkey + CAST(floor(l_quantity) AS BIGINT))
      ELSE '  ' || CAST(floor(l_quantity) AS BIGINT) || ' -> ' || (l_partkey + CAST(floor(l_quantity) AS BIGINT)) END AS bucket
  FROM lineitem) b GROUP BY 1, 2""",
)
def bucket_midpoints(t):
    low = F.floor("l_quantity").cast("bigint")
    high = (F.col("l_partkey") + low).cast("string")
    bucket = (
        F.when(F.col("l_linenumber") == 1, low.cast("string"))
        .when(F.col("l_linenumber") == 2, F.concat(low.cast("string"), F.lit("-"), high))
        .otherwise(F.concat(F.lit("  "), low.cast("string"), F.lit(" -> "), high))
    )
    rows = t.lineitem.select(bucket.alias("bucket"))
    return (
        rows.select("bucket", numbers.bucket_midpoint(F.col("bucket")).alias("midpoint"))
        .groupBy("bucket", "midpoint")
        .agg(F.count(F.lit(1)).alias("buckets"))
    )


@query(
    "tokens",
    "I14",
    sql=f"""SELECT doc_id, len(words) AS words, words[1] AS first_word, words[2] AS second_word,
  array_to_string(words[3:], ' ') AS annotation
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM documents) d""",
)
def tokens(t):
    words = t.documents.select("doc_id", numbers.tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("bigint").alias("words"),
        F.get("w", F.lit(0)).alias("first_word"),
        F.get("w", F.lit(1)).alias("second_word"),
        numbers.rest_of(F.col("w"), 3).alias("annotation"),
    )


@query(
    "epoch_and_iso",
    "I15",
    sql="""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp,
  epoch_us(ts) / 1000000.0::DOUBLE AS epoch_s, floor(epoch(ts)) AS parsed_s FROM events""",
)
def epoch_and_iso(t):
    seconds = epoch_seconds("ts")
    # Rendered from date parts of the zoneless column, so any session zone gives the same text.
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select(
        "event_id",
        iso.alias("iso"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"),
        present.to_epoch(present.from_epoch(seconds)).alias("epoch_s"),
        present.to_epoch(present.parse_iso_utc(iso)).alias("parsed_s"),
    )


@query(
    "human_numbers",
    "I17",
    sql="""SELECT o_orderkey, CASE WHEN x >= 1000 THEN printf('%.1fK', x / 1000) WHEN x >= 1 THEN printf('%.2f', x)
  ELSE printf('%.3f', x) END || ' ms' AS text
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 1000
   WHEN 2 THEN o_totalprice / 1000000 ELSE floor(o_totalprice) / 64 END AS x FROM orders) o""",
)
def human_numbers(t):
    price, kind = F.col("o_totalprice"), F.col("o_orderkey") % 4
    x = (
        F.when(kind == 0, price)
        .when(kind == 1, price / 1000)
        .when(kind == 2, price / 1000000)
        .otherwise(F.floor(price).cast("double") / 64)
    )
    return t.orders.select("o_orderkey", present.human_number(x, " ms").alias("text"))


_CHANGE = """CASE WHEN b = 0 THEN 'N/A' WHEN up THEN (CASE WHEN c > 0 THEN '+' ELSE '' END) || printf('%.1f%%', c)
  ELSE (CASE WHEN c > 0 THEN '-' ELSE '+' END) || printf('%.1f%%', abs(c)) END"""


@query(
    "improvements",
    "I18",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b, a, up, CASE WHEN b <> 0 THEN c END AS change_percent, {_CHANGE} AS improvement
FROM (SELECT *, (a - b) / b * 100.0::DOUBLE AS c FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS b,
  CASE WHEN l_linenumber = 6 THEN l_quantity ELSE l_tax * 100 + l_linenumber END AS a, l_returnflag = 'R' AS up FROM lineitem) x) y""",
)
def improvements(t):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")).alias("b"),
        F.when(F.col("l_linenumber") == 6, F.col("l_quantity"))
        .otherwise(F.col("l_tax") * 100 + F.col("l_linenumber"))
        .alias("a"),
        (F.col("l_returnflag") == "R").alias("up"),
    )
    b, a = F.col("b"), F.col("a")
    return rows.withColumns(
        {
            "change_percent": present.change_percent(b, a),
            "improvement": present.improvement(b, a, F.col("up")),
        }
    )


@query(
    "progress_bars",
    "I19",
    sql="""SELECT o_orderkey, CASE WHEN m = 0 THEN '[' || repeat('░', 15) || ']' ELSE '[' || repeat('█', f) || repeat('░', 15 - f)
  || '] ' || printf('%.1f%%', v) END AS bar
FROM (SELECT *, CAST(floor(least(CASE WHEN m = 0 THEN 0 ELSE v / m END, 1.0) * 15) AS INT) AS f FROM (SELECT o_orderkey, o_totalprice / 1000 AS v,
   CAST(o_orderkey % 5 * 100 AS DOUBLE) AS m FROM orders) o) p""",
)
def progress_bars(t):
    most = (F.col("o_orderkey") % 5 * 100).cast("double")
    return t.orders.select(
        "o_orderkey", present.progress_bar(F.col("o_totalprice") / 1000, most, 15).alias("bar")
    )


@query(
    "size_texts",
    "I21",
    sql="""SELECT o_orderkey, CASE WHEN g >= 1024 THEN printf('%.2fTB', g / 1024) ELSE printf('%.2fGB', g) END AS size
FROM (SELECT o_orderkey, o_totalprice / 128 AS g FROM orders) o""",
)
def size_texts(t):
    return t.orders.select(
        "o_orderkey", present.size_text(F.col("o_totalprice") / 128).alias("size")
    )


@query(
    "json_fields",
    "I22",
    sql="""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line
FROM events""",
)
def json_fields(t):
    return t.events.select(
        "event_id",
        F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.to_json(F.struct("event_id", "event_type")).alias("line"),
    )


@query(
    "json_variants",
    "I22",
    sql="SELECT CAST(props->>'k' AS BIGINT) % 10 AS k, count(*) AS events FROM events GROUP BY 1",
)
def json_variants(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "reflection_ids",
    "I23",
    sql="""SELECT conv_id, turn, conv_id || '::reflection-' || turn AS composite, CAST(conv_id AS VARCHAR) AS base,
  CAST(turn AS INT) AS attempt FROM conversations""",
)
def reflection_ids(t):
    ids = t.conversations.select(
        "conv_id",
        "turn",
        present.reflection_id(F.col("conv_id").cast("string"), F.col("turn")).alias("composite"),
    )
    base, attempt = present.reflection_parts(F.col("composite"))
    return ids.withColumns({"base": base, "attempt": attempt})
