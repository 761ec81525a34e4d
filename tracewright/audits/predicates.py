"""Scalar functions and predicates over audit rows; all are column expressions inside code generation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.audits.metrics import tally
from tracewright.audits.registry import FOUND, RUNS, WORK, audit, found, runs, work
from tracewright.functions import scalars as S
from tracewright.operators.graph import cut
from tracewright.sources.tables import table

# Languages and their extensions, skipped folders, folders of tests, stop words, format conversions, CWE names.
EXTENSIONS = {"python": ["py"], "node": ["js", "mjs", "cjs", "jsx", "ts", "tsx"], "java": ["java", "kt"], "c": ["c", "h", "l", "y"]}
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "target", ".mypy_cache", ".pytest_cache", ".tox", "vendor", "third_party", "docs", "examples", "migrations"]
TEST_PARTS = ["test", "tests", "__tests__", "spec", "specs"]
STOP_WORDS = ["and", "else", "for", "if", "in", "is", "not", "of", "or", "return", "the", "to"]
WIDTHS = {"d": 11, "i": 11, "u": 10, "x": 8, "X": 8, "c": 1}
CWE = {"buffer overflow": "CWE-787", "out-of-bounds read": "CWE-125", "integer overflow": "CWE-190", "use after free": "CWE-416", "format string": "CWE-134"}
REVERSED = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "==": "==", "!=": "!="}


def chosen(value: Column, pairs: dict, other: Column | None = None) -> Column:
    """value looked up in a constant table."""
    out = F.lit(None) if other is None else other
    for k, v in reversed(pairs.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def case(value: str, pairs: dict, other: str = "NULL") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


def path_columns(path: str) -> tuple[Column, Column, Column]:
    """Of a path: its language by the last extension (null: none), whether a folder or the file itself has a skipped name,
    and whether one has a test's, in any case. A name that only begins with a dot has no extension."""
    parts = F.split(path, "/")
    extension = F.lower(F.regexp_extract(F.element_at(parts, -1), "^[.]*[^.].*[.]([^.]+)$", 1))
    language = F.coalesce(*[F.when(extension.isin(e), F.lit(n)) for n, e in EXTENSIONS.items()])
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED]))
    is_test = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in TEST_PARTS]))
    return language, skipped, is_test


# The names that a part's file is made of, by its size and key; they cover the fixed values and others.
_SUFFIXES = ["py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "java", "kt", "c", "h", "l", "Y", "txt"]
_FOLDERS = ["src", "Node_modules", *SKIPPED, *TEST_PARTS, "Tests", "testing"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@audit(
    "P1 S2",
    f"""WITH p AS (SELECT p_partkey, ({_LIST(_FOLDERS)})[1 + p_partkey % {len(_FOLDERS)}] || '/' || ({_LIST(_FOLDERS)})[1 + (p_partkey // {len(_FOLDERS)}) % {len(_FOLDERS)}] || '/f.' || p_partkey || '.' || ({_LIST(_SUFFIXES)})[1 + p_size % {len(_SUFFIXES)}] AS path FROM part), x AS (SELECT *, string_split(path, '/') AS parts, lower(string_split(path, '.')[-1]) AS e FROM p)
SELECT p_partkey, CASE e WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'kt' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'l' THEN 'c' WHEN 'y' THEN 'c' WHEN 'txt' THEN NULL ELSE 'node' END AS language, list_has_any(parts, {_LIST(SKIPPED)}) AS skipped, list_has_any(list_transform(parts, lambda q: lower(q)), {_LIST(TEST_PARTS)}) AS is_test FROM x""",
)
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    """A path's language by extension, whether a folder of it is skipped, and whether it is a test's."""
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (1 + at % len(names)).cast("int"))
    key = F.col("p_partkey")
    path = F.concat(pick(_FOLDERS, key), F.lit("/"), pick(_FOLDERS, F.floor(key / len(_FOLDERS))), F.lit("/f."), key.cast("string"), F.lit("."), pick(_SUFFIXES, F.col("p_size")))
    language, skipped, is_test = path_columns("path")
    return table(spark, d, "part").select("p_partkey", path.alias("path")).select("p_partkey", language.alias("language"), skipped.alias("skipped"), is_test.alias("is_test"))


@audit(
    "P2 P3 P4 P5",
    f"""WITH {FOUND}, c AS (SELECT *, CASE WHEN target_id % 5 = 0 THEN 'copy' WHEN target_id % 5 = 1 THEN 'format' WHEN target_id % 5 = 2 THEN 'pool_alloc' WHEN target_id % 5 = 3 THEN 'read' ELSE 'other' END AS callee FROM found),
k AS (SELECT *, CASE WHEN callee = 'copy' THEN 'memory' WHEN callee = 'format' THEN 'format' WHEN ends_with(callee, 'alloc') THEN 'allocation' WHEN callee = 'read' THEN 'source' ELSE 'none' END AS category FROM c),
r AS (SELECT *, CASE category WHEN 'memory' THEN 5 WHEN 'format' THEN 4 WHEN 'allocation' THEN CASE WHEN session_index = 1 THEN 2 ELSE 4 END WHEN 'source' THEN 2 ELSE 1 END AS risk FROM k)
SELECT run_id, session_index, category || CASE WHEN category = 'allocation' AND session_index = 1 THEN '_guarded' ELSE '' END AS category, risk::BIGINT AS risk, CASE category WHEN 'source' THEN 'source' WHEN 'none' THEN 'call' ELSE 'sink' END AS role, category NOT IN ('source', 'none') AND risk >= 4 AS critical, category = 'source' OR hunter = 'R' OR session_index = 7 AS entrypoint FROM r""",
)
def sink_classification(spark: SparkSession, d: str) -> DataFrame:
    """Callee to category and risk, allocators by their suffix; a reject guard before an allocation lowers its risk from
    4 to 2; sinks of risk 4 and more are critical; entry points have a source, are exported or are a root."""
    callee = chosen(F.col("target_id") % 5, {0: "copy", 1: "format", 2: "pool_alloc", 3: "read"}, F.lit("other"))
    c = found(spark, d).withColumn("callee", callee)
    category = F.when(F.col("callee") == "copy", "memory").when(F.col("callee") == "format", "format").when(F.col("callee").endswith("alloc"), "allocation").when(F.col("callee") == "read", "source").otherwise("none")
    guarded = (F.col("k") == "allocation") & (F.col("session_index") == 1)
    risk = F.when(guarded, 2).otherwise(chosen(F.col("k"), {"memory": 5, "format": 4, "allocation": 4, "source": 2}, F.lit(1)))
    role = F.when(F.col("k") == "source", "source").when(F.col("k") == "none", "call").otherwise("sink")
    c = c.withColumn("k", category).withColumns({"risk": risk.cast("long"), "role": role})
    entry = (F.col("k") == "source") | (F.col("hunter") == "R") | (F.col("session_index") == 7)
    return c.select("run_id", "session_index", F.when(guarded, F.concat("k", F.lit("_guarded"))).otherwise(F.col("k")).alias("category"), "risk", "role", ((F.col("role") == "sink") & (F.col("risk") >= 4)).alias("critical"), entry.alias("entrypoint"))


_LITERAL = "CASE WHEN p_size % 4 = 0 THEN 'name=%s' WHEN p_size % 4 = 1 THEN 'id=%d size=%5u' WHEN p_size % 4 = 2 THEN '%x:%c!' ELSE p_brand END"


@audit(
    "F8 P6 D5",
    f"""WITH l AS (SELECT p_partkey, p_size, {_LITERAL} AS literal, p_size % 9 <> 0 AS is_literal FROM part), c AS (SELECT *, regexp_extract_all(literal, '%[0-9]*[a-zA-Z]') AS conversions FROM l)
SELECT p_partkey, NOT is_literal AS dynamic, len(conversions)::BIGINT AS n, list_contains(list_transform(conversions, lambda x: right(x, 1)), 's') AS unbounded,
  CASE WHEN is_literal AND NOT list_contains(list_transform(conversions, lambda x: right(x, 1)), 's') THEN length(regexp_replace(literal, '%[0-9]*[a-zA-Z]', '', 'g')) + coalesce(list_sum(list_transform(conversions, lambda x: greatest(coalesce(try_cast(regexp_extract(x, '[0-9]+') AS INT), 0), {case("right(x, 1)", WIDTHS, "0")}))), 0) END::BIGINT AS maximum,
  CASE WHEN NOT is_literal OR list_contains(list_transform(conversions, lambda x: right(x, 1)), 's') THEN 'unknown' WHEN length(regexp_replace(literal, '%[0-9]*[a-zA-Z]', '', 'g')) + coalesce(list_sum(list_transform(conversions, lambda x: greatest(coalesce(try_cast(regexp_extract(x, '[0-9]+') AS INT), 0), {case("right(x, 1)", WIDTHS, "0")}))), 0) < p_size THEN 'dominates' ELSE 'absent' END AS guard FROM c""",
)
def format_width(spark: SparkSession, d: str) -> DataFrame:
    """The most characters a format can write: literal ones, and each conversion's width or its type's; null if unbounded
    or if the format isn't a literal. The guard dominates if the destination (p_size) holds that and an end."""
    size = F.col("p_size")
    literal = F.when(size % 4 == 0, "name=%s").when(size % 4 == 1, "id=%d size=%5u").when(size % 4 == 2, "%x:%c!").otherwise(F.col("p_brand"))
    p = table(spark, d, "part").select("p_partkey", "p_size", literal.alias("l"), (size % 9 == 0).alias("dynamic"))
    pattern = "%[0-9]*[a-zA-Z]"
    p = p.withColumn("c", F.regexp_extract_all("l", F.lit(f"({pattern})"), F.lit(1)))
    width = lambda x: F.greatest(F.coalesce(F.regexp_extract(x, "[0-9]+", 0).try_cast("int"), F.lit(0)), chosen(F.right(x, F.lit(1)), WIDTHS, F.lit(0)))
    fixed = F.length(F.regexp_replace("l", pattern, ""))
    total = fixed + F.aggregate(F.transform("c", width), F.lit(0), lambda a, x: a + x)
    unbounded = F.exists("c", lambda x: x.endswith("s"))
    p = p.withColumn("unbounded", unbounded).withColumn("maximum", F.when(~F.col("dynamic") & ~F.col("unbounded"), total.cast("long")))
    guard = F.when(F.col("maximum").isNull(), "unknown").when(F.col("maximum") < F.col("p_size"), "dominates").otherwise("absent")
    return p.select("p_partkey", "dynamic", F.size("c").cast("long").alias("n"), "unbounded", "maximum", guard.alias("guard"))


@audit(
    "F5 F10",
    f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*'), lambda x: NOT list_contains({STOP_WORDS!r}, x))) AS w FROM conversations)
SELECT conv_id, turn, len(w)::BIGINT AS n, array_to_string(list_sort(list_filter(w, lambda x: length(x) >= 9)), ',') AS long_tokens, concat_ws(',', CASE WHEN list_has_any(w, ['code', 'function', 'python']) THEN 'code' END, CASE WHEN list_has_any(w, ['error', 'bug', 'fail']) THEN 'fault' END, CASE WHEN list_has_any(w, ['key', 'secret', 'token']) THEN 'secret' END) AS tags FROM t""",
)
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers without stop words, and the semantic tags that they or their aliases stand for."""
    low = F.lower(F.coalesce("text", F.lit("")))
    w = F.array_distinct(F.array_except(F.regexp_extract_all(low, F.lit("([a-z_][a-z0-9_]*)"), F.lit(1)), F.array(*[F.lit(x) for x in STOP_WORDS])))
    t = table(spark, d, "conversations").select("conv_id", "turn", w.alias("w"))
    any_of = lambda *x: F.arrays_overlap("w", F.array(*[F.lit(v) for v in x]))
    tags = S.reasons(("code", any_of("code", "function", "python")), ("fault", any_of("error", "bug", "fail")), ("secret", any_of("key", "secret", "token")))
    return t.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort(F.filter("w", lambda x: F.length(x) >= 9)), ",").alias("long_tokens"), tags.alias("tags"))


@audit(
    "F6 F7",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, '(size_t)(char *) buf' || l_partkey || '[i + ' || l_linenumber || '].len' AS argument, CASE l_linenumber % 4 WHEN 0 THEN '>' WHEN 1 THEN '<=' WHEN 2 THEN '==' ELSE '<' END AS operator FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, regexp_extract(regexp_replace(argument, '\\([a-z_0-9 ]+[*]?\\) ?', '', 'g'), '^[A-Za-z_][A-Za-z0-9_]*') AS root, regexp_replace(regexp_replace(argument, '\\bbuf[0-9]+\\b', 'dest', 'g'), '\\bi\\b', 'index', 'g') AS substituted, {case("operator", REVERSED)} AS reversed FROM a""",
)
def argument_roots(spark: SparkSession, d: str) -> DataFrame:
    """An argument's root without casts, its whole-word substitution (longest names first), and the reversed comparison."""
    n = F.col("l_linenumber")
    argument = F.concat(F.lit("(size_t)(char *) buf"), F.col("l_partkey").cast("string"), F.lit("[i + "), n.cast("string"), F.lit("].len"))
    operator = chosen(n % 4, {0: ">", 1: "<=", 2: "=="}, F.lit("<"))
    root = F.regexp_extract(F.regexp_replace(argument, "\\([a-z_0-9 ]+[*]?\\) ?", ""), "^[A-Za-z_][A-Za-z0-9_]*", 0)
    substituted = F.regexp_replace(F.regexp_replace(argument, "\\bbuf[0-9]+\\b", "dest"), "\\bi\\b", "index")
    return table(spark, d, "lineitem").select("l_orderkey", n.cast("long"), root.alias("root"), substituted.alias("substituted"), chosen(operator, REVERSED).alias("reversed"))


@audit(
    "F9 F12",
    f"""WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'unsigned int *' WHEN 1 THEN 'int64_t' WHEN 2 THEN 'uint8_t' WHEN 3 THEN 'char **' ELSE p_type END AS type, CASE p_size % 7 WHEN 0 THEN ' Buffer Overflow' WHEN 1 THEN 'cwe-0416' WHEN 2 THEN 'CWE-999' WHEN 3 THEN '134' ELSE 'integer  overflow' END AS weakness FROM part),
c AS (SELECT *, lower(regexp_replace(trim(weakness), '\\s+', ' ', 'g')) AS w FROM t), n AS (SELECT *, CASE WHEN regexp_matches(w, '^(cwe-)?0*[0-9]+$') THEN 'CWE-' || regexp_extract(w, '0*([0-9]+)$', 1) ELSE {case("w", CWE)} END AS cwe FROM c)
SELECT p_partkey, CASE WHEN contains(type, '*') THEN 'pointer' WHEN regexp_matches(type, '^(unsigned|u?int[0-9]*_t|int|char)') THEN CASE WHEN type LIKE 'u%' THEN 'unsigned' ELSE 'signed' END || CASE WHEN contains(type, '64') THEN '64' WHEN contains(type, '8') THEN '8' ELSE '32' END ELSE 'other' END AS class, CASE WHEN cwe IN ('CWE-787', 'CWE-125', 'CWE-190', 'CWE-416', 'CWE-134') THEN cwe END AS cwe, coalesce(cwe NOT IN ('CWE-787', 'CWE-125', 'CWE-190', 'CWE-416', 'CWE-134'), true) AS refused FROM n""",
)
def type_and_weakness(spark: SparkSession, d: str) -> DataFrame:
    """Sign, pointer and width class of a type; a weakness by alias or number, refused outside the allow-list."""
    kind = chosen(F.col("p_size") % 5, {0: "unsigned int *", 1: "int64_t", 2: "uint8_t", 3: "char **"}, F.col("p_type"))
    weakness = chosen(F.col("p_size") % 7, {0: " Buffer Overflow", 1: "cwe-0416", 2: "CWE-999", 3: "134"}, F.lit("integer  overflow"))
    t = table(spark, d, "part").select("p_partkey", kind.alias("t"), F.lower(F.regexp_replace(F.trim(weakness), "\\s+", " ")).alias("w"))
    width = F.when(F.col("t").contains("64"), "64").when(F.col("t").contains("8"), "8").otherwise("32")
    scalar = F.concat(F.when(F.col("t").startswith("u"), "unsigned").otherwise("signed"), width)
    group = F.when(F.col("t").contains("*"), "pointer").when(F.col("t").rlike("^(unsigned|u?int[0-9]*_t|int|char)"), scalar).otherwise("other")
    named = F.when(F.col("w").rlike("^(cwe-)?0*[0-9]+$"), F.concat(F.lit("CWE-"), F.regexp_extract("w", "0*([0-9]+)$", 1))).otherwise(chosen(F.col("w"), CWE))
    t = t.withColumn("c", named)
    allowed = F.col("c").isin(sorted(CWE.values()))
    return t.select("p_partkey", group.alias("class"), F.when(allowed, F.col("c")).alias("cwe"), F.coalesce(~allowed, F.lit(True)).alias("refused"))


@audit(
    "F13 S12",
    """SELECT event_id, regexp_extract('noise ' || props || ' [1, 2] ' || CASE WHEN event_type = 'error' THEN 'tail' ELSE '{"z": 1} tail' END, '\\{.*\\}') AS object, regexp_extract('noise ' || props || ' [1, 2] tail', '\\[.*\\]') AS list, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_spans(spark: SparkSession, d: str) -> DataFrame:
    """The greedy span of the first object and of the first list in a text, and a field of a parsed one."""
    tail = F.when(F.col("event_type") == "error", "tail").otherwise('{"z": 1} tail')
    text = F.concat(F.lit("noise "), F.col("props"), F.lit(" [1, 2] "))
    return table(spark, d, "events").select("event_id", F.regexp_extract(F.concat(text, tail), "\\{.*\\}", 0).alias("object"), F.regexp_extract(text, "\\[.*\\]", 0).alias("list"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def truncate_utf8(text: Column, most: int, marker: str = "...") -> Column:
    """The text within most bytes, marker included, never cut inside a character; text that fits as it is."""
    room = most - len(marker.encode())
    raw = text.cast("binary")
    # A continuation byte right after the cut means that the cut is inside a character of at most four bytes.
    inside = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    cut = F.when(~inside(room), room).when(~inside(room - 1), room - 1).when(~inside(room - 2), room - 2).otherwise(room - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substr(raw, F.lit(1), cut).cast("string"), F.lit(marker)))


_INSIDE = lambda at: f"substr(hex(t), {2 * at + 1}, 2) BETWEEN '80' AND 'BF'"


@audit(
    "F14",
    f"""SELECT doc_id, CASE WHEN strlen(t) <= 60 THEN t ELSE decode(from_hex(substr(hex(t), 1, 2 * CASE WHEN NOT {_INSIDE(57)} THEN 57 WHEN NOT {_INSIDE(56)} THEN 56 WHEN NOT {_INSIDE(55)} THEN 55 ELSE 54 END))) || '...' END AS excerpt FROM (SELECT doc_id, substr(text, 1 + (doc_id % 5)::INT) AS t FROM documents)""",
)
def utf8_excerpts(spark: SparkSession, d: str) -> DataFrame:
    text = F.substr("text", (1 + F.col("doc_id") % 5).cast("int"))
    return table(spark, d, "documents").select("doc_id", truncate_utf8(text, 60).alias("excerpt"))


@audit(
    "F16 F17 D14",
    r"""WITH t AS (SELECT event_id, '#0 0x' || lpad(event_id::VARCHAR, 8, '0') || ' in parse_' || event_type || '+0x' || user_id || ' /src/' || event_type || '.c:' || (user_id % 40) || chr(10) || '#1 0xdeadbeef in malloc libc.so' || chr(10) || '#2 0x0badf00d in main /src/main.c:9' AS text FROM events),
l AS (SELECT event_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, 3)) AS i FROM t)
SELECT event_id, string_agg(regexp_extract(line, ' in ([A-Za-z_]+)', 1) || '@' || regexp_extract(line, '([a-z]+[.]c):', 1), ' < ' ORDER BY i) FILTER (NOT contains(line, 'libc')) AS frames, count(*) FILTER (contains(line, 'libc')) AS irrelevant, string_agg(regexp_replace(regexp_replace(line, '0x[0-9a-f]+', '0x?', 'g'), '[+]0x[?]', ''), '|' ORDER BY i) AS masked FROM l GROUP BY 1""",
)
def crash_frames(spark: SparkSession, d: str) -> DataFrame:
    """Stack frames with addresses masked and offsets removed, runtime frames left out, in order."""
    kind, user = F.col("event_type"), F.col("user_id")
    lines = F.array(
        F.concat(F.lit("#0 0x"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(" in parse_"), kind, F.lit("+0x"), user.cast("string"), F.lit(" /src/"), kind, F.lit(".c:"), (user % 40).cast("string")),
        F.lit("#1 0xdeadbeef in malloc libc.so"),
        F.lit("#2 0x0badf00d in main /src/main.c:9"),
    )
    frame = lambda x: F.concat(F.regexp_extract(x, " in ([A-Za-z_]+)", 1), F.lit("@"), F.regexp_extract(x, "([a-z]+[.]c):", 1))
    masked = lambda x: F.regexp_replace(F.regexp_replace(x, "0x[0-9a-f]+", "0x?"), "[+]0x[?]", "")
    e = table(spark, d, "events").select("event_id", lines.alias("l"))
    own = F.filter("l", lambda x: ~x.contains("libc"))
    return e.select("event_id", F.array_join(F.transform(own, frame), " < ").alias("frames"), (F.size("l") - F.size(own)).cast("long").alias("irrelevant"), F.array_join(F.transform("l", masked), "|").alias("masked"))


@audit(
    "F19 F20",
    r"""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderstatus WHEN 'F' THEN 'Z' WHEN 'O' THEN '+02:00' ELSE '' END AS stamp, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(stamp, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN strftime(o_orderdate - CASE WHEN stamp LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS utc, (86400 - 61 * (o_orderkey % 100))::BIGINT // 60 || 'm ' || (86400 - 61 * (o_orderkey % 100))::BIGINT % 60 || 's' AS elapsed FROM t""",
)
def aware_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps in UTC; null without a zone. Durations as minutes and seconds."""
    zone = chosen(F.col("o_orderstatus"), {"F": "Z", "O": "+02:00"}, F.lit(""))
    o = table(spark, d, "orders").withColumn("stamp", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    aware = F.col("stamp").rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
    utc = F.date_format(F.to_utc_timestamp(F.to_timestamp(F.when(aware, F.col("stamp"))), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    seconds = (86400 - 61 * (F.col("o_orderkey") % 100)).cast("long")
    return o.select("o_orderkey", utc.alias("utc"), F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")).alias("elapsed"))


@audit("F22", "SELECT o_orderkey, (('0x' || left(sha256('seed:' || o_orderpriority || ':' || o_orderkey), 16))::UBIGINT % 97)::BIGINT AS place FROM orders")
def deterministic_places(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", F.lit("seed"), "o_orderpriority", F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", S.deterministic_index(key, 97).alias("place"))


@audit(
    "F23 D11",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS c, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_partkey END AS step, 100000::BIGINT AS maximum FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, c * step AS required, CASE WHEN step IS NULL THEN 'unknown' WHEN c * step > maximum THEN 'infeasible' WHEN c * step * 10 > maximum * 9 THEN 'extreme' ELSE 'feasible' END AS feasibility FROM b""",
)
def bounds_feasibility(spark: SparkSession, d: str) -> DataFrame:
    """count times step against a maximum, in decimals so that the product can't wrap."""
    step = F.when(F.col("l_tax") <= 0.07, F.col("l_partkey"))
    required = F.col("l_quantity").cast("decimal(18,0)") * step.cast("decimal(18,0)")
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), required.alias("r"))
    rule = F.when(F.col("r").isNull(), "unknown").when(F.col("r") > 100000, "infeasible").when(F.col("r") * 10 > 900000, "extreme").otherwise("feasible")
    return b.select("l_orderkey", "l_linenumber", F.col("r").cast("long").alias("required"), rule.alias("feasibility"))


@audit(
    "F24 S6",
    """WITH s AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), x AS (SELECT l_suppkey, string_agg('p' || l_partkey, ', ' ORDER BY i) FILTER (i <= 8) || CASE WHEN max(n) > 8 THEN ' +' || (max(n) - 8) ELSE '' END AS symbols FROM s GROUP BY 1)
SELECT s_suppkey, s_name || ' (' || (floor(abs(s_acctbal))::BIGINT + 1) || ' loc): ' || coalesce(symbols, 'text only') AS summary FROM supplier LEFT JOIN x ON l_suppkey = s_suppkey""",
)
def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Path, lines, the first eight symbols and how many more; files without an index row stay, as text only."""
    symbols = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("x"))
    listed = F.array_join(F.transform(F.slice("x", 1, 8), lambda v: F.concat(F.lit("p"), v.cast("string"))), ", ")
    more = F.when(F.size("x") > 8, F.concat(F.lit(" +"), (F.size("x") - 8).cast("string"))).otherwise("")
    s = table(spark, d, "supplier").join(symbols, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    lines = (F.floor(F.abs("s_acctbal")).cast("long") + 1).cast("string")
    return s.select("s_suppkey", F.concat(F.col("s_name"), F.lit(" ("), lines, F.lit(" loc): "), F.coalesce(F.concat(listed, more), F.lit("text only"))).alias("summary"))


@audit(
    "F1 F3 F15 C6",
    r"""WITH n AS (SELECT page_id, regexp_replace(replace(lower(coalesce(url, '')), '\', '/'), '/+', '/', 'g') AS path, trim(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '_', 'g'), '_') AS name, url, length(html) AS n FROM pages)
SELECT page_id, path, name, CASE WHEN url IS NULL OR n IS NULL THEN 'unique_' || left(sha256(page_id::VARCHAR), 57) ELSE sha256(lower(url) || chr(0) || n) END AS fingerprint, sha256('{"name":"' || name || '","page":' || page_id || '}') AS canonical FROM n""",
)
def identities(spark: SparkSession, d: str) -> DataFrame:
    """Normalised paths and names, fingerprints with a fallback of the row's own, digests of canonical JSON (sorted keys)."""
    url = F.lower(F.coalesce("url", F.lit("")))
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.replace(url, F.lit("\\"), F.lit("/")), "/+", "/").alias("path"), S.slug(F.coalesce("url", F.lit(""))).alias("name"), F.length("html").alias("n"))
    canonical = F.to_json(F.struct(F.col("name").alias("name"), F.col("page_id").alias("page")))
    return p.select("page_id", "path", "name", S.fingerprint(F.col("page_id"), F.col("url"), F.col("n")).alias("fingerprint"), F.sha2(canonical, 256).alias("canonical"))


@audit(
    "P9 P10 P15 P17",
    f"""WITH {FOUND} SELECT run_id, session_index, validity = 'real' AND state <> 'raw' AND hunter <> 'R' AS supported, CASE WHEN list_contains([target_id % 10, 5], 5) AND target_match THEN 'focus' ELSE 'original' END AS narrowed, state = 'reportable' AND session_index > 4 OR state = 'reproduced' AND target_match AND session_index > 4 AS high_extension, validity = 'real' AND regexp_matches(hunter || state, '^[AN]rep') AS actual_target FROM found""",
)
def finding_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Supported obligations, focus narrowing (kept as it was if empty), high-risk extensions, claims on an actual target."""
    focus = F.array_intersect(F.array(F.col("target_id") % 10, F.lit(5).cast("long")), F.array(F.lit(5).cast("long")))
    high = (F.col("state") == "reportable") | (F.col("state") == "reproduced") & F.col("target_match")
    return found(spark, d).select(
        "run_id",
        "session_index",
        ((F.col("validity") == "real") & (F.col("state") != "raw") & (F.col("hunter") != "R")).alias("supported"),
        F.when((F.size(focus) > 0) & F.col("target_match"), "focus").otherwise("original").alias("narrowed"),
        (high & (F.col("session_index") > 4)).alias("high_extension"),
        ((F.col("validity") == "real") & F.concat("hunter", "state").rlike("^[AN]rep")).alias("actual_target"),
    )


@audit(
    "P16 P22 P24",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'not_accepted' END, CASE WHEN o_totalprice < 50000 THEN 'confidence' END, CASE WHEN o_orderpriority > '3' THEN 'open_request' END, CASE WHEN n IS NULL THEN 'no_evidence' END, CASE WHEN bad > 0 THEN 'contradiction' END, CASE WHEN n < 2 THEN 'uncited' END) AS failing,
  o_orderstatus = 'F' AND o_totalprice >= 50000 AND o_orderpriority <= '3' AND coalesce(n >= 2 AND bad = 0, false) AS reportable FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount > 0.09) AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def report_policy(spark: SparkSession, d: str) -> DataFrame:
    """A conjunction that names every reason that fails, not the first alone."""
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), tally(F.col("l_discount") > 0.09, "bad"))
    o = table(spark, d, "orders").join(e, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    failing = S.reasons(("not_accepted", F.col("o_orderstatus") != "F"), ("confidence", F.col("o_totalprice") < 50000), ("open_request", F.col("o_orderpriority") > "3"), ("no_evidence", F.col("n").isNull()), ("contradiction", F.col("bad") > 0), ("uncited", F.col("n") < 2))
    return o.select("o_orderkey", failing.alias("failing")).withColumn("reportable", F.col("failing") == "")


@audit(
    "P18 P19 P20",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'failed' WHEN value > 20 AND regexp_matches(props, '"k": [0-4]') THEN 'passed' ELSE 'failed' END AS oracle, CASE WHEN event_type = 'signup' THEN 'timeout' WHEN event_type = 'error' AND value > 100 THEN 'crash' WHEN event_type = 'error' THEN 'decode_error' WHEN value < 1 THEN 'empty' ELSE 'decoded' END AS execution,
  CASE WHEN event_type <> 'error' THEN 'none' WHEN user_id <= 16 THEN 'null_page' WHEN value > 150 THEN 'write' WHEN value > 60 THEN 'read' ELSE 'abort' END AS triage FROM events""",
)
def execution_classes(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules: oracle results (a timeout fails), execution classes, crash triage (an address in the null page first)."""
    kind, v = F.col("event_type"), F.col("value")
    oracle = F.when(kind == "signup", "failed").when((v > 20) & F.col("props").rlike('"k": [0-4]'), "passed").otherwise("failed")
    execution = F.when(kind == "signup", "timeout").when((kind == "error") & (v > 100), "crash").when(kind == "error", "decode_error").when(v < 1, "empty").otherwise("decoded")
    triage = F.when(kind != "error", "none").when(F.col("user_id") <= 16, "null_page").when(v > 150, "write").when(v > 60, "read").otherwise("abort")
    return table(spark, d, "events").select("event_id", oracle.alias("oracle"), execution.alias("execution"), triage.alias("triage"))


@audit(
    "P21 S28",
    f"""WITH {RUNS}, {FOUND}, f AS (SELECT run_id, count(*) AS planned, count(*) FILTER (state <> 'raw') AS done FROM found GROUP BY 1)
SELECT run_id, CASE WHEN outcome = 'invalid' THEN 'invalid' WHEN outcome = 'interrupted' THEN 'interrupted' WHEN planned IS NULL THEN 'missing' WHEN done < planned THEN 'budget_limited' ELSE 'complete' END AS outcome, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done FROM runs LEFT JOIN f USING (run_id)""",
)
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Invalid before interrupted before missing before budget-limited before complete; a failing run is a row, not an error."""
    f = found(spark, d).groupBy("run_id").agg(F.count("*").alias("planned"), tally(F.col("state") != "raw", "done"))
    r = runs(spark, d).join(f, "run_id", "left")
    outcome = F.when(F.col("outcome").isin("invalid", "interrupted"), F.col("outcome")).when(F.col("planned").isNull(), "missing").when(F.col("done") < F.col("planned"), "budget_limited").otherwise("complete")
    zero = F.lit(0).cast("long")
    return r.select("run_id", outcome.alias("outcome"), F.coalesce("planned", zero).alias("planned"), F.coalesce("done", zero).alias("done"))


@audit(
    "P23",
    f"""WITH {WORK}, g AS (SELECT component, family, count(*) AS n, min(attempt) AS lo, max(attempt) AS hi, count(DISTINCT attempt) AS k, count(DISTINCT status) AS triggers, count(*) FILTER (score < 3) AS gaps FROM work GROUP BY 1, 2)
SELECT component, family, concat_ws(',', CASE WHEN s_nationkey IS NULL THEN 'no_baseline' END, CASE WHEN lo <> 1 OR hi <> k THEN 'attempts_not_contiguous' END, CASE WHEN triggers > 1 THEN 'differing_trigger' END) AS reasons, gaps FROM g LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = family""",
)
def package_policy(spark: SparkSession, d: str) -> DataFrame:
    """Attempts against the baseline, contiguous numbers from 1, one trigger; gaps are listed apart."""
    g = work(spark, d).groupBy("component", "family").agg(F.min("attempt").alias("lo"), F.max("attempt").alias("hi"), F.countDistinct("attempt").alias("k"), F.countDistinct("status").alias("t"), tally(F.col("score") < 3, "gaps"))
    base = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("family"), F.lit(True).alias("b")).distinct()
    reasons = S.reasons(("no_baseline", F.col("b").isNull()), ("attempts_not_contiguous", (F.col("lo") != 1) | (F.col("hi") != F.col("k"))), ("differing_trigger", F.col("t") > 1))
    return g.join(base, "family", "left").select("component", "family", reasons.alias("reasons"), "gaps")


@audit(
    "P13 P12 P11 J41",
    f"""WITH {WORK} SELECT sha256(component || '|' || family || '|' || hunter || '|' || risk || '|' || required) AS semantic, count(*) AS items, min(work_id) AS first, count(DISTINCT campaign) AS campaigns, count(DISTINCT campaign) > 1 AS recurs FROM work GROUP BY 1""",
)
def semantic_projection(spark: SparkSession, d: str) -> DataFrame:
    """Work without its run's own ids, so that equal plans compare equal."""
    key = F.concat_ws("|", "component", F.col("family").cast("string"), "hunter", F.col("risk").cast("string"), F.col("required").cast("string"))
    out = work(spark, d).groupBy(F.sha2(key, 256).alias("semantic")).agg(F.count("*").alias("items"), F.min("work_id").alias("first"), F.countDistinct("campaign").alias("campaigns"))
    return out.withColumn("recurs", F.col("campaigns") > 1)


def _word_runs(df: DataFrame, words: str, most: str, lengths: list[int]) -> DataFrame:
    """df without words (arrays) but with _k and _run: the digest of each distinct run of _k words, for the lengths up to
    most (a column). Words are digested once a batch, runs from their words' digests."""
    kept = [c for c in df.columns if c != words]
    schema = StructType([*df.select(*kept).schema, StructField("_k", LongType()), StructField("_run", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(words)
            coded = column.flatten().dictionary_encode()
            each = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], dtype=np.uint64)
            digests = each[coded.indices.to_numpy()] if len(each) else each
            ends = np.cumsum(column.value_lengths().to_numpy())
            for k in lengths:
                n = max(0, len(digests) - k + 1)
                joined = np.zeros(n, dtype=np.uint64)
                for i in range(k):
                    joined = (joined ^ digests[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                    joined ^= joined >> np.uint64(29)
                rows, found = [], []
                for row, (a, b, m) in enumerate(zip([0, *ends.tolist()], ends.tolist(), batch.column(most).to_pylist(), strict=False)):
                    if k <= m and b - a >= k:
                        found.append(np.unique(joined[a : b - k + 1]))
                        rows.append(np.full(len(found[-1]), row))
                if rows:
                    there = pa.array(np.concatenate(rows))
                    columns = [batch.column(c).take(there) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(there), k)), pa.array(np.concatenate(found).view(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)


def passages(protected: DataFrame, texts: DataFrame, n: int = 8) -> DataFrame:
    """item_id and doc_id of each protected passage (item_id, passage) that a text (doc_id, text) holds as whole words.

    Passages of at least n words are found by their rarest run of n words, shorter ones by all of theirs: runs are joined by
    equality with those of the texts that any passage's chosen run is among, and what meets is compared word by word. A run
    that many texts share therefore costs what its passages do. Case and white space between words don't matter. A passage
    without words is in no text; null texts and passages are skipped; repeated rows give one row. Texts are read once for
    runs, of all lengths that passages have, and what meets a passage's run is stored.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    items = protected.select("item_id", words("passage").alias("_w")).filter("size(_w) > 0").distinct()
    items = items.withColumn("_n", F.least(F.size("_w"), F.lit(n)))
    docs = texts.select("doc_id", words("text").alias("_d")).filter("size(_d) > 0")
    lengths = sorted(r[0] for r in items.select("_n").distinct().collect())  # n numbers at most
    if not lengths:
        return items.join(docs, F.lit(False)).select("item_id", "doc_id")
    mine = _word_runs(items.withColumn("_words", F.col("_w")), "_words", "_n", lengths).filter("_k = _n").drop("_n")
    there = _word_runs(docs.withColumn("_n", F.lit(n)), "_d", "_n", lengths).drop("_n")
    there = cut(there.join(mine.select("_k", "_run").distinct(), ["_k", "_run"], "left_semi").select("doc_id", "_k", "_run"))
    counts = there.groupBy("_k", "_run").agg(F.count("*").alias("_c"))
    rarest = F.min(F.struct(F.col("_c").alias("c"), F.col("_run").alias("run"), F.col("_k").alias("k")))
    # A run that no text holds leaves its passage out.
    chosen = mine.join(counts, ["_k", "_run"], "left").groupBy("item_id", "_w").agg(rarest.alias("_x"), F.count_if(F.col("_c").isNull()).alias("_no"))
    chosen = chosen.filter("_no = 0").select("item_id", "_w", F.col("_x.run").alias("_run"), F.col("_x.k").alias("_k"))
    pairs = there.join(chosen, ["_k", "_run"]).select("item_id", "doc_id", F.array_join("_w", " ").alias("_p")).distinct()
    held = F.concat(F.lit(" "), F.array_join("_d", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("_p"), F.lit(" ")))
    return pairs.join(docs, "doc_id").filter(held).select("item_id", "doc_id").distinct()


@audit(
    "P27",
    r"""WITH b AS (SELECT DISTINCT item_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) || ' ' AS p FROM benchmark), d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT lower(left(sha256(item_id::VARCHAR), 8)) AS token, count(DISTINCT doc_id) AS leaks, min(doc_id) AS first FROM b JOIN d ON length(p) > 2 AND contains(t, p) GROUP BY item_id""",
)
def production_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Protected passages that a production text holds, whole and of any length, with the first text."""
    protected = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    p = passages(protected, table(spark, d, "documents").select("doc_id", "text"))
    out = p.groupBy("item_id").agg(F.count("*").alias("leaks"), F.min("doc_id").alias("first"))
    return out.select(F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 8).alias("token"), "leaks", "first")
