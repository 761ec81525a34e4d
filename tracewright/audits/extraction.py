"""Row generators over source text, exports, catalogues and byte layouts. Patterns run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.audits.metrics import ids, tally
from tracewright.audits.reports import text
from tracewright.audits.registry import audit
from tracewright.functions import scalars as S
from tracewright.operators import merging
from tracewright.sources.tables import table

_SOURCE = """src AS (SELECT p_partkey AS file, '#include "' || p_brand || '.h"' || chr(10) || '#define MAX_' || p_size || ' \\' || chr(10) || '  (' || p_size * 4 || ')' || chr(10) || 'int parse_' || p_partkey || '(char *buf, size_t len) {' || chr(10) || '  char *p = malloc(' || p_size || ' * len);' || chr(10) || '  if (len > ' || p_size * 8 || ') return -1;' || chr(10) || '  p[' || (p_size % 13) || '] = buf[' || (p_size % 9) || '];' || chr(10) || '  p += ' || (1 + p_size % 5) || ';' || chr(10) || '  sprintf(p, "%d", len);' || chr(10) || '}' AS body FROM part)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """file, body: a small source file for each part."""
    s = F.col("p_size")
    lines = [
        text('#include "', F.col("p_brand"), '.h"'),
        text("#define MAX_", s, " \\"),
        text("  (", s * 4, ")"),
        text("int parse_", F.col("p_partkey"), "(char *buf, size_t len) {"),
        text("  char *p = malloc(", s, " * len);"),
        text("  if (len > ", s * 8, ") return -1;"),
        text("  p[", s % 13, "] = buf[", s % 9, "];"),
        text("  p += ", 1 + s % 5, ";"),
        F.lit('  sprintf(p, "%d", len);'),
        F.lit("}"),
    ]
    return table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.concat_ws("\n", *lines).alias("body"))


def numbered_lines(df: DataFrame) -> DataFrame:
    """file, line (from 1), code of every line of body."""
    return df.select("file", F.posexplode(F.split("body", "\n")).alias("line", "code")).withColumn("line", F.col("line") + 1)


_LINES = f"{_SOURCE}, lines AS (SELECT file, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line, unnest(string_split(body, chr(10))) AS code FROM src)"


@audit(
    "S9 S10 S5 S7 D10",
    f"""WITH {_SOURCE} SELECT file, regexp_extract(body, '#include "([^"]+)"', 1) AS include, regexp_extract(regexp_replace(body, '\\\\\\n *', '', 'g'), '#define ([A-Z_0-9]+) *\\((\\d+)\\)', 1) AS macro, regexp_extract(regexp_replace(body, '\\\\\\n *', '', 'g'), '#define ([A-Z_0-9]+) *\\((\\d+)\\)', 2)::BIGINT AS value, regexp_extract(body, '\\n(?:int|void|char) ([a-z_0-9]+)\\(', 1) AS symbol, len(regexp_extract_all(body, '\\n')) + 1 AS lines FROM src""",
)
def symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    """Includes, macros (continued lines joined first), exported symbols and line counts of a file."""
    flat = F.regexp_replace("body", "\\\\\\n *", "")
    macro = "#define ([A-Z_0-9]+) *\\((\\d+)\\)"
    return sources(spark, d).select("file", F.regexp_extract("body", '#include "([^"]+)"', 1).alias("include"), F.regexp_extract(flat, macro, 1).alias("macro"), F.regexp_extract(flat, macro, 2).cast("long").alias("value"), F.regexp_extract("body", "\\n(?:int|void|char) ([a-z_0-9]+)\\(", 1).alias("symbol"), F.size(F.split("body", "\n")).cast("long").alias("lines"))


@audit(
    "D1 D3 D4 D8 D9",
    rf"""WITH {_LINES}, k AS (SELECT *, CASE WHEN contains(code, 'malloc(') THEN 'allocation' WHEN regexp_matches(code, '^ *if \(') THEN 'guard' WHEN regexp_matches(code, '^ *[a-z]+\[[0-9]+\] =') THEN 'write' WHEN regexp_matches(code, '[a-z]+ \+= ') THEN 'advance' WHEN contains(code, 'sprintf(') THEN 'call' END AS kind FROM lines)
SELECT 'fact_' || left(sha256(file || ':' || line || ':' || kind), 16) AS fact_id, file, line::BIGINT AS line, kind, coalesce(nullif(regexp_extract(code, '([a-z]+)(?:\[| \+=| = malloc)', 1), ''), 'len') AS base, try_cast(nullif(regexp_extract(code, '([0-9]+)', 1), '') AS BIGINT) AS extent, contains(code, 'return -1') AS rejects FROM k WHERE kind IS NOT NULL""",
)
def source_facts(spark: SparkSession, d: str) -> DataFrame:
    """Allocation, guard, write, advance and call rows with their base and extent, identified by digest."""
    c = F.col("code")
    kind = F.when(c.contains("malloc("), "allocation").when(c.rlike("^ *if \\("), "guard").when(c.rlike("^ *[a-z]+\\[[0-9]+\\] ="), "write").when(c.rlike("[a-z]+ \\+= "), "advance").when(c.contains("sprintf("), "call")
    k = numbered_lines(sources(spark, d)).withColumn("kind", kind).filter("kind is not null")
    base = F.coalesce(F.nullif(F.regexp_extract("code", "([a-z]+)(?:\\[| \\+=| = malloc)", 1), F.lit("")), F.lit("len"))
    extent = F.nullif(F.regexp_extract("code", "([0-9]+)", 1), F.lit("")).try_cast("long")
    key = F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string"), "kind")
    return k.select(F.concat(F.lit("fact_"), F.substring(F.sha2(key, 256), 1, 16)).alias("fact_id"), "file", F.col("line").cast("long").alias("line"), "kind", base.alias("base"), extent.alias("extent"), c.contains("return -1").alias("rejects"))


@audit(
    "D7 D6",
    rf"""WITH {_SOURCE} SELECT file, coalesce(list_max(list_transform(regexp_extract_all(body, 'buf\[([0-9]+)\]', 1), lambda x: x::BIGINT)), -1) AS most_index, regexp_extract(body, 'len > ([0-9]+)', 1)::BIGINT AS bound, len(regexp_extract_all(body, 'p\[')) AS accesses FROM src""",
)
def pointer_reads(spark: SparkSession, d: str) -> DataFrame:
    """The greatest index read through a pointer parameter, and the bound that its length is checked against."""
    found = F.transform(F.regexp_extract_all("body", F.lit("buf\\[([0-9]+)\\]"), F.lit(1)), lambda x: x.cast("long"))
    return sources(spark, d).select("file", F.coalesce(F.array_max(found), F.lit(-1)).cast("long").alias("most_index"), F.regexp_extract("body", "len > ([0-9]+)", 1).cast("long").alias("bound"), F.size(F.regexp_extract_all("body", F.lit("(p\\[)"), F.lit(1))).cast("long").alias("accesses"))


@audit(
    "S18 S19 E2",
    """WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '{"entry":"0x' || lpad(l_partkey::VARCHAR, 6, '0') || '","size":' || l_suppkey || ',"name":"_f' || l_partkey || '"}' ELSE '{"addr":' || l_partkey || ',"len":' || l_suppkey || ',"sym":"f' || l_partkey || '"}' END AS row FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN contains(row, '"entry"') THEN 'a' ELSE 'b' END AS dialect, coalesce(regexp_extract(json_extract_string(row, '$.entry'), '0x0*([0-9]+)', 1), json_extract_string(row, '$.addr')) AS address, coalesce(json_extract_string(row, '$.size'), json_extract_string(row, '$.len'))::BIGINT AS size, ltrim(coalesce(json_extract_string(row, '$.name'), json_extract_string(row, '$.sym')), '_') AS name FROM e""",
)
def export_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Function rows of two export dialects in one form."""
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    a = text('{"entry":"0x', F.lpad(p, 6, "0"), '","size":', s, ',"name":"_f', p, '"}')
    b = text('{"addr":', p, ',"len":', s, ',"sym":"f', p, '"}')
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), F.when(F.col("l_returnflag") == "A", a).otherwise(b).alias("row"))
    get = lambda k: F.get_json_object("row", f"$.{k}")
    address = F.coalesce(F.regexp_extract(get("entry"), "0x0*([0-9]+)", 1), get("addr"))
    return e.select("l_orderkey", "l_linenumber", F.when(get("entry").isNotNull(), "a").otherwise("b").alias("dialect"), address.alias("address"), F.coalesce(get("size"), get("len")).cast("long").alias("size"), F.ltrim(F.coalesce(get("name"), get("sym")), F.lit("_")).alias("name"))


@audit(
    "S26 S29 S30 S25",
    r"""WITH t AS (SELECT s_suppkey, '[[detection]]' || chr(10) || 'id = "d' || s_suppkey || '"' || chr(10) || 'status = "' || CASE WHEN s_acctbal > 0 THEN 'must_detect' WHEN s_acctbal > -900 THEN 'known_gap' ELSE 'unknown' END || '"' || chr(10) || 'maximum_rank = ' || (s_suppkey % 12) || chr(10) || 'paths = ["a' || s_nationkey || '", "b"]' AS entry FROM supplier)
SELECT s_suppkey, regexp_extract(entry, '(?:^|\n)id = "([^"]*)"', 1) AS id, regexp_extract(entry, '\nstatus = "([^"]*)"', 1) AS status, regexp_extract(entry, '\nmaximum_rank = ([0-9]+)', 1)::BIGINT AS maximum_rank, array_to_string(regexp_extract_all(regexp_extract(entry, '\npaths = \[([^\]]*)\]', 1), '"([^"]*)"', 1), ',') AS paths, regexp_extract(entry, '\nstatus = "([^"]*)"', 1) IN ('must_detect', 'known_gap') AS valid, sha256(entry) AS digest FROM t""",
)
def registry_entries(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries (keys, numbers, lists of texts) with their digest; a status outside the closed set is invalid."""
    status = F.when(F.col("s_acctbal") > 0, "must_detect").when(F.col("s_acctbal") > -900, "known_gap").otherwise("unknown")
    entry = text("[[detection]]\nid = \"d", F.col("s_suppkey"), '"\nstatus = "', status, '"\nmaximum_rank = ', F.col("s_suppkey") % 12, '\npaths = ["a', F.col("s_nationkey"), '", "b"]')
    t = table(spark, d, "supplier").select("s_suppkey", entry.alias("e"))
    value = lambda p: F.regexp_extract("e", p, 1)
    listed = F.regexp_extract_all(value("\\npaths = \\[([^\\]]*)\\]"), F.lit('"([^"]*)"'), F.lit(1))
    return t.select("s_suppkey", value('(?:^|\\n)id = "([^"]*)"').alias("id"), value('\\nstatus = "([^"]*)"').alias("status"), value("\\nmaximum_rank = ([0-9]+)").cast("long").alias("maximum_rank"), F.array_join(listed, ",").alias("paths"), value('\\nstatus = "([^"]*)"').isin("must_detect", "known_gap").alias("valid"), F.sha2("e", 256).alias("digest"))


@audit(
    "S32 W5",
    r"""WITH h AS (SELECT o_orderkey, o_custkey, '@@ -' || (o_orderkey % 90) || ',3 +' || (o_orderkey % 90) || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',' || (o_orderkey % 7) END || ' @@' AS header FROM orders), r AS (SELECT o_custkey, regexp_extract(header, '\+([0-9]+)', 1)::BIGINT AS s, coalesce(try_cast(nullif(regexp_extract(header, '\+[0-9]+,([0-9]+)', 1), '') AS BIGINT), 1) AS n FROM h), x AS (SELECT o_custkey, s, s + n - 1 AS e FROM r WHERE n > 0),
m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 2) + 1 THEN 1 ELSE 0 END AS o FROM x), g AS (SELECT *, sum(o) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT o_custkey AS path, min(s) AS first, max(e) AS last FROM g GROUP BY o_custkey, k""",
)
def diff_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Changed line ranges from hunk headers (a missing count is one line, zero none), merged where they touch."""
    from tracewright.operators.aggregates import merged_ranges

    at = F.col("o_orderkey") % 90
    header = text("@@ -", at, ",3 +", at, F.when(F.col("o_orderstatus") == "F", "").otherwise(text(",", F.col("o_orderkey") % 7)), " @@")
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), header.alias("h"))
    n = F.coalesce(F.nullif(F.regexp_extract("h", "\\+[0-9]+,([0-9]+)", 1), F.lit("")).try_cast("long"), F.lit(1))
    r = h.select("path", F.regexp_extract("h", "\\+([0-9]+)", 1).cast("long").alias("first"), n.alias("n")).filter("n > 0")
    return merged_ranges(r.select("path", "first", (F.col("first") + F.col("n") - 1).alias("last")), ["path"], "first", "last")


@audit(
    "S33 A2",
    """SELECT p_partkey, round(p_retailprice, 2) AS input_price, round(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 10 END, 4) AS listed_cache_price, round(coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 10 END, p_retailprice / 4), 4) AS cache_read_price, round(p_retailprice * 5 / 4, 4) AS cache_write_price FROM part""",
)
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Prices of a catalogue; cache prices that it doesn't list are derived from the input price."""
    price = F.col("p_retailprice")
    listed = F.when(F.col("p_size") % 4 != 0, price / 10)
    return table(spark, d, "part").select("p_partkey", F.round(price, 2).alias("input_price"), F.round(listed, 4).alias("listed_cache_price"), F.round(F.coalesce(listed, price / 4), 4).alias("cache_read_price"), F.round(price * 5 / 4, 4).alias("cache_write_price"))


@audit(
    "S22 D15",
    """WITH f AS (SELECT s_nationkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'main' WHEN s_suppkey % 5 = 1 THEN 'symbols' ELSE 'sub' END AS role FROM supplier) SELECT s_nationkey AS family, string_agg(role || ':' || s_name, ',' ORDER BY CASE role WHEN 'main' THEN 0 WHEN 'sub' THEN 1 ELSE 2 END, s_name) AS members, count(*) FILTER (role = 'main') = 1 AS complete FROM f GROUP BY 1""",
)
def cache_families(spark: SparkSession, d: str) -> DataFrame:
    """Sibling files of a family by role, then name; a family needs exactly one main file."""
    k = F.col("s_suppkey") % 5
    role = F.when(k == 0, "main").when(k == 1, "symbols").otherwise("sub")
    rank = F.when(k == 0, 0).when(k == 1, 2).otherwise(1)
    f = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("family")).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("s_name").alias("n"), role.alias("role")))).alias("x"))
    return f.select("family", F.array_join(F.transform("x", lambda v: F.concat_ws(":", v["role"], v["n"])), ",").alias("members"), (F.size(F.filter("x", lambda v: v["r"] == 0)) == 1).alias("complete"))


@audit(
    "S23 S24",
    """SELECT user_id, event_id, event_type = 'error' AS signalled, sha256(props) AS digest, CASE WHEN event_type <> 'error' THEN 'skipped' WHEN json_extract(props, '$.k')::BIGINT % 9 = 0 THEN 'digest_mismatch' ELSE 'loaded' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY props, event_id) AS place FROM events""",
)
def crash_cases(spark: SparkSession, d: str) -> DataFrame:
    """Case records by name; only signalled runs with the right digest are loaded."""
    from tracewright.operators.ranking import ranked

    bad = F.get_json_object("props", "$.k").cast("long") % 9 == 0
    outcome = F.when(F.col("event_type") != "error", "skipped").when(bad, "digest_mismatch").otherwise("loaded")
    e = ranked(table(spark, d, "events"), ["user_id"], [F.col("props"), F.col("event_id")], "place")
    return e.select("user_id", "event_id", (F.col("event_type") == "error").alias("signalled"), F.sha2("props", 256).alias("digest"), outcome.alias("outcome"), "place")


@audit(
    "S31 S1",
    r"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1)) AS top_level, count(*) FILTER (regexp_matches(lower(url), '(readme|license|security)')) AS meta, sum(least(strlen(coalesce(html, '')), 20000))::BIGINT AS bytes FROM pages GROUP BY 1""",
)
def repository_meta(spark: SparkSession, d: str) -> DataFrame:
    """Top-level entries of a tree, known meta files, and bytes with a cap a file."""
    p = table(spark, d, "pages")
    size = F.least(F.octet_length(F.coalesce("html", F.lit(""))), F.lit(20000))
    return p.groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]*)", 1)).alias("top_level"), tally(F.lower("url").rlike("(readme|license|security)"), "meta"), F.sum(size).cast("long").alias("bytes"))


@audit(
    "D13 D18",
    """WITH b AS (SELECT vec_id, hex(encode(coalesce(label::VARCHAR, '') || ':' || vec_id)) AS h FROM embeddings) SELECT vec_id, (length(h) // 2)::BIGINT AS size, ('0x' || substr(h, 1, 2))::BIGINT AS tag, CASE WHEN length(h) >= 8 THEN ('0x' || substr(h, 5, 4))::BIGINT END AS length_field, CASE WHEN length(h) >= 8 THEN ('0x' || substr(h, 5, 4))::BIGINT > length(h) // 2 - 4 END AS exceeds FROM b""",
)
def byte_elements(spark: SparkSession, d: str) -> DataFrame:
    """Element rows of a byte layout: a tag byte at 0, a big-endian length at 2, and whether the length exceeds what is left."""
    h = F.hex(F.concat_ws(":", F.coalesce(F.col("label").cast("string"), F.lit("")), F.col("vec_id").cast("string")).cast("binary"))
    b = table(spark, d, "embeddings").select("vec_id", h.alias("h"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    size = F.floor(F.length("h") / 2).cast("long")
    field = F.when(F.length("h") >= 8, number(5, 4))
    return b.select("vec_id", size.alias("size"), number(1, 2).alias("tag"), field.alias("length_field"), (field > size - 4).alias("exceeds"))


# A chain of uses longer than three steps ends at priority 6, so the recursion counts no further and ends.
_SLICES = """i AS (SELECT l_suppkey AS fn, l_partkey % 30 AS block, (l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096 AS address, l_linenumber::BIGINT AS index, CASE WHEN l_returnflag <> 'N' THEN 'v' || (l_partkey % 97) END AS result, 'v' || (l_orderkey % 97) AS a, 'v' || (l_partkey * 3 % 97) AS b, CASE WHEN l_quantity > 49 THEN 0 WHEN l_quantity > 48 THEN 1 WHEN l_quantity > 47 THEN 2 END AS own FROM lineitem),
j AS (SELECT fn, result, arg_max(a, (address, index)) AS a, arg_max(b, (address, index)) AS b, max((address, index)) AS id FROM i WHERE result IS NOT NULL GROUP BY 1, 2),
need AS (SELECT fn, name, 1 AS hops FROM (SELECT fn, unnest([a, b]) AS name FROM i WHERE own IS NOT NULL) UNION SELECT need.fn, unnest([j.a, j.b]), least(hops + 1, 3) FROM need JOIN j ON j.fn = need.fn AND j.result = need.name),
h AS (SELECT need.fn, j.id, min(hops) AS hops FROM need JOIN j ON j.fn = need.fn AND j.result = need.name GROUP BY 1, 2),
p AS (SELECT i.*, coalesce(own, 3 + hops)::BIGINT AS priority FROM i LEFT JOIN h ON h.fn = i.fn AND h.id = (i.address, i.index)),
o AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY priority, address, index) AS place FROM p WHERE priority IS NOT NULL),
k AS (SELECT fn, block, min((priority, address)) AS best, string_agg(index::VARCHAR, ',' ORDER BY address, index) AS kept, count(*) AS n FROM o WHERE place <= 24 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY best, block) AS nth, count(*) OVER (PARTITION BY fn) AS m FROM k),
f AS (SELECT fn, block, count(*) AS full_count FROM i GROUP BY 1, 2), w AS (SELECT fn, count(*) AS n FROM o GROUP BY 1)"""


def instructions(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's lines as the instructions of a function: fn, block, address, index, result, operands, own."""
    own = F.when(F.col("l_quantity") > 49, 0).when(F.col("l_quantity") > 48, 1).when(F.col("l_quantity") > 47, 2)
    name = lambda c: F.concat(F.lit("v"), (c % 97).cast("string"))
    address = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + F.col("l_partkey") % 4096
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("fn"), (F.col("l_partkey") % 30).alias("block"), address.alias("address"), F.col("l_linenumber").cast("long").alias("index"),
        F.when(F.col("l_returnflag") != "N", name(F.col("l_partkey"))).alias("result"), F.array(name(F.col("l_orderkey")), name(F.col("l_partkey") * 3)).alias("operands"), own.alias("own"),
    )


@audit("S21 D12 D19 O32", f"WITH RECURSIVE {_SLICES} SELECT fn, block, struct_extract(best, 1) AS priority, struct_extract(best, 2) AS address, kept, full_count AS full, full_count - r.n AS omitted, w.n > 24 OR m > 5 AS limited FROM r JOIN f USING (fn, block) JOIN w USING (fn) WHERE nth <= 5")
def evidence_slices(spark: SparkSession, d: str) -> DataFrame:
    """The 24 best instructions of a function and the five best of their blocks, by priorities relaxed along definitions."""
    s = merging.evidence_slices(instructions(spark, d), 24, 5)
    return s.withColumn("kept", F.array_join(F.transform("kept", lambda x: x.cast("string")), ","))
