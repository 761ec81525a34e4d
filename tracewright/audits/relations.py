"""Joins: resolution, containment, overlap, as-of within limits, best matches and referential checks.

Every join is an equality join on a key that spreads; intervals within a key are decided by the join's condition or by one
sorted pass over both sides, never by all pairs of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.audits.metrics import ids, tally
from tracewright.audits.registry import CALLS, FACTS, FOUND, NODES, RUNS, WORK, audit, calls, facts, found, nodes, runs, work
from tracewright.functions import scalars as S
from tracewright.operators import joins as J
from tracewright.operators import ranking as R
from tracewright.sources.tables import table

#: The hunters of a category, in order.
ROUTES = {"reportable": ["h0", "h2"], "reproduced": ["h1"], "raw": ["h3", "h1"]}


def resolved_calls(sites: DataFrame, defined: DataFrame, known: list[str]) -> DataFrame:
    """caller, line, callee, target, resolution of each call: the definition of its name in the same file, else that with
    the smallest id; calls of known external names are skipped and the rest stays unresolved.

    A name's definitions are first reduced to the least of each file and the least of all, so that a name that occurs
    everywhere joins one row a call.
    """
    sites = sites.filter(~F.col("callee").isin(known))
    here = defined.groupBy(F.col("symbol").alias("callee"), "path").agg(F.min("node_id").alias("own"))
    anywhere = here.groupBy("callee").agg(F.min("own").alias("other"))
    out = sites.join(here, ["callee", "path"], "left").join(anywhere, "callee", "left")
    rule = F.when(F.col("own").isNotNull(), "same_file").when(F.col("other").isNotNull(), "smallest").otherwise("unresolved")
    return out.select("caller", "line", "callee", F.coalesce("own", "other").alias("target"), rule.alias("resolution"))


_RESOLVED = f"""{NODES}, {CALLS}, here AS (SELECT symbol AS callee, path, min(node_id) AS own FROM nodes GROUP BY 1, 2), anywhere AS (SELECT callee, min(own) AS other FROM here GROUP BY 1),
resolved AS (SELECT caller, line, callee, coalesce(own, other) AS target, CASE WHEN own IS NOT NULL THEN 'same_file' WHEN other IS NOT NULL THEN 'smallest' ELSE 'unresolved' END AS resolution FROM calls LEFT JOIN here USING (callee, path) LEFT JOIN anywhere USING (callee) WHERE callee <> 'memcpy')"""


@audit("J1 J2", f"WITH {_RESOLVED} SELECT * FROM resolved")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"])


@audit("J34 J33", f"WITH {_RESOLVED} SELECT caller, target, count(*) AS sites, min(line) AS first_line, string_agg(DISTINCT resolution, ',' ORDER BY resolution) AS resolutions FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges recovered from call sites."""
    r = resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"]).filter("target is not null")
    return r.groupBy("caller", "target").agg(F.count("*").alias("sites"), F.min("line").alias("first_line"), ids("resolution").alias("resolutions"))


@audit(
    "J3",
    """WITH s AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 0), g AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal < 0) SELECT s_suppkey AS scanner, c_custkey AS grammar FROM s JOIN g ON s_nationkey = c_nationkey""",
)
def grammar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every scanner with every grammar file of its project; all pairs are the result that is asked for."""
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_nationkey", F.col("s_suppkey").alias("scanner"))
    g = table(spark, d, "customer").filter("c_acctbal < 0").select("c_nationkey", F.col("c_custkey").alias("grammar"))
    return J.spread_join(g, s, ("c_nationkey", "s_nationkey")).select("scanner", "grammar")


@audit(
    "J4 S10",
    f"""WITH {NODES}, m AS (SELECT DISTINCT 'f' || (p_partkey % 500) AS symbol, 'M_' || upper(p_brand) AS alias FROM part) SELECT node_id, symbol, count(alias) AS n, coalesce(string_agg(alias, ',' ORDER BY alias), '') AS aliases FROM nodes LEFT JOIN m USING (symbol) GROUP BY 1, 2""",
)
def alias_attach(spark: SparkSession, d: str) -> DataFrame:
    """Each node with the macro names that stand for it."""
    m = table(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 500).cast("string")).alias("symbol"), F.concat(F.lit("M_"), F.upper("p_brand")).alias("alias"))
    m = m.distinct().groupBy("symbol").agg(F.count("*").alias("n"), ids("alias").alias("aliases"))
    return nodes(spark, d).join(m, "symbol", "left").select("node_id", "symbol", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("aliases", F.lit("")).alias("aliases"))


@audit(
    "J5",
    f"""WITH {NODES}, p AS (SELECT l_orderkey, l_linenumber, o_custkey AS path, l_partkey % 970 AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, min(node_id) FILTER (true) AS any_node, arg_min(node_id, (nodes.line, node_id)) AS node_id FROM p LEFT JOIN nodes ON p.path = nodes.path AND nodes.line <= p.line AND p.line <= end_line GROUP BY 1, 2""".replace("min(node_id) FILTER (true) AS any_node, ", ""),
)
def node_at_line(spark: SparkSession, d: str) -> DataFrame:
    """The first node of a file whose span holds a line; null if none does."""
    p = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_linenumber").cast("long"), F.col("o_custkey").alias("path"), (F.col("l_partkey") % 970).alias("at"))
    n = nodes(spark, d).select("node_id", F.col("path").alias("p"), "line", "end_line")
    joined = p.join(n, (F.col("path") == F.col("p")) & F.col("at").between(F.col("line"), F.col("end_line")), "left")
    return joined.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct("line", "node_id"))).alias("x")).select("l_orderkey", "l_linenumber", F.col("x.node_id").alias("node_id"))


@audit(
    "J6 C5",
    f"""WITH {NODES}, c AS (SELECT c_custkey AS path, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey % 900 END AS s FROM customer WHERE c_mktsegment = 'BUILDING') SELECT path, node_id, s IS NULL AS whole_file FROM c JOIN nodes USING (path) WHERE s IS NULL OR (line <= s + 60 AND s <= end_line)""",
)
def changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a changed range overlaps; a file that changed without ranges has changed as a whole."""
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") % 900).alias("s"))
    n = nodes(spark, d)
    meets = F.col("s").isNull() | (F.col("line") <= F.col("s") + 60) & (F.col("s") <= F.col("end_line"))
    return c.join(n, "path").filter(meets).select("path", "node_id", F.col("s").isNull().alias("whole_file"))


@audit(
    "J7 S9",
    f"""WITH h AS (SELECT p_partkey, p_brand || '/' || (p_size % 10) || '.h' AS header FROM part), i AS (SELECT l_orderkey, p_brand || '/' || (l_linenumber % 12) || '.h' AS full_path, (l_linenumber % 12) || '.h' AS name, p_brand AS folder FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT DISTINCT header FROM h), r AS (SELECT header, count(DISTINCT l_orderkey) AS consumers FROM i JOIN u ON full_path = header OR folder || '/' || name = header GROUP BY 1)
SELECT header, coalesce(consumers, 0) AS consumers, consumers IS NULL AS unresolved FROM u LEFT JOIN r USING (header)""",
)
def header_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Who includes a header, by its full path or from its own folder; headers without a consumer stay, unresolved."""
    p = table(spark, d, "part")
    header = p.select(F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 10).cast("string"), F.lit(".h")).alias("header")).distinct()
    li = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat((F.col("l_linenumber") % 12).cast("string"), F.lit(".h"))
    ways = F.array_distinct(F.array(F.concat(F.col("p_brand"), F.lit("/"), name), F.concat_ws("/", "p_brand", name)))
    used = li.select("l_orderkey", F.explode(ways).alias("header")).join(header, "header", "left_semi").groupBy("header").agg(F.countDistinct("l_orderkey").alias("consumers"))
    out = header.join(used, "header", "left")
    return out.select("header", F.coalesce("consumers", F.lit(0)).cast("long").alias("consumers"), F.col("consumers").isNull().alias("unresolved"))


@audit(
    "J9",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT l_suppkey AS slice, o_custkey AS node, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT p_partkey FROM part WHERE p_size = 1)
SELECT slice, count(DISTINCT c_custkey) AS nodes, count(DISTINCT p_partkey) AS files FROM s LEFT JOIN c ON node = c_custkey LEFT JOIN f ON file = p_partkey GROUP BY 1 HAVING count(c_custkey) + count(p_partkey) > 0""",
)
def slice_impact(spark: SparkSession, d: str) -> DataFrame:
    """Slices with a changed node or a changed file."""
    s = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("slice"), F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey", F.col("c_custkey").alias("n"))
    f = table(spark, d, "part").filter("p_size = 1").select("p_partkey", F.col("p_partkey").alias("f"))
    out = s.join(c, "c_custkey", "left").join(f, "p_partkey", "left").groupBy("slice").agg(F.countDistinct("n").alias("nodes"), F.countDistinct("f").alias("files"))
    return out.filter("nodes + files > 0")


_KINDS = "{0} AS (SELECT * FROM facts WHERE kind = '{0}')"


@audit(
    "J10 J11 G10 G11",
    f"""WITH {FACTS}, {FOUND}, a AS (SELECT * FROM facts WHERE kind = 'allocation'), w AS (SELECT * FROM facts WHERE kind = 'write'), g AS (SELECT node_id, name, min(line) AS line, max(bound) AS bound FROM facts WHERE kind = 'guard' GROUP BY 1, 2), s AS (SELECT DISTINCT run_id, session_index FROM found WHERE state = 'reportable'),
c AS (SELECT a.node_id, a.fact_id AS allocation, w.fact_id AS write, w.bound > a.bound AS exceeds, CASE WHEN g.line IS NULL THEN 'absent' WHEN g.line < w.line AND g.bound <= a.bound THEN 'dominates' WHEN g.line < w.line THEN 'partial' ELSE 'unknown' END AS guard, s.run_id IS NOT NULL AS signal FROM a JOIN w USING (node_id, name) LEFT JOIN g USING (node_id, name) LEFT JOIN s ON s.run_id = node_id AND session_index = w.fact_id % 8)
SELECT node_id, allocation, write, guard, signal, (CASE guard WHEN 'absent' THEN 85 WHEN 'partial' THEN 75 WHEN 'unknown' THEN 60 ELSE 30 END + CASE WHEN exceeds THEN 10 ELSE 0 END + CASE WHEN signal THEN 5 ELSE 0 END)::BIGINT AS score FROM c""",
)
def capacity_chains(spark: SparkSession, d: str) -> DataFrame:
    """Allocations with the writes to them, the guard between by its line and bound, sink signals at the write, a score."""
    f = facts(spark, d)
    a = f.filter("kind = 'allocation'").select("node_id", "name", F.col("fact_id").alias("allocation"), F.col("bound").alias("capacity"))
    w = f.filter("kind = 'write'").select("node_id", "name", F.col("fact_id").alias("write"), "line", "bound")
    g = f.filter("kind = 'guard'").groupBy("node_id", "name").agg(F.min("line").alias("g_line"), F.max("bound").alias("g_bound"))
    s = found(spark, d).filter("state = 'reportable'").select(F.col("run_id").alias("node_id"), F.col("session_index").alias("at"), F.lit(True).alias("s")).distinct()
    c = a.join(w, ["node_id", "name"]).join(g, ["node_id", "name"], "left").withColumn("at", F.col("write") % 8).join(s, ["node_id", "at"], "left")
    before = F.col("g_line") < F.col("line")
    guard = F.when(F.col("g_line").isNull(), "absent").when(before & (F.col("g_bound") <= F.col("capacity")), "dominates").when(before, "partial").otherwise("unknown")
    c = c.withColumns({"guard": guard, "signal": F.coalesce("s", F.lit(False))})
    base = F.when(F.col("guard") == "absent", 85).when(F.col("guard") == "partial", 75).when(F.col("guard") == "unknown", 60).otherwise(30)
    score = base + F.when(F.col("bound") > F.col("capacity"), 10).otherwise(0) + F.when(F.col("signal"), 5).otherwise(0)
    return c.select("node_id", "allocation", "write", "guard", "signal", score.cast("long").alias("score"))


def latest_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: list[str], tie: str, most: int) -> DataFrame:
    """as_of() in which a match further back than most counts as none."""
    out = J.as_of(left, right.withColumn("_was", F.col(at)), keys, at, [*payload, "_was"], tie)
    near = F.col(at) - F.col("_was") <= most
    return out.select(*left.columns, *[F.when(near, F.col(c)).alias(c) for c in payload])


@audit(
    "J12 J16 J38",
    f"""WITH {FACTS}, l AS (SELECT node_id, fact_id AS loop_id, line FROM facts WHERE kind = 'loop'), w AS (SELECT node_id, fact_id, line FROM facts WHERE kind = 'write')
SELECT node_id, fact_id, CASE WHEN line - m <= 4 THEN loop_id END AS loop_id FROM (SELECT w.node_id, w.fact_id, w.line, max(l.line) AS m, arg_max(loop_id, (l.line, loop_id)) AS loop_id FROM w LEFT JOIN l ON w.node_id = l.node_id AND l.line <= w.line GROUP BY 1, 2, 3)""",
)
def nearest_loop(spark: SparkSession, d: str) -> DataFrame:
    """The latest loop at most four lines before a write."""
    f = facts(spark, d)
    loops = f.filter("kind = 'loop'").select("node_id", "line", F.col("fact_id").alias("loop_id"))
    writes = f.filter("kind = 'write'").select("node_id", "fact_id", "line").distinct()
    return latest_within(writes, loops, ["node_id"], "line", ["loop_id"], "loop_id", 4).drop("line")


@audit(
    "J13 G17",
    f"""WITH {FACTS}, g AS (SELECT node_id, fact_id AS guard_id, line, line + bound AS till FROM facts WHERE kind = 'guard'), w AS (SELECT node_id, fact_id, line FROM facts WHERE kind = 'write') SELECT w.node_id, w.fact_id, count(guard_id) AS guards, min(guard_id) AS first_guard FROM w LEFT JOIN g ON w.node_id = g.node_id AND w.line > g.line AND w.line <= till GROUP BY 1, 2""",
)
def guard_control(spark: SparkSession, d: str) -> DataFrame:
    """The guards whose span controls a write."""
    f = facts(spark, d)
    g = f.filter("kind = 'guard'").select(F.col("node_id").alias("n"), F.col("fact_id").alias("guard_id"), F.col("line").alias("since"), (F.col("line") + F.col("bound")).alias("till"))
    w = f.filter("kind = 'write'").select("node_id", "fact_id", "line")
    inside = (F.col("node_id") == F.col("n")) & (F.col("line") > F.col("since")) & (F.col("line") <= F.col("till"))
    return w.join(g, inside, "left").groupBy("node_id", "fact_id").agg(F.count("guard_id").alias("guards"), F.min("guard_id").alias("first_guard"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: str) -> DataFrame:
    """Each left row with the right row of equal keys and least distance in at, ties to the earlier, then the least payload.

    Two sorted passes, one for what is before and one for what is after; no pairs are formed. payload must be a number.
    """
    best = right.groupBy(*keys, at).agg(F.min(payload).alias(payload)).withColumn("_w", F.col(at))
    back = J.as_of(left, best, keys, at, [payload, "_w"], payload).withColumnsRenamed({payload: "_b", "_w": "_bw"})
    flip = lambda df: df.withColumn(at, -F.col(at))
    both = flip(J.as_of(flip(back), flip(best), keys, at, [payload, "_w"], payload)).withColumnsRenamed({payload: "_a", "_w": "_aw"})
    before, after = F.col(at) - F.col("_bw"), F.col("_aw") - F.col(at)
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (before <= after))
    return both.select(*left.columns, F.when(earlier, F.col("_b")).otherwise(F.col("_a")).alias(payload), F.when(earlier, before).otherwise(after).alias("distance"))


@audit(
    "J14",
    f"""WITH {FACTS}, r AS (SELECT node_id, name, fact_id, line FROM facts WHERE kind = 'write'), c AS (SELECT node_id, name, fact_id AS check_id, line FROM facts WHERE kind = 'guard')
SELECT r.node_id, r.fact_id, r.name, r.line, arg_min(check_id, (abs(c.line - r.line), c.line, check_id)) AS check_id, min(abs(c.line - r.line)) AS distance FROM r LEFT JOIN c USING (node_id, name) GROUP BY 1, 2, 3, 4""",
)
def nearest_length_check(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    checks = f.filter("kind = 'guard'").select("node_id", "name", "line", F.col("fact_id").alias("check_id"))
    reads = f.filter("kind = 'write'").select("node_id", "name", "line", "fact_id").distinct()
    return nearest(reads, checks, ["node_id", "name"], "line", "check_id")


@audit(
    "J17 J18 J21",
    f"""WITH {_RESOLVED}, {FACTS}, e AS (SELECT target, caller AS other, 0 AS k FROM resolved WHERE target IS NOT NULL UNION ALL SELECT caller, target, 1 FROM resolved WHERE target IS NOT NULL), r AS (SELECT target AS node_id, other, min(k) AS k FROM e WHERE target <> other GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k, other) AS i FROM r)
SELECT t.node_id, other, CASE k WHEN 0 THEN 'caller' ELSE 'callee' END AS role, count(fact_id) AS guards FROM t LEFT JOIN (SELECT * FROM facts WHERE kind = 'guard') f ON f.node_id = other WHERE i <= 16 GROUP BY 1, 2, 3""",
)
def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Up to sixteen neighbours of a node, callers before callees, with the constraint facts that lie on them."""
    r = resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"]).filter("target is not null and target <> caller")
    sides = F.array(F.struct(F.col("target").alias("node_id"), F.col("caller").alias("other"), F.lit(0).alias("k")), F.struct(F.col("caller").alias("node_id"), F.col("target").alias("other"), F.lit(1).alias("k")))
    e = r.select(F.explode(sides).alias("x")).select("x.*").groupBy("node_id", "other").agg(F.min("k").alias("k"))
    e = R.top_k(e, ["node_id"], [F.col("k"), F.col("other")], 16)
    g = facts(spark, d).filter("kind = 'guard'").groupBy(F.col("node_id").alias("other")).agg(F.count("*").alias("guards"))
    return e.join(g, "other", "left").select("node_id", "other", F.when(F.col("k") == 0, "caller").otherwise("callee").alias("role"), F.coalesce("guards", F.lit(0)).cast("long").alias("guards"))


@audit(
    "J24",
    f"""WITH {WORK}, o AS (SELECT c_custkey AS obligation, c_mktsegment AS component, c_nationkey::BIGINT AS family FROM customer), m AS (SELECT obligation, work_id, component, (component = w) ::INT AS dummy FROM (SELECT o.obligation, work.work_id, o.component, work.component AS w, row_number() OVER (PARTITION BY o.obligation ORDER BY (work.score % 7 = o.obligation % 7) DESC, work.risk DESC, work.work_id) AS r FROM o JOIN work USING (component, family)) WHERE r = 1)
SELECT obligation, work_id, work_id IS NULL AS cloned FROM o LEFT JOIN m USING (obligation)""",
)
def bound_obligations(spark: SparkSession, d: str) -> DataFrame:
    """Each obligation with the best item that shares its targets: overlap, risk, id; without one the seed's is cloned.

    An obligation looks at an item only through its overlap class, so items are first reduced to the best of each class:
    a row a key with seven items, whatever the number of items. The least id of a risk comes before the least struct, which
    Spark finds by sorting what it aggregates.
    """
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("obligation"), F.col("c_mktsegment").alias("component"), F.col("c_nationkey").cast("long").alias("family"))
    key = ["component", "family"]
    w = work(spark, d).groupBy(*key, (F.col("score") % 7).alias("class"), "risk").agg(F.min("work_id").alias("id"))
    w = w.groupBy(*key, "class").agg(F.min(F.struct((-F.col("risk")).alias("r"), "id")).alias("best"))
    w = w.groupBy(*key).agg(F.collect_list(F.struct("class", "best.r", "best.id")).alias("items"))
    mine = lambda x: F.struct((x["class"] != F.col("obligation") % 7).alias("o"), x["r"].alias("r"), x["id"].alias("id"))
    best = o.join(w, key, "left").select("obligation", F.array_min(F.transform("items", mine)).alias("k"))
    out = best.groupBy("obligation").agg(F.min("k").alias("k"))
    return out.select("obligation", F.col("k.id").alias("work_id"), F.col("k").isNull().alias("cloned"))


@audit(
    "J25",
    f"""WITH {FOUND}, r AS (SELECT * FROM (VALUES ('reportable', 'h0', 0), ('reportable', 'h2', 1), ('reproduced', 'h1', 0), ('raw', 'h3', 0), ('raw', 'h1', 1)) v(state, route, place)) SELECT run_id, route, count(*) AS signals, min(place)::BIGINT AS place FROM found JOIN r USING (state) GROUP BY 1, 2""",
)
def signal_routes(spark: SparkSession, d: str) -> DataFrame:
    """The hunters of each signal's category, in the category's order; a constant table."""
    rows = [(s, h, i) for s, hs in ROUTES.items() for i, h in enumerate(hs)]
    r = spark.createDataFrame(rows, "state string, route string, place long")
    return found(spark, d).join(F.broadcast(r), "state").groupBy("run_id", "route").agg(F.count("*").alias("signals"), F.min("place").alias("place"))


@audit(
    "J26 C19 S17",
    f"""WITH {FOUND}, {WORK}, f AS (SELECT sha256(candidate_id || '|' || target_id) AS fingerprint, run_id, session_index FROM found), o AS (SELECT fingerprint, min(run_id) AS origin, count(*) AS n, count(DISTINCT run_id) AS runs FROM f GROUP BY 1) SELECT o.fingerprint, origin, n, runs, component, hunter FROM o JOIN work ON work_id = origin""",
)
def finding_origins(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all workers by fingerprint, with the work that they came from first."""
    pair = ["candidate_id", "target_id"]
    named = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
    # By numbers, as a digest as the key of two shuffles is most of what they write.
    each = found(spark, d).groupBy(*[F.when(named, F.col(c)).alias(c) for c in pair], "run_id").agg(F.count("*").alias("n"))
    f = each.groupBy(*pair).agg(F.min("run_id").alias("origin"), F.sum("n").alias("n"), F.count("run_id").alias("runs"))
    fingerprint = F.sha2(F.concat(F.col(pair[0]).cast("string"), F.lit("|"), F.col(pair[1]).cast("string")), 256)
    return f.join(work(spark, d), F.col("origin") == F.col("work_id")).select(fingerprint.alias("fingerprint"), "origin", "n", "runs", "component", "hunter")


@audit(
    "J27 J28 J42",
    f"""WITH {FACTS}, o AS (SELECT DISTINCT ON (p_partkey % 40, p_size % 3) p_partkey % 40 AS line, 'v' || (p_size % 3) AS name, p_brand AS weakness FROM part ORDER BY p_partkey % 40, p_size % 3, p_partkey)
SELECT fact_id, kind, weakness IS NOT NULL AS matched, weakness FROM facts LEFT JOIN o USING (line, name) WHERE kind IN ('write', 'allocation')""",
)
def oracle_matches(spark: SparkSession, d: str) -> DataFrame:
    """Candidates at an oracle's location and variable."""
    o = table(spark, d, "part").groupBy((F.col("p_partkey") % 40).alias("line"), F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")).alias("name")).agg(F.min_by("p_brand", "p_partkey").alias("weakness"))
    f = facts(spark, d).filter("kind in ('write', 'allocation')")
    return f.join(o, ["line", "name"], "left").select("fact_id", "kind", F.col("weakness").isNotNull().alias("matched"), "weakness")


@audit(
    "J29 S27",
    f"""WITH {RUNS}, {FOUND}, f AS (SELECT run_id, count(*) AS n, count(DISTINCT candidate_id) AS k, max(session_index) AS last, sum(target_id) AS cost FROM found GROUP BY 1)
SELECT run_id, concat_ws(',', CASE WHEN n IS NULL THEN 'no_receipt' END, CASE WHEN n <> k THEN 'duplicate_candidate' END, CASE WHEN last > 6 THEN 'session_budget' END, CASE WHEN input_tokens > 300000 THEN 'input_budget' END, CASE WHEN output_tokens > 40000 THEN 'output_budget' END) AS broken FROM runs LEFT JOIN f USING (run_id)""",
)
def run_links(spark: SparkSession, d: str) -> DataFrame:
    """References, uniqueness and ceilings of a run across its artifacts; all that is broken by name."""
    f = found(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("k"), F.max("session_index").alias("last"))
    broken = S.reasons(("no_receipt", F.col("n").isNull()), ("duplicate_candidate", F.col("n") != F.col("k")), ("session_budget", F.col("last") > 6), ("input_budget", F.col("input_tokens") > 300000), ("output_budget", F.col("output_tokens") > 40000))
    return runs(spark, d).join(f, "run_id", "left").select("run_id", broken.alias("broken"))


@audit(
    "J31 C21",
    """WITH v AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS vulnerable, count(*) FILTER (l_linestatus = 'F') AS fixed, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 45) AS alarms FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(vulnerable > 0 AND fixed > 0, false) AS paired, coalesce(vulnerable > 0 AND fixed > 0 AND alarms = 0, false) AS passed FROM part LEFT JOIN v ON l_partkey = p_partkey""",
)
def differential_controls(spark: SparkSession, d: str) -> DataFrame:
    """A case needs a vulnerable target and a fixed control, and the control must stay silent."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(tally(F.col("l_linestatus") == "O", "v"), tally(F.col("l_linestatus") == "F", "f"), tally((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "alarms"))
    paired = F.coalesce((F.col("v") > 0) & (F.col("f") > 0), F.lit(False))
    out = table(spark, d, "part").join(v, "p_partkey", "left").select("p_partkey", paired.alias("paired"), "alarms")
    return out.select("p_partkey", "paired", (F.col("paired") & (F.col("alarms") == 0)).alias("passed"))


@audit(
    "J32 S20",
    f"""WITH {NODES}, s AS (SELECT c_custkey AS path, (c_custkey * 13) % 970 AS address, c_name AS value FROM customer) SELECT node_id, count(value) AS strings, min(value) AS first FROM nodes LEFT JOIN s ON s.path = nodes.path AND address >= line AND address < end_line GROUP BY 1""",
)
def string_references(spark: SparkSession, d: str) -> DataFrame:
    """Strings whose address lies within a function's span, its end excluded."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("p"), (F.col("c_custkey") * 13 % 970).alias("address"), F.col("c_name").alias("value"))
    inside = (F.col("path") == F.col("p")) & (F.col("address") >= F.col("line")) & (F.col("address") < F.col("end_line"))
    return nodes(spark, d).join(s, inside, "left").groupBy("node_id").agg(F.count("value").alias("strings"), F.min("value").alias("first"))


@audit(
    "J35 J33",
    """WITH m AS (SELECT p_partkey AS method, p_size % 10 AS slot, p_brand AS class FROM part), c AS (SELECT l_orderkey AS caller, l_linenumber % 10 AS slot, CASE WHEN l_returnflag = 'A' THEN p_brand END AS class FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT caller, slot, class FROM c GROUP BY ALL),
k AS (SELECT slot, class, min(method) AS method, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT slot, min(method) AS method, count(*) AS n FROM m GROUP BY 1)
SELECT caller, d.slot::BIGINT AS slot, d.class, CASE WHEN d.class IS NULL THEN CASE WHEN s.n = 1 THEN s.method END ELSE CASE WHEN k.n = 1 THEN k.method END END AS target, coalesce(CASE WHEN d.class IS NULL THEN s.n ELSE k.n END, 0) AS candidates FROM d LEFT JOIN k ON k.slot = d.slot AND k.class = d.class LEFT JOIN s ON s.slot = d.slot""",
)
def virtual_calls(spark: SparkSession, d: str) -> DataFrame:
    """Methods of a slot, of the receiver's class if it is known; ambiguous calls have candidates and no target."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), (F.col("p_size") % 10).cast("long").alias("slot"), F.col("p_brand").alias("class"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = li.select(F.col("l_orderkey").alias("caller"), (F.col("l_linenumber") % 10).cast("long").alias("slot"), F.when(F.col("l_returnflag") == "A", F.col("p_brand")).alias("class")).distinct()
    k = m.groupBy("slot", "class").agg(F.min("method").alias("k_method"), F.count("*").alias("k_n"))
    s = m.groupBy("slot").agg(F.min("method").alias("s_method"), F.count("*").alias("s_n"))
    out = c.join(k, ["slot", "class"], "left").join(s, "slot", "left")
    known = F.col("class").isNotNull()
    n = F.coalesce(F.when(known, F.col("k_n")).otherwise(F.col("s_n")), F.lit(0)).cast("long")
    return out.select("caller", "slot", "class", F.when(n == 1, F.when(known, F.col("k_method")).otherwise(F.col("s_method"))).alias("target"), n.alias("candidates"))


@audit(
    "J36",
    f"""WITH {_RESOLVED}, {FACTS}, s AS (SELECT DISTINCT node_id, line % 8 AS line FROM facts WHERE kind <> 'loop') SELECT caller, target, line FROM resolved WHERE target IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.node_id = caller AND s.line = resolved.line)""",
)
def bound_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose call site survives in a slice."""
    s = facts(spark, d).filter("kind <> 'loop'").select(F.col("node_id").alias("caller"), (F.col("line") % 8).alias("line"))
    r = resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"]).filter("target is not null")
    return r.join(s, ["caller", "line"], "left_semi").select("caller", "target", "line")


@audit(
    "J37 G23 D17",
    f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE kind = 'allocation'), w AS (SELECT * FROM facts WHERE kind = 'write'), l AS (SELECT * FROM facts WHERE kind = 'loop')
SELECT a.fact_id AS allocation, a.node_id, min(w.line) AS filled_at, max(w.bound) AS filled, count(DISTINCT l.fact_id) AS consumers, coalesce(max(w.bound) < a.bound AND count(l.fact_id) > 0, false) AS disclosed FROM a LEFT JOIN w ON w.node_id = a.node_id AND w.name = a.name LEFT JOIN l ON l.node_id = a.node_id AND l.name = a.name AND l.line > w.line AND l.bound >= a.bound GROUP BY a.fact_id, a.node_id, a.bound""",
)
def partial_initialisation(spark: SparkSession, d: str) -> DataFrame:
    """Allocations that are filled in part and consumed later in full: what lies behind the fill is disclosed."""
    f = facts(spark, d)
    part = lambda k, n: f.filter(F.col("kind") == k).select("node_id", "name", F.col("fact_id").alias(f"{n}_id"), F.col("line").alias(f"{n}_line"), F.col("bound").alias(f"{n}_bound"))
    a, w, consumers = part("allocation", "a"), part("write", "w"), part("loop", "l").withColumnsRenamed({"node_id": "n", "name": "m"})
    later = (F.col("node_id") == F.col("n")) & (F.col("name") == F.col("m")) & (F.col("l_line") > F.col("w_line")) & (F.col("l_bound") >= F.col("a_bound"))
    j = a.join(w, ["node_id", "name"], "left").join(consumers, later, "left")
    out = j.groupBy(F.col("a_id").alias("allocation"), "node_id", "a_bound").agg(F.min("w_line").alias("filled_at"), F.max("w_bound").alias("filled"), F.countDistinct("l_id").alias("consumers"))
    return out.withColumn("disclosed", F.coalesce((F.col("filled") < F.col("a_bound")) & (F.col("consumers") > 0), F.lit(False))).drop("a_bound")


@audit(
    "J15 G6 G7 G25",
    f"""WITH RECURSIVE {FACTS}, e AS (SELECT DISTINCT node_id, name AS a, 'v' || ((right(name, 1)::INT + 1 + (bound % 2)) % 3) AS b FROM facts WHERE kind IN ('write', 'loop')), r AS (SELECT DISTINCT node_id, name AS seed, name, 0 AS hops FROM facts WHERE kind = 'guard' UNION SELECT r.node_id, seed, b, hops + 1 FROM r JOIN e ON e.node_id = r.node_id AND e.a = r.name WHERE hops < 8),
c AS (SELECT DISTINCT node_id, seed, name FROM r)
SELECT c.node_id, seed, count(DISTINCT c.name) AS reached, count(DISTINCT fact_id) AS allocations FROM c LEFT JOIN (SELECT * FROM facts WHERE kind = 'allocation') a ON a.node_id = c.node_id AND a.name = c.name GROUP BY 1, 2""",
)
def guarded_allocations(spark: SparkSession, d: str) -> DataFrame:
    """From each guarded variable the closure of assignments (eight hops at most), and the allocations that it reaches.

    A step is a join by function; names of one function are few, so the frontier shrinks to nothing after a few steps.
    """
    f = facts(spark, d)
    after = F.concat(F.lit("v"), ((F.right("name", F.lit(1)).cast("long") + 1 + F.col("bound") % 2) % 3).cast("string"))
    e = f.filter("kind in ('write', 'loop')").select("node_id", F.col("name").alias("a"), after.alias("b")).distinct()
    succ = e.groupBy("node_id").agg(F.collect_set(F.struct("a", "b")).alias("edges"))  # at most nine edges a function
    seeds = f.filter("kind = 'guard'").select("node_id", F.col("name").alias("seed")).distinct().join(succ, "node_id", "left")
    reach = F.array(F.col("seed"))
    state = seeds.withColumn("names", reach)
    step = F.array_distinct(F.concat("names", F.coalesce(F.transform(F.filter("edges", lambda x: F.array_contains("names", x["a"])), lambda x: x["b"]), F.array().cast("array<string>"))))
    for _ in range(3):  # three names: every closure is complete after as many steps
        state = state.withColumn("names", step)
    flat = state.select("node_id", "seed", F.size("names").cast("long").alias("reached"), F.explode("names").alias("name"))
    a = f.filter("kind = 'allocation'").select("node_id", "name", "fact_id")
    return flat.join(a, ["node_id", "name"], "left").groupBy("node_id", "seed").agg(F.max("reached").alias("reached"), F.countDistinct("fact_id").alias("allocations"))
