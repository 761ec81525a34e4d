"""Paths, propagation and control flow.

The call graph of all functions is walked level by level: one join, one stored frontier a level, and what was found before
is never rewritten. A function's own blocks are few, so its control flow is solved whole in one group of blocks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.audits.metrics import ids, tally
from tracewright.audits.registry import FACTS, FOUND, audit, calls, facts, found, nodes
from tracewright.audits.relations import _RESOLVED, resolved_calls
from tracewright.operators import ranking as R
from tracewright.operators.folds import ordered_fold
from tracewright.operators.graph import cut, shortest_paths
from tracewright.sources.tables import table

_EDGES = f"{_RESOLVED}, edges AS (SELECT DISTINCT caller AS src, target AS dst FROM resolved WHERE target IS NOT NULL AND target <> caller)"
_ENTRIES = "entries AS (SELECT node_id AS node, symbol < 'f2' AS preferred FROM nodes WHERE visibility = 'external' AND line < 60), sinks AS (SELECT DISTINCT node_id AS node FROM facts WHERE kind = 'write' AND bound > 40)"
_PATHS = f"""{_EDGES}, {FACTS}, {_ENTRIES}, p AS (SELECT node AS entry, node, [node] AS path, 0 AS n FROM entries UNION SELECT entry, dst, list_append(path, dst), n + 1 FROM p JOIN edges ON src = p.node WHERE n < 4 AND NOT list_contains(path, dst)),
s AS (SELECT entry, p.node AS sink, min(n) AS n, arg_min(path, (n, path)) AS path FROM p JOIN sinks USING (node) GROUP BY 1, 2)"""


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    r = resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"])
    return r.filter("target is not null and target <> caller").select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct()


def sink_paths(spark: SparkSession, d: str) -> DataFrame:
    """entry, sink, n, path of the shortest path (four calls at most), of equal ones the first, and whether the entry is preferred."""
    n = nodes(spark, d)
    entries = n.filter("visibility = 'external' and line < 60").select(F.col("node_id").alias("node"), (F.col("symbol") < "f2").alias("preferred"))
    sinks = facts(spark, d).filter("kind = 'write' and bound > 40").select(F.col("node_id").alias("node")).distinct()
    paths = shortest_paths(call_graph(spark, d), entries.select("node"), 4).join(sinks, "node", "left_semi")
    return paths.select(F.col("seed").alias("entry"), F.col("node").alias("sink"), F.col("length").alias("n"), "path").join(entries.withColumnRenamed("node", "entry"), "entry")


def joined(path: str) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


@audit(
    "G2 G4",
    f"""WITH RECURSIVE {_PATHS} SELECT sink, arg_min(entry, (NOT preferred, n, entry, path)) AS entry, array_to_string(arg_min(path, (NOT preferred, n, entry, path)), '>') AS path, count(*) AS entries FROM s JOIN entries ON entries.node = entry GROUP BY 1""",
)
def best_entry_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each sink's slice: of all entry paths the preferred, shortest, first one."""
    best = F.min(F.struct((~F.col("preferred")).alias("o"), "n", "entry", "path"))
    return sink_paths(spark, d).groupBy("sink").agg(best.alias("b"), F.count("*").alias("entries")).select("sink", F.col("b.entry").alias("entry"), joined("b.path").alias("path"), "entries")


@audit("G3", f"WITH RECURSIVE {_PATHS} SELECT entry, arg_min(sink, (n, sink, path)) AS sink, min(n)::BIGINT AS length, count(*) AS sinks FROM s GROUP BY 1")
def nearest_sinks(spark: SparkSession, d: str) -> DataFrame:
    s = sink_paths(spark, d).groupBy("entry").agg(F.min(F.struct("n", "sink", "path")).alias("b"), F.count("*").alias("sinks"))
    return s.select("entry", F.col("b.sink").alias("sink"), F.col("b.n").alias("length"), "sinks")


def spread(states: DataFrame, edges: DataFrame, step, keys: list[str], rounds: int) -> DataFrame:
    """The states (keys) that at most rounds applications of step to new states give, with the round that found each."""
    edges = cut(edges)
    levels = [cut(states.select(*keys).distinct().withColumn("depth", F.lit(0).cast("long")))]
    for k in range(1, rounds + 1):
        grown = step(levels[-1].drop("depth"), edges).select(*keys).distinct()
        grown = grown.join(reduce(DataFrame.union, levels).select(*keys), keys, "left_anti")
        levels.append(cut(grown.withColumn("depth", F.lit(k).cast("long"))))
    return reduce(DataFrame.union, levels)


@audit(
    "D2",
    f"""WITH RECURSIVE {_EDGES}, {FACTS}, w AS (SELECT DISTINCT node_id AS node, name, 0 AS depth FROM facts WHERE kind = 'write'), r AS (SELECT node, name, depth FROM w UNION SELECT src, name, depth + 1 FROM r JOIN edges ON dst = r.node WHERE depth < 5)
SELECT node, string_agg(DISTINCT name, ',' ORDER BY name) AS written, count(DISTINCT name) FILTER (own) AS own FROM (SELECT node, name, min(depth) = 0 AS own FROM r GROUP BY 1, 2) GROUP BY 1""",
)
def summary_propagation(spark: SparkSession, d: str) -> DataFrame:
    """What a function writes, itself or by calls up to five levels below it."""
    own = facts(spark, d).filter("kind = 'write'").select(F.col("node_id").alias("node"), "name")
    step = lambda s, e: s.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "name")
    return spread(own, call_graph(spark, d), step, ["node", "name"], 5).groupBy("node").agg(ids("name").alias("written"), tally(F.col("depth") == 0, "own"))


@audit(
    "G9",
    f"""WITH RECURSIVE {_EDGES}, {FACTS}, {FOUND}, t AS (SELECT DISTINCT run_id AS node, target_id % 3 AS param FROM found WHERE state = 'reportable' AND target_match AND session_index = 1), r AS (SELECT node, param, 0 AS depth FROM t UNION SELECT dst, (param + dst) % 3, depth + 1 FROM r JOIN edges ON src = r.node WHERE depth < 5)
SELECT node, param, min(depth)::BIGINT AS depth FROM r GROUP BY 1, 2""",
)
def taint_traversal(spark: SparkSession, d: str) -> DataFrame:
    """States (function, tainted parameter) within five calls of a tainted one, with the least depth."""
    t = found(spark, d).filter("state = 'reportable' and target_match and session_index = 1").select(F.col("run_id").alias("node"), (F.col("target_id") % 3).alias("param"))
    step = lambda s, e: s.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), ((F.col("param") + F.col("dst")) % 3).alias("param"))
    return spread(t, call_graph(spark, d), step, ["node", "param"], 5)


@audit(
    "G14 O31",
    f"""WITH RECURSIVE {_EDGES}, roots AS (SELECT node_id AS root FROM nodes WHERE line < 10), u AS (SELECT root, root AS node, 0 AS depth FROM roots UNION SELECT root, src, depth + 1 FROM u JOIN edges ON dst = u.node WHERE depth < 2), v AS (SELECT root, root AS node, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM v JOIN edges ON src = v.node WHERE depth < 2),
a AS (SELECT root, node, min((depth, role)) AS k FROM (SELECT *, 0 AS role FROM u UNION ALL SELECT *, 1 FROM v) WHERE node <> root GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY k, node) AS place FROM a)
SELECT root, node, k[1]::BIGINT AS depth, CASE k[2] WHEN 0 THEN 'caller' ELSE 'callee' END AS role, place, place <= 8 AS kept FROM o""".replace("k[1]", "struct_extract(k, 1)").replace("k[2]", "struct_extract(k, 2)"),
)
def bounded_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Callers and callees within two calls of a root, callers first; the first eight are kept and the rest is named."""
    roots = nodes(spark, d).filter("line < 10").select(F.col("node_id").alias("root"), F.col("node_id").alias("node"))
    edges = call_graph(spark, d)
    up = spread(roots, edges, lambda s, e: s.join(e, F.col("node") == F.col("dst")).select("root", F.col("src").alias("node")), ["root", "node"], 2)
    down = spread(roots, edges, lambda s, e: s.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")), ["root", "node"], 2)
    both = up.withColumn("role", F.lit(0)).union(down.withColumn("role", F.lit(1))).filter("node <> root")
    a = both.groupBy("root", "node").agg(F.min(F.struct("depth", "role")).alias("k"))
    o = R.ranked(a, ["root"], [F.col("k"), F.col("node")], "place")
    return o.select("root", "node", F.col("k.depth").alias("depth"), F.when(F.col("k.role") == 0, "caller").otherwise("callee").alias("role"), "place", (F.col("place") <= 8).alias("kept"))


_BLOCKS = """b AS (SELECT o_custkey AS fn, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderstatus AS status, o_orderpriority < '2' AS tagged FROM orders),
f AS (SELECT fn, i AS src, i + 1 AS dst FROM b WHERE i < n AND status <> 'P' UNION SELECT fn, i, 1 + id % n FROM b WHERE status <> 'F' UNION SELECT fn, i, least(n, i + 2) FROM b WHERE status = 'P')"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """fn, i, status, tagged, next: the blocks of functions in order, each with its successors."""
    o = R.ranked(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], "i")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    o = o.join(n, "o_custkey")
    s = F.col("o_orderstatus")
    after = F.array(F.when((F.col("i") < F.col("n")) & (s != "P"), F.col("i") + 1), F.when(s != "F", 1 + F.col("o_orderkey") % F.col("n")), F.when(s == "P", F.least("n", F.col("i") + 2)))
    return o.select(F.col("o_custkey").alias("fn"), "i", s.alias("status"), (F.col("o_orderpriority") < "2").alias("tagged"), F.array_distinct(F.array_compact(after)).alias("next"))


def _reached(after: list[list[int]], start: int, without: int = -1) -> set[int]:
    seen, todo = set(), [start] if start != without else []
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += [j for j in after[k] if j != without and j not in seen]
    return seen


class Flow:
    """One function's blocks in order; at their end what solve(rows, after) makes of them and their successors, from 0."""

    def __init__(self, solve):
        self.solve, self.rows = solve, []

    def step(self, row: dict) -> list[tuple]:
        self.rows.append(row)
        return []

    def end(self) -> list[tuple]:
        return self.solve(self.rows, [[j - 1 for j in r["next"]] for r in self.rows])


@audit(
    "G15 G16 G17 D20",
    f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT DISTINCT fn, 1::BIGINT AS i FROM b UNION SELECT r.fn, dst FROM r JOIN f ON f.fn = r.fn AND src = r.i),
a AS (SELECT b.fn, b.i AS gone, 1::BIGINT AS i FROM b WHERE b.i <> 1 UNION SELECT a.fn, gone, dst FROM a JOIN f ON f.fn = a.fn AND src = a.i AND dst <> gone), p AS (SELECT fn, dst AS i, count(*) AS predecessors FROM f GROUP BY 1, 2),
dom AS (SELECT r.fn, r.i, g.i AS d FROM r JOIN b g ON g.fn = r.fn WHERE g.i = 1 OR g.i = r.i OR NOT EXISTS (SELECT 1 FROM a WHERE a.fn = r.fn AND gone = g.i AND a.i = r.i)), k AS (SELECT dom.fn, dom.i, count(*) FILTER (EXISTS (SELECT 1 FROM r x WHERE x.fn = dom.fn AND x.i = dom.d)) AS dominators FROM dom GROUP BY 1, 2),
last AS (SELECT fn, max(i) AS sink FROM r GROUP BY 1)
SELECT b.fn, b.i, r.i IS NOT NULL AS reachable, coalesce(p.predecessors, 0) AS predecessors, coalesce(dominators, 0) AS dominators, b.status = 'F' AND coalesce(sp.predecessors = 1 AND sd.d IS NOT NULL, false) AS safe_guard FROM b LEFT JOIN r USING (fn, i) LEFT JOIN p USING (fn, i) LEFT JOIN k USING (fn, i) LEFT JOIN last ON last.fn = b.fn LEFT JOIN p sp ON sp.fn = b.fn AND sp.i = b.i + 1 LEFT JOIN dom sd ON sd.fn = b.fn AND sd.i = sink AND sd.d = b.i + 1""",
)
def control_flow_facts(spark: SparkSession, d: str) -> DataFrame:
    """Reachable blocks, predecessors, dominators, and guards whose safe edge dominates the function's last block: the
    edge's successor dominates it and has no other predecessor."""

    def solve(rows: list[dict], after: list[list[int]]) -> list[tuple]:
        n, reached = len(rows), _reached(after, 0)
        # Block k dominates what the entry no longer reaches without it.
        dominates = [reached if k == 0 else reached - _reached(after, 0, k) if k in reached else set() for k in range(n)]
        into, count = [0] * n, [0] * n
        for k in range(n):
            for j in after[k]:
                into[j] += 1
            for j in dominates[k]:
                count[j] += 1
        sink = max(reached)
        safe = [r["status"] == "F" and k + 1 < n and into[k + 1] == 1 and sink in dominates[k + 1] for k, r in enumerate(rows)]
        return [(r["i"], k in reached, into[k], count[k], safe[k]) for k, r in enumerate(rows)]

    return ordered_fold(blocks(spark, d), ["fn"], ["i"], lambda: Flow(solve), "i long, reachable boolean, predecessors long, dominators long, safe_guard boolean")


@audit(
    "G18 G21",
    f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT fn, i AS origin, status AS tag, i FROM b WHERE tagged UNION SELECT t.fn, origin, tag, dst FROM t JOIN f ON f.fn = t.fn AND src = t.i)
SELECT fn, i, tag, min(origin) AS origin FROM t GROUP BY 1, 2, 3""",
)
def forward_taint(spark: SparkSession, d: str) -> DataFrame:
    """The tags that hold in a block: those that it gives and the union of what flows in, each with its earliest origin."""

    def solve(rows: list[dict], after: list[list[int]]) -> list[tuple]:
        out = {}
        for k, r in enumerate(rows):
            if r["tagged"]:
                for j in _reached(after, k):
                    out.setdefault((j, r["status"]), k)
        return [(j + 1, tag, k + 1) for (j, tag), k in out.items()]

    return ordered_fold(blocks(spark, d), ["fn"], ["i"], lambda: Flow(solve), "i long, tag string, origin long")


@audit(
    "G24 U7",
    """WITH RECURSIVE v AS (SELECT l_suppkey AS fn, l_partkey % 60 AS a, (l_partkey * 7 + l_linenumber) % 60 AS b, l_returnflag FROM lineitem), e AS (SELECT DISTINCT fn, a, b FROM v WHERE l_returnflag = 'A' AND a <> b AND a < 25), n AS (SELECT DISTINCT fn, a AS x FROM v UNION SELECT fn, b FROM v), ab AS (SELECT fn, a, b FROM e UNION SELECT fn, b, a FROM e),
r AS (SELECT fn, x, x AS y FROM n UNION SELECT r.fn, r.x, b FROM r JOIN ab ON ab.fn = r.fn AND a = r.y) SELECT fn, x, min(y) AS root FROM r GROUP BY 1, 2""",
)
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    """Variables of a function that assignments, casts and merges make the same: its connected components.

    The groups' names fit a task (a function's variables are few), its assignments are reduced to distinct pairs first.
    """
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fn"), (F.col("l_partkey") % 60).alias("a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 60).alias("b"), (F.col("l_returnflag") == "A").alias("same"))
    pairs = v.select("fn", "a", "b", (F.col("same") & (F.col("a") < 25)).alias("same")).distinct()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        root = {int(x): int(x) for x in pd.concat([frame["a"], frame["b"]])}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in frame.loc[frame["same"], ["a", "b"]].itertuples(index=False):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return pd.DataFrame([(frame["fn"].iloc[0], x, find(x)) for x in root], columns=["fn", "x", "root"])

    return pairs.groupBy("fn").applyInPandas(solve, "fn long, x long, root long")


@audit(
    "G20 G22 D16",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS op, (CASE WHEN l_linenumber % 3 = 0 THEN 4294967295 WHEN l_linenumber % 3 = 1 THEN 65535 ELSE 255 END)::BIGINT AS maximum, 1 + l_partkey % 50 AS c, l_discount > 0.05 AS offset_check, l_tax > 0.04 AS length_check, l_quantity > 40 AS clamped, l_linestatus = 'O' AS evidence FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE op WHEN 'A' THEN maximum // c WHEN 'N' THEN maximum >> (c % 20)::INT ELSE maximum - c END AS most, CASE WHEN NOT evidence THEN 'insufficient_evidence' WHEN clamped THEN 'length_clamped' WHEN offset_check AND length_check THEN 'safe_combined' ELSE 'individual_only' END AS status FROM g""",
)
def guard_limits(spark: SparkSession, d: str) -> DataFrame:
    """The greatest input that a guard lets through (max / c, max >> c, max - c for w-bit values), and a range's status."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    top = F.when(n % 3 == 0, F.lit(4294967295)).when(n % 3 == 1, F.lit(65535)).otherwise(F.lit(255)).cast("long")
    c = 1 + F.col("l_partkey") % 50
    shifted = F.expr("shiftright(top, cast(c % 20 as int))")
    status = F.when(F.col("l_linestatus") != "O", "insufficient_evidence").when(F.col("l_quantity") > 40, "length_clamped").when((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.04), "safe_combined").otherwise("individual_only")
    most = F.when(F.col("l_returnflag") == "A", F.floor(F.col("top") / F.col("c"))).when(F.col("l_returnflag") == "N", shifted).otherwise(F.col("top") - F.col("c"))
    return li.withColumns({"top": top, "c": c}).select("l_orderkey", n.cast("long"), most.cast("long").alias("most"), status.alias("status"))


@audit(
    "G19 C16",
    f"""WITH {FACTS}, w AS (SELECT * FROM facts WHERE kind = 'write'), a AS (SELECT node_id, name, min(bound) AS capacity, min(line) AS line FROM facts WHERE kind = 'allocation' GROUP BY 1, 2), l AS (SELECT DISTINCT node_id, name FROM facts WHERE kind = 'loop'), g AS (SELECT DISTINCT node_id, name FROM facts WHERE kind = 'guard')
SELECT w.fact_id, w.name, w.line, w.bound, concat_ws(',', CASE WHEN a.capacity * 2 < w.bound AND g.name IS NULL THEN 'overflow_to_size' END, CASE WHEN l.name IS NOT NULL AND g.name IS NULL THEN 'offset_plus_length' END, CASE WHEN w.bound > a.capacity THEN 'copy_mismatch' END, CASE WHEN w.line < a.line THEN 'use_outside_lifetime' END) AS findings FROM w LEFT JOIN a USING (node_id, name) LEFT JOIN l USING (node_id, name) LEFT JOIN g USING (node_id, name)""",
)
def static_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over the facts of one variable: sizes that overflow, unguarded offsets, copies beyond the capacity, lifetimes."""
    f, key = facts(spark, d), ["node_id", "name"]
    # What is known of a variable as one row, so that a task sorts and aggregates once for all kinds of facts.
    of = lambda k, c: F.min(F.when(F.col("kind") == k, F.col(c) if isinstance(c, str) else c))
    known = f.filter("kind <> 'write'").groupBy(*key).agg(of("allocation", "bound").alias("capacity"), of("allocation", "line").alias("since"), *[of(k, F.lit(True)).alias(k) for k in ("loop", "guard")])
    w = f.filter("kind = 'write'").select("fact_id", *key, "line", "bound").join(known, key, "left")
    bare = F.col("guard").isNull()
    rules = [("overflow_to_size", (F.col("capacity") * 2 < F.col("bound")) & bare), ("offset_plus_length", F.col("loop").isNotNull() & bare), ("copy_mismatch", F.col("bound") > F.col("capacity")), ("use_outside_lifetime", F.col("line") < F.col("since"))]
    return w.select("fact_id", "name", "line", "bound", F.concat_ws(",", *[F.when(c, n) for n, c in rules]).alias("findings"))
