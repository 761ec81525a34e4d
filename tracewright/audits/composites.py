"""Composite pipelines: packing of ranked contexts, eligibility, request resolution, plans, frozen checks, minimisation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.audits.metrics import ids, tally
from tracewright.audits.registry import FACTS, FOUND, QUERIES, RUNS, SQL, WORK, audit, facts, found, runs, work
from tracewright.functions import scalars as S
from tracewright.operators import ranking as R
from tracewright.operators.aggregates import digest_tree
from tracewright.sources.tables import table


@audit(
    "W6",
    """SELECT doc_id, before, before + n_chars <= 20000 AS fits FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents)""",
)
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """The bytes ahead of a document in its group, and whether it ends within the budget."""
    out = R.within_budget(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.col("doc_id")], "n_chars", 20000)
    return out.select("doc_id", "before", "fits")


def next_fit_packs(df: DataFrame, key: str, order: list[str], size: str, capacity: int, separator: int, most: int) -> DataFrame:
    """Adds pack (null if left out) and reason: each row goes to the current pack if it fits, else to a new one, until most
    packs are begun; rows larger than a pack, and those after the last pack, are left out and named. Folded as a stream."""
    schema = df.schema.add("pack", "long").add("reason", "string")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pack, used, over = object(), -1, capacity, False
        for frame in batches:
            packs, reasons = [], []
            for k, n in zip(frame[key], frame[size], strict=True):
                if k != last:
                    last, pack, used, over = k, -1, capacity, False
                if n > capacity:
                    packs.append(None)
                    reasons.append("too_large")
                    continue
                if pack >= 0 and used + separator + n <= capacity and not over:
                    used += separator + int(n)
                elif pack + 1 < most and not over:
                    pack, used = pack + 1, int(n)
                else:
                    over = True
                    packs.append(None)
                    reasons.append("max_packs")
                    continue
                packs.append(pack)
                reasons.append(None)
            yield frame.assign(pack=pd.Series(packs, index=frame.index, dtype="Int64"), reason=pd.Series(reasons, index=frame.index, dtype=object))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


@audit(
    "O29",
    """WITH RECURSIVE p AS (SELECT source || '/' || lang AS k, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY doc_id) AS i FROM documents WHERE source || '/' || lang IS NOT NULL),
r AS (SELECT k, doc_id, i, n, CASE WHEN n > 4000 THEN -1 ELSE 0 END AS pack, CASE WHEN n > 4000 THEN 4000 ELSE n END AS used, false AS over, CASE WHEN n > 4000 THEN 'too_large' END AS reason FROM p WHERE i = 1
UNION ALL SELECT p.k, p.doc_id, p.i, p.n, CASE WHEN big OR stop THEN pack WHEN fits THEN pack ELSE pack + 1 END, CASE WHEN big OR stop THEN used WHEN fits THEN used + 2 + p.n ELSE p.n END, over OR (NOT big AND stop), CASE WHEN big THEN 'too_large' WHEN stop THEN 'max_packs' END FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1, LATERAL (SELECT p.n > 4000 AS big, pack >= 0 AND used + 2 + p.n <= 4000 AND NOT over AS fits) x, LATERAL (SELECT NOT fits AND (over OR pack + 1 >= 3) AS stop) y)
SELECT k, doc_id, CASE WHEN reason IS NULL THEN pack END::BIGINT AS pack, reason FROM r""",
)
def context_packs(spark: SparkSession, d: str) -> DataFrame:
    """Ranked contexts in at most three packs of 4,000 with two bytes between them, and those left out."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("k"), "doc_id", "n_chars").filter("k is not null")
    return next_fit_packs(docs, "k", ["doc_id"], "n_chars", 4000, 2, 3).select("k", "doc_id", "pack", "reason")


OMISSIONS = ["coverage_missing", "not_selected", "empty_text", "stub", "unknown_fraction", "not_reachable", "no_memory_evidence"]


@audit(
    "P14",
    """WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_tax > 0.07) AS unknown, count(*) FILTER (l_quantity > 25) AS memory, sum(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'coverage_missing' WHEN o_orderstatus = 'P' AND o_orderpriority > '4' THEN 'not_selected' WHEN bytes = 0 THEN 'empty_text' WHEN n <= 2 AND bytes < 60 AND memory = 0 THEN 'stub' WHEN unknown * 2 > n THEN 'unknown_fraction' WHEN o_totalprice < 2000 THEN 'not_reachable' WHEN memory = 0 THEN 'no_memory_evidence' END AS omitted FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def hunt_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fails names why a function is left out; null if it is eligible."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), tally(F.col("l_tax") > 0.07, "unknown"), tally(F.col("l_quantity") > 25, "memory"), F.sum("l_quantity").cast("long").alias("bytes"))
    o = table(spark, d, "orders").join(c, "o_orderkey", "left")
    conditions = [F.col("n").isNull(), (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") > "4"), F.col("bytes") == 0, (F.col("n") <= 2) & (F.col("bytes") < 60) & (F.col("memory") == 0), F.col("unknown") * 2 > F.col("n"), F.col("o_totalprice") < 2000, F.col("memory") == 0]
    return o.select("o_orderkey", S.first_reason(*zip(OMISSIONS, conditions, strict=True)).alias("omitted"))


@audit(
    "G26",
    f"""WITH {FACTS}, q AS (SELECT event_id, user_id, json_extract(props, '$.k')::BIGINT + 1 AS node, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type, json_extract(props, '$.k') ORDER BY ts, event_id) AS again, row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k') ORDER BY ts, event_id) AS nth FROM events), f AS (SELECT node_id AS node, count(*) AS facts, count(*) FILTER (kind = 'guard') AS guards FROM facts GROUP BY 1)
SELECT event_id, CASE WHEN again > 1 THEN 'duplicate' WHEN kind = 'click' AND nth > 1 THEN 'circular' WHEN f.node IS NULL THEN 'outside_image' WHEN kind = 'view' AND guards = 0 THEN 'unknown_block' WHEN kind = 'signup' AND facts < 3 THEN 'unknown_address' ELSE 'resolved' END AS outcome, CASE WHEN again = 1 AND NOT (kind = 'click' AND nth > 1) THEN coalesce(facts, 0) ELSE 0 END AS facts FROM q LEFT JOIN f USING (node)""",
)
def context_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for context: the first rejection that holds, in order, or what resolves them."""
    k = F.get_json_object("props", "$.k").cast("long")
    q = table(spark, d, "events").select("event_id", "user_id", "ts", (k + 1).alias("node"), F.col("event_type").alias("kind"))
    q = R.ranked(R.ranked(q, ["user_id", "kind", "node"], [F.col("ts"), F.col("event_id")], "again"), ["user_id", "node"], [F.col("ts"), F.col("event_id")], "nth")
    f = facts(spark, d).groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("facts"), tally(F.col("kind") == "guard", "guards"))
    q = q.join(f, "node", "left")
    again, circular = F.col("again") > 1, (F.col("kind") == "click") & (F.col("nth") > 1)
    rules = [("duplicate", again), ("circular", circular), ("outside_image", F.col("facts").isNull()), ("unknown_block", (F.col("kind") == "view") & (F.col("guards") == 0)), ("unknown_address", (F.col("kind") == "signup") & (F.col("facts") < 3))]
    zero = F.lit(0).cast("long")
    return q.select("event_id", F.coalesce(S.first_reason(*rules), F.lit("resolved")).alias("outcome"), F.when(~again & ~circular, F.coalesce("facts", zero)).otherwise(zero).alias("facts"))


@audit(
    "G27 C13",
    f"""WITH {FACTS}, c AS (SELECT node_id, count(*) AS n, count(DISTINCT name) AS names, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, greatest(count(*) - 4, 0) AS omitted FROM facts GROUP BY 1) SELECT node_id, '{{"root":' || node_id || ',"facts":' || least(n, 4) || ',"variables":' || names || ',"kinds":"' || kinds || '","omitted":' || omitted || '}}' AS capsule, omitted = 0 AND contains(kinds, 'write') AS complete FROM c""",
)
def evidence_capsules(spark: SparkSession, d: str) -> DataFrame:
    """A root's facts, variables and omissions as one record, complete if nothing was left out and a write is in it."""
    c = facts(spark, d).groupBy("node_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("variables"), ids("kind").alias("kinds"))
    omitted = F.greatest(F.col("n") - 4, F.lit(0))
    record = F.struct(F.col("node_id").alias("root"), F.least(F.col("n"), F.lit(4)).alias("facts"), "variables", "kinds", omitted.alias("omitted"))
    return c.select("node_id", F.to_json(record).alias("capsule"), ((omitted == 0) & F.col("kinds").contains("write")).alias("complete"))


@audit(
    "C12 C14",
    """WITH c AS (SELECT user_id, json_extract(props, '$.k')::BIGINT AS signature, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS representative FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY errors DESC, n DESC, signature) AS place FROM c WHERE errors > 0)
SELECT user_id, signature, place, representative, CASE WHEN place <= 3 THEN 'session_' || place ELSE 'deferred' END AS slot, 'work_' || left(sha256(user_id || ':' || signature), 12) AS work_id FROM r""",
)
def crash_plan(spark: SparkSession, d: str) -> DataFrame:
    """Observations to clusters, clusters to ranks, ranks to work items: three sessions each, the rest deferred."""
    e = table(spark, d, "events").withColumn("signature", F.get_json_object("props", "$.k").cast("long"))
    c = e.groupBy("user_id", "signature").agg(F.count("*").alias("n"), tally(F.col("event_type") == "error", "errors"), F.min("event_id").alias("representative")).filter("errors > 0")
    r = R.ranked(c, ["user_id"], [F.desc("errors"), F.desc("n"), F.col("signature")], "place")
    slot = F.when(F.col("place") <= 3, F.concat(F.lit("session_"), F.col("place").cast("string"))).otherwise("deferred")
    return r.select("user_id", "signature", "place", "representative", slot.alias("slot"), F.concat(F.lit("work_"), F.substring(F.sha2(F.concat_ws(":", "user_id", "signature"), 256), 1, 12)).alias("work_id"))


_CHECKS = "count(*) > 0 AS has_findings, bool_and(session_index <= 7) AS within_sessions, bool_or(target_match) AS target_admitted, bool_or(target_match AND state = 'reportable') AS target_reported, count(DISTINCT candidate_id) = count(*) AS canonical"


@audit("C23 C24", f"WITH {FOUND}, c AS (SELECT run_id, {_CHECKS} FROM found GROUP BY 1) SELECT *, has_findings AND within_sessions AND target_admitted AND target_reported AND canonical AS passed FROM c")
def frozen_checks(spark: SparkSession, d: str) -> DataFrame:
    """Named checks of a frozen run, and whether all hold."""
    every, some = (lambda c: F.min(c.cast("int")) == 1), (lambda c: F.max(c.cast("int")) == 1)
    hit = F.col("target_match")
    c = found(spark, d).groupBy("run_id").agg((F.count("*") > 0).alias("has_findings"), every(F.col("session_index") <= 7).alias("within_sessions"), some(hit).alias("target_admitted"), some(hit & (F.col("state") == "reportable")).alias("target_reported"), (F.countDistinct("candidate_id") == F.count("*")).alias("canonical"))
    names = ["has_findings", "within_sessions", "target_admitted", "target_reported", "canonical"]
    return c.withColumn("passed", F.expr(" and ".join(names)))


def _seal_sql(source: str, key: str, id: str, entry: str) -> str:
    """The root of ``digest_tree`` over a source's entries."""
    digest = lambda e, i: f"sha256(string_agg({e}, chr(10) ORDER BY {i})) AS e"
    leaves = f"SELECT {key}, {id} // 4096 AS i, {digest(entry, id)} FROM {source} GROUP BY 1, 2"
    return f"SELECT {key}, {digest('e', 'i')} FROM (SELECT {key}, i // 4096 AS i, {digest('e', 'i')} FROM ({leaves}) GROUP BY 1, 2) GROUP BY 1"


_SECOND = "work_id || ':' || CASE status WHEN 'done' THEN 'completed' WHEN 'running' THEN 'budget_limited' ELSE CASE WHEN risk >= 4 THEN 'invalid' ELSE 'interrupted' END END || ':' || input"


@audit(
    "C25 C26 A32",
    f"""WITH {RUNS}, {WORK}, w AS (SELECT work.*, input_tokens AS input FROM work JOIN runs ON run_id = work_id), s AS ({_seal_sql("runs", "case_id", "run_id", "run_id || ':' || outcome || ':' || input_tokens")}), t AS ({_seal_sql("w", "family", "work_id", _SECOND)}), c AS (SELECT case_id, count(*) AS n FROM runs GROUP BY 1)
SELECT c.case_id, n, s.e AS seal, s.e = t.e AS repeats FROM c JOIN s USING (case_id) JOIN t ON family = case_id""",
)
def double_run(spark: SparkSession, d: str) -> DataFrame:
    """A case analysed twice from different projections: the roots of the digests of its sorted entries must be equal."""
    r = runs(spark, d)
    n = r.groupBy("case_id").agg(F.count("*").alias("n"))
    first = digest_tree(r, ["case_id"], "run_id", F.concat_ws(":", "run_id", "outcome", "input_tokens"), "seal")
    w = work(spark, d).join(r.select(F.col("run_id").alias("work_id"), "input_tokens"), "work_id")
    outcome = F.when(F.col("status") == "done", "completed").when(F.col("status") == "running", "budget_limited").when(F.col("risk") >= 4, "invalid").otherwise("interrupted")
    second = digest_tree(w, ["family"], "work_id", F.concat_ws(":", "work_id", outcome, "input_tokens"), "other").withColumnRenamed("family", "case_id")
    return n.join(first, "case_id").join(second, "case_id").select("case_id", "n", "seal", (F.col("seal") == F.col("other")).alias("repeats"))


def minimised(payload: bytes, oracle: Callable[[bytes], bool], most: int = 200, protected: int = 0) -> tuple[bytes, int]:
    """A shorter payload that the oracle still accepts, and the attempts used: ever smaller parts behind the protected
    prefix are left out as long as the oracle accepts what remains (delta debugging)."""
    head, body, parts, attempts = payload[:protected], payload[protected:], 2, 0
    while len(body) >= 2 and attempts < most:
        size = -(-len(body) // parts)
        for at in range(0, len(body), size):
            rest = body[:at] + body[at + size :]
            attempts += 1
            if oracle(head + rest):
                body, parts = rest, max(2, parts - 1)
                break
            if attempts >= most:
                break
        else:
            if size == 1:
                break
            parts = min(len(body), 2 * parts)
    return head + body, attempts


@audit("O38 E3", None)
def minimised_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each error's properties reduced to the bytes that keep its signature (its digits); the oracle is a callback."""

    def signature(payload: bytes) -> bytes:
        return hashlib.sha256(bytes(b for b in payload if 48 <= b < 58)).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for event_id, props in zip(frame["event_id"], frame["props"], strict=True):
                raw = (props or "").encode()
                small, attempts = minimised(raw, lambda x, want=signature(raw): signature(x) == want, protected=1)
                out.append((event_id, small.decode(errors="replace"), len(raw), attempts))
            yield pd.DataFrame(out, columns=["event_id", "minimal", "size", "attempts"])

    errors = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "props")
    return errors.mapInPandas(run, "event_id long, minimal string, size long, attempts long")


STEPS = {"filter": [], "rank": ["filter"], "scope": ["filter"], "plan": ["rank", "scope"], "hunt": ["plan"], "verify": ["hunt"], "review": ["verify"], "report": ["review", "verify"]}


@audit(
    "E1 E5 E6",
    f"""WITH {WORK}, s AS (SELECT * FROM (VALUES ('filter', 1), ('rank', 2), ('scope', 3), ('plan', 4), ('hunt', 5), ('verify', 6), ('review', 7), ('report', 8)) v(step, place)) SELECT work_id, step, place::BIGINT AS place, CASE WHEN status = 'done' THEN 'done' WHEN status = 'running' AND place <= 4 THEN 'done' WHEN status = 'running' AND place = 5 THEN 'ready' WHEN status = 'pending' AND place = 1 THEN 'ready' ELSE 'blocked' END AS state FROM work, s WHERE required""",
)
def step_plan(spark: SparkSession, d: str) -> DataFrame:
    """The steps of required work in an order that respects their dependencies, and what each may do now."""
    order: list[str] = []
    while len(order) < len(STEPS):
        order += [s for s, needs in STEPS.items() if s not in order and all(n in order for n in needs)][:1]
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(k + 1).cast("long").alias("place")) for k, s in enumerate(order)]))
    w = work(spark, d).filter("required").select("work_id", "status", steps.alias("x")).select("work_id", "status", "x.*")
    running = F.col("status") == "running"
    state = F.when((F.col("status") == "done") | running & (F.col("place") <= 4), "done").when(running & (F.col("place") == 5) | (F.col("status") == "pending") & (F.col("place") == 1), "ready").otherwise("blocked")
    return w.select("work_id", "step", "place", state.alias("state"))


#: Seed builders: kind, query, and the key=value facts that its rows give.
SEEDS = [
    ("capacity", "capacity_chains", "allocation", {"guard": "guard", "signal": "signal", "score": "score"}),
    ("initialisation", "partial_initialisation", "allocation", {"consumers": "consumers", "disclosed": "disclosed"}),
    ("static", "static_findings", "fact_id", {"line": "line", "findings": "findings"}),
    ("cursor", "nearest_loop", "fact_id", {"loop": "loop_id"}),
    ("length", "nearest_length_check", "fact_id", {"check": "check_id", "distance": "distance"}),
    ("format", "format_width", "p_partkey", {"dynamic": "dynamic", "guard": "guard"}),
    ("closure", "guarded_allocations", "node_id", {"seed": "seed", "reached": "reached"}),
]


def _seed_sql() -> str:
    def facts_of(pairs: dict[str, str]) -> str:
        return " || ';' || ".join(f"'{k}=' || coalesce({c}::VARCHAR, 'none')" for k, c in pairs.items())

    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS id, {facts_of(pairs)} AS facts FROM ({SQL[name]})" for kind, name, key, pairs in SEEDS)


@audit("A8 U5", _seed_sql())
def obligation_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Chains, facts and checks as obligations' seeds: a kind, an id and structural facts as key=value."""
    out = None
    for kind, name, key, pairs in SEEDS:
        parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for k, c in pairs.items()]
        seeds = QUERIES[name](spark, d).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat_ws(";", *parts).alias("facts"))
        out = seeds if out is None else out.unionByName(seeds)
    return out


_GRAPH = [("node", "symbol_rows", "symbol || ':' || file"), ("macro", "symbol_rows", "macro || '=' || value"), ("include", "symbol_rows", "include || ':' || file"), ("fact", "source_facts", "fact_id"), ("read", "pointer_reads", "file || ':' || most_index")]


@audit("S8", " UNION ALL ".join(f"SELECT '{kind}' AS \"table\", {row}::VARCHAR AS row FROM ({SQL[name]})" for kind, name, row in _GRAPH))
def source_graph(spark: SparkSession, d: str) -> DataFrame:
    """All fact tables of the source files as one: each row with the table that it belongs to."""
    tables = [QUERIES[name](spark, d).select(F.lit(kind).alias("table"), F.expr(f"cast({row} as string)").alias("row")) for kind, name, row in _GRAPH]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
