"""Keyed stores, transition logs, leases and queues, as plans over stored rows and incoming ones.

A store is a table with a key; a write is a plan that gives the table's next state and what happened to each incoming row.
Both sides meet in one join on the key. Requests of one batch that touch the same key are decided in their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.audits.metrics import ids, tally
from tracewright.audits.registry import FOUND, WORK, audit, found, work
from tracewright.operators import ranking as R
from tracewright.operators.folds import ordered_fold
from tracewright.sources.tables import put_content, table
from tracewright.streaming.leases import task_log
from tracewright.streaming.states import FINDING_EDGES, FINDING_STATES, RUN_EDGES, RUN_STATES

def payload_digest(*columns: str) -> Column:
    """Null and the empty text differ: a null field isn't in the JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def upsert_immutable(existing: DataFrame, incoming: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Incoming rows by key with outcome: created, unchanged (equal to what is stored) or conflict.

    Rows of one key that differ among themselves are a conflict as well.
    """
    a = existing.select(*key, payload_digest(*payload).alias("_a")).distinct()
    b = incoming.select(*key, payload_digest(*payload).alias("_b")).groupBy(*key).agg(F.min("_b").alias("_b"), F.countDistinct("_b").alias("_n"))
    rule = F.when(F.col("_n") > 1, "conflict").when(F.col("_a").isNull(), "created").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("conflict")
    return b.join(a, list(key), "left").select(*key, rule.alias("outcome"))


@audit(
    "K2",
    """SELECT doc_id, CASE WHEN b.lang IS NULL THEN 'created' WHEN a.source || a.n_chars = b.source || b.n_chars THEN 'unchanged' ELSE 'conflict' END AS outcome FROM (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'other' ELSE source END AS source, n_chars FROM documents) a LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') b USING (doc_id)""",
)
def immutable_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    incoming = docs.withColumn("source", F.when(F.col("n_chars") > 2000, "other").otherwise(F.col("source")))
    return upsert_immutable(docs.filter("lang <> 'fr'"), incoming, ["doc_id"], ["source", "n_chars"])


@audit(
    "K3",
    f"""WITH {FOUND}, i AS (SELECT *, sha256(candidate_id || '|' || target_id) AS fingerprint, row_number() OVER (PARTITION BY hunter, sha256(candidate_id || '|' || target_id) ORDER BY observed, run_id, session_index) AS n FROM found)
SELECT hunter, fingerprint, min(run_id) FILTER (n = 1) AS stored, count(*) FILTER (n = 1) AS created, count(*) FILTER (n > 1) AS deduplicated FROM i GROUP BY 1, 2""",
)
def finding_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A finding is stored once by task and fingerprint, the first that comes; later ones return the stored row."""
    f = found(spark, d).withColumn("fingerprint", F.sha2(F.concat_ws("|", "candidate_id", "target_id"), 256))
    out = f.groupBy("hunter", "fingerprint").agg(F.min(F.struct("observed", "run_id", "session_index")).alias("first"), F.count("*").alias("n"))
    return out.select("hunter", "fingerprint", F.col("first.run_id").alias("stored"), F.lit(1).cast("long").alias("created"), (F.col("n") - 1).alias("deduplicated"))


class Transitions:
    """The state of one entity and what its idempotency keys stand for."""

    def __init__(self, key: str, target: str, edges: frozenset, state: str):
        self.key, self.target, self.edges, self.state, self.used, self.place = key, target, edges, state, {}, -1

    def step(self, row: dict) -> list[tuple]:
        key, target, before = row[self.key], row[self.target], self.state
        self.place += 1
        if key in self.used:
            outcome = "replayed" if self.used[key] == target else "key_conflict"
        elif (before, target) in self.edges:
            outcome = "applied"
            self.state = self.used[key] = target
        else:
            outcome = "illegal"
        return [(self.place, key, target, before, self.state, outcome)]

    def end(self) -> list[tuple]:
        return []


def apply_transitions(requests: DataFrame, entity: str, order: Sequence[str], key: str, target: str, edges: Iterable[tuple[str, str]], start: str) -> DataFrame:
    """Requests in order with outcome (applied, replayed, key_conflict or illegal), from_state and the state after each.

    The first applied request of an idempotency key decides what the key stands for; another target under it is a conflict.
    What a request does depends on all before it: an ordered fold, which holds one entity's state and no log.
    """
    allowed = frozenset(edges)
    rows = requests.select(entity, *order, key, target)
    return ordered_fold(rows, [entity], order, lambda: Transitions(key, target, allowed, start), "place long, key string, target string, from_state string, state string, outcome string")


_LOG_TARGETS = {"view": "statically_supported", "click": "poc_ready", "purchase": "reproduction_pending"}


@audit("K4 K5", None)
def transition_log(spark: SparkSession, d: str) -> DataFrame:
    """Whether a request applies depends on which of those before it did; the test has a plain loop."""
    wanted = F.element_at(F.array(*[F.lit(n) for n in FINDING_STATES]), (1 + F.get_json_object("props", "$.k").cast("int") % len(FINDING_STATES)))
    target = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _LOG_TARGETS.items()], wanted)
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("finding"), "ts", "event_id", F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string")).alias("key"), target.alias("target"))
    return apply_transitions(e, "finding", ["ts", "event_id"], "key", "target", FINDING_EDGES, "hypothesis")


def _values(rows: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


_RUN_STEP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END"


@audit(
    "X7",
    f"""WITH edges(a, b) AS (VALUES {_values(RUN_EDGES)}), names(i, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(RUN_STATES))}),
e AS (SELECT user_id, event_id, ts, least(9, sum({_RUN_STEP}) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS i, event_type = 'error' AND json_extract(props, '$.k')::BIGINT % 2 = 0 AS stops FROM events),
s AS (SELECT user_id, event_id, ts, name AS state FROM e JOIN names ON names.i = CASE WHEN stops THEN 11 ELSE e.i END), t AS (SELECT *, lag(state) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS before FROM s)
SELECT t.user_id, t.event_id, before AS from_state, state AS to_state, edges.a IS NOT NULL AS legal FROM t LEFT JOIN edges ON a = before AND b = state WHERE before IS NOT NULL AND before <> state""",
)
def run_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a run's state, judged by the table of allowed ones; runs are a user's weeks, whose events advance them."""
    w = W.partitionBy("user_id", F.date_trunc("week", "ts")).orderBy("ts", "event_id")
    step = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    stops = (F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("long") % 2 == 0)
    at = F.when(stops, 11).otherwise(F.least(F.lit(9), F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))))
    s = table(spark, d, "events").withColumn("to_state", F.element_at(F.array(*[F.lit(n) for n in RUN_STATES]), (at + 1).cast("int")))
    t = s.withColumn("from_state", F.lag("to_state").over(w)).filter("from_state <> to_state")
    legal = F.concat_ws(">", "from_state", "to_state").isin([f"{a}>{b}" for a, b in RUN_EDGES])
    return t.select("user_id", "event_id", "from_state", "to_state", legal.alias("legal"))


@audit(
    "K6",
    f"""WITH {WORK} SELECT family, component, arg_min(hunter, work_id) FILTER (status = 'done') AS snapshot, count(DISTINCT hunter) FILTER (status = 'done') > 1 AS refused, string_agg(DISTINCT campaign, ',' ORDER BY campaign) AS evidence FROM work GROUP BY 1, 2""",
)
def attach_once(spark: SparkSession, d: str) -> DataFrame:
    """A field that may be set once keeps its first value and refuses another; evidence ids are merged."""
    done = F.col("status") == "done"
    first = F.min(F.when(done, F.struct("work_id", "hunter")))
    return work(spark, d).groupBy("family", "component").agg(first.alias("f"), (F.countDistinct(F.when(done, F.col("hunter"))) > 1).alias("refused"), ids("campaign").alias("evidence")).select("family", "component", F.col("f.hunter").alias("snapshot"), "refused", "evidence")


def get_content(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content by digest, verified: state found, missing or corrupt (its digest is another)."""
    ok = F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256)) == F.col("digest")
    out = wanted.join(stored.select("digest", "content"), "digest", "left")
    return out.withColumn("state", F.when(F.col("content").isNull(), "missing").when(ok, "found").otherwise("corrupt"))


@audit(
    "K8",
    """WITH s AS (SELECT DISTINCT 'sha256:' || sha256(text) AS digest FROM documents WHERE text IS NOT NULL), bad AS (SELECT 'sha256:' || sha256(text) AS digest FROM documents WHERE n_chars < 60) SELECT item_id, CASE WHEN s.digest IS NULL THEN 'missing' WHEN b.digest IS NOT NULL THEN 'corrupt' ELSE 'found' END AS state FROM (SELECT doc_id AS item_id, 'sha256:' || sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS digest FROM documents WHERE text IS NOT NULL) w LEFT JOIN s USING (digest) LEFT JOIN (SELECT DISTINCT digest FROM bad) b USING (digest)""",
)
def content_reads(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    stored = put_content(docs, "text").withColumn("content", F.when(F.length("content") < 60, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    asked = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    wanted = docs.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("sha256:"), F.sha2(asked, 256)).alias("digest"))
    return get_content(stored, wanted).select("item_id", "state")


def task_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of ``streaming.leases``: a run is a user, a task_key one of its weeks, and an event's type an action.

    A worker claims the lease that its latest acquire of the task asked for; every seventh event claims another.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    is_ = lambda kind: F.col("event_type") == kind
    action = F.when(is_("view"), "acquire").when(is_("click"), "beat").when(is_("purchase"), "finish").when(is_("error"), "sweep").when(k % 2 == 0, "defer").otherwise("requeue")
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("task_key"), F.when(k % 3 == 0, "review").otherwise("hunt").alias("task_type"), F.col("ts").alias("at"), "event_id", k.alias("k"), action.alias("action"))
    mine = W.partitionBy("run_id", "task_key", "task_type").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    claim = F.last(F.when(F.col("action") == "acquire", F.col("event_id")), ignorenulls=True).over(mine)
    e = e.withColumn("claim", F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(F.coalesce(claim, F.lit(-1))))
    finish, target = F.col("action") == "finish", F.element_at(F.array(*[F.lit(t) for t in _LEASE_TARGETS]), (1 + F.col("k") % len(_LEASE_TARGETS)).cast("int"))
    requests = e.select(
        "run_id", "task_key", "task_type", "at", F.lpad(F.col("event_id").cast("string"), 19, "0").alias("request_id"), "action",
        F.concat(F.lit("w"), (F.col("claim") % 5).cast("string")).alias("worker"), F.concat(F.lit("t"), F.col("claim").cast("string")).alias("token"),
        F.lit(None).cast("long").alias("attempt"), F.lit(172_800).cast("long").alias("seconds"),
        F.when(finish, F.when(F.col("k") % 4 == 0, "running").otherwise("completed")).alias("status"), F.when(F.col("action") == "defer", F.when(F.col("k") % 10 == 0, " ").otherwise("budget")).alias("error"),
        F.when(finish & (F.col("k") % 2 == 1), target).alias("target"), F.concat(F.lit("i"), (F.col("event_id") % 2).cast("string")).alias("key"),
    )
    kinds = F.explode(F.array(F.lit("hunt"), F.lit("review"))).alias("task_type")
    made = requests.groupBy("run_id", "task_key").agg(F.min("at").alias("at")).select("run_id", "task_key", kinds, "at")
    made = made.select("*", F.lit("").alias("request_id"), F.lit("enqueue").alias("action"), *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in requests.columns[6:]])
    return made.union(requests)


_LEASE_TARGETS = ["statically_supported", "poc_ready", "environment_blocked", "rejected", "reportable"]
# The state of both tasks of a unit as structs; one round of the recursion applies the n-th request of every unit.
_TASK0 = "{'status': 'pending', 'attempt': 1::BIGINT, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': NULL::VARCHAR}"
_LEASES = f"""edges(a, b) AS (VALUES {_values(FINDING_EDGES)}), pairs AS (SELECT list(a || '>' || b) AS allowed FROM edges),
q0 AS (SELECT user_id AS run_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS task_key, CASE WHEN json_extract(props, '$.k')::BIGINT % 3 = 0 THEN 'review' ELSE 'hunt' END AS task_type, ts, event_id, json_extract(props, '$.k')::BIGINT AS k,
  CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'beat' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'sweep' ELSE CASE WHEN json_extract(props, '$.k')::BIGINT % 2 = 0 THEN 'defer' ELSE 'requeue' END END AS action FROM events),
q1 AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN event_id ELSE coalesce(last_value(CASE WHEN action = 'acquire' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, task_key, task_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) END AS claim, row_number() OVER (PARTITION BY run_id, task_key ORDER BY ts, event_id) AS n FROM q0),
q AS (SELECT *, 'w' || (claim % 5) AS worker, 't' || claim AS token, CASE WHEN action = 'finish' AND k % 2 = 1 THEN (['statically_supported', 'poc_ready', 'environment_blocked', 'rejected', 'reportable'])[1 + k % 5] END AS target, 'i' || (event_id % 2) AS key FROM q1),
s AS (SELECT run_id, task_key, 0::BIGINT AS n, {_TASK0} AS hunt, {_TASK0} AS review, 'hypothesis' AS finding, NULL::VARCHAR AS i0, NULL::VARCHAR AS i1, NULL::BIGINT AS event_id, NULL::VARCHAR AS task_type, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT run_id, task_key FROM q)
UNION ALL SELECT run_id, task_key, n, CASE task_type WHEN 'hunt' THEN after ELSE hunt END, CASE task_type WHEN 'review' THEN after ELSE review END, CASE WHEN moves THEN target ELSE finding END, CASE WHEN moves AND key = 'i0' THEN target ELSE i0 END, CASE WHEN moves AND key = 'i1' THEN target ELSE i1 END, event_id, task_type, action, outcome FROM (
  SELECT *, outcome = 'finished' AND target IS NOT NULL AND had IS NULL AS moves, CASE
    WHEN outcome IN ('acquired', 'reacquired') THEN {{'status': 'running', 'attempt': t.attempt + (outcome = 'reacquired')::BIGINT, 'worker': worker, 'token': token, 'expires': ts + INTERVAL 48 HOUR, 'error': NULL::VARCHAR}}
    WHEN outcome = 'exhausted' THEN {{'status': 'failed', 'attempt': t.attempt, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': 'worker lease expired; attempts exhausted'}}
    WHEN outcome = 'requeued' THEN {{'status': 'pending', 'attempt': t.attempt + 1, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': 'worker lease expired'}}
    WHEN outcome = 'extended' THEN {{'status': t.status, 'attempt': t.attempt, 'worker': t.worker, 'token': t.token, 'expires': ts + INTERVAL 48 HOUR, 'error': t.error}}
    WHEN outcome = 'finished' THEN {{'status': 'completed', 'attempt': t.attempt, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': NULL::VARCHAR}}
    WHEN outcome = 'deferred' THEN {{'status': 'budget_deferred', 'attempt': t.attempt, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': 'budget'}}
    WHEN outcome = 'returned' THEN {{'status': 'pending', 'attempt': t.attempt, 'worker': NULL::VARCHAR, 'token': NULL::VARCHAR, 'expires': NULL::TIMESTAMP, 'error': NULL::VARCHAR}} ELSE t END AS after FROM (
    SELECT *, CASE action
      WHEN 'acquire' THEN CASE WHEN t.status = 'pending' THEN 'acquired' WHEN t.status <> 'running' THEN 'not_pending' WHEN NOT late THEN 'held' WHEN t.attempt >= 3 THEN 'exhausted' ELSE 'reacquired' END
      WHEN 'beat' THEN CASE WHEN live THEN 'extended' ELSE 'lost' END
      WHEN 'finish' THEN CASE WHEN k % 4 = 0 THEN 'bad_request' WHEN NOT live THEN 'lost' WHEN target IS NULL OR had = target THEN 'finished' WHEN had IS NOT NULL THEN 'key_conflict' WHEN NOT list_contains(allowed, finding || '>' || target) THEN 'illegal_transition' ELSE 'finished' END
      WHEN 'sweep' THEN CASE WHEN NOT late THEN 'kept' WHEN t.attempt >= 3 THEN 'exhausted' ELSE 'requeued' END
      WHEN 'defer' THEN CASE WHEN k % 10 = 0 THEN 'bad_request' WHEN t.status = 'pending' THEN 'deferred' ELSE 'refused' END
      ELSE CASE WHEN t.status = 'budget_deferred' THEN 'returned' ELSE 'refused' END END AS outcome FROM (
      SELECT *, t.status = 'running' AND t.expires <= ts AS late, coalesce(t.status = 'running' AND t.worker = worker AND t.token = token AND t.expires > ts, false) AS live FROM (
        SELECT s.run_id, s.task_key, q.n, hunt, review, finding, i0, i1, q.event_id, q.task_type, q.action, q.ts, q.k, q.worker, q.token, q.target, q.key, CASE q.key WHEN 'i0' THEN i0 ELSE i1 END AS had, CASE q.task_type WHEN 'hunt' THEN hunt ELSE review END AS t, allowed
        FROM s JOIN q ON q.run_id = s.run_id AND q.task_key = s.task_key AND q.n = s.n + 1 CROSS JOIN pairs))))),
leases AS (SELECT run_id, task_key, task_type, n, event_id, action, outcome, finding, CASE task_type WHEN 'hunt' THEN hunt ELSE review END AS t FROM s WHERE n > 0)"""


def leases(spark: SparkSession, d: str) -> DataFrame:
    return task_log(task_requests(spark, d)).filter("action <> 'enqueue'").withColumn("event_id", F.col("request_id").cast("long"))


@audit("X4 X6", f"WITH RECURSIVE {_LEASES} SELECT run_id, task_key, task_type, event_id, action, outcome, t.status AS status, t.attempt AS attempt, t.token AS token, t.expires AS expires, finding, t.error AS error FROM leases")
def task_leases(spark: SparkSession, d: str) -> DataFrame:
    """What each request does to its task and finding: leases by token and expiry, attempts, deferrals, joint transitions."""
    return leases(spark, d).select("run_id", "task_key", "task_type", "event_id", "action", "outcome", "status", "attempt", "token", "expires", "finding", "error")


@audit("X2", f"WITH RECURSIVE {_LEASES} SELECT run_id, task_type, outcome, count(*) AS n, max(t.attempt) AS attempt, min(event_id) AS first FROM leases WHERE action = 'acquire' GROUP BY 1, 2, 3")
def lease_acquire(spark: SparkSession, d: str) -> DataFrame:
    """How acquisitions end: pending work is acquired, a lease that ran out is taken over with the next attempt or fails at
    three, a live one is held."""
    a = leases(spark, d).filter("action = 'acquire'").groupBy("run_id", "task_type", "outcome")
    return a.agg(F.count("*").alias("n"), F.max("attempt").alias("attempt"), F.min("event_id").alias("first"))


@audit("X3", f"WITH RECURSIVE {_LEASES} SELECT run_id, event_id, outcome = 'extended' AS extended, CASE WHEN outcome = 'extended' THEN t.expires END AS expires FROM leases WHERE action = 'beat'")
def heartbeat_extend(spark: SparkSession, d: str) -> DataFrame:
    """A beat by the live lease's worker and token extends it from now; a refused one changes nothing."""
    live = F.col("outcome") == "extended"
    return leases(spark, d).filter("action = 'beat'").select("run_id", "event_id", live.alias("extended"), F.when(live, F.col("expires")).alias("expires"))


@audit(
    "X5",
    f"""WITH RECURSIVE {_LEASES} SELECT run_id, count(*) AS swept, coalesce(string_agg(task_type || ':' || task_key, ',' ORDER BY task_type || ':' || task_key) FILTER (outcome = 'requeued'), '') AS requeued, coalesce(string_agg(task_type || ':' || task_key, ',' ORDER BY task_type || ':' || task_key) FILTER (outcome = 'exhausted'), '') AS failed FROM leases WHERE action = 'sweep' GROUP BY 1""",
)
def expiry_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What a run's sweeps requeue and fail, sorted; a list holds sweeps that found a lease run out, three a task at most."""
    name = F.concat_ws(":", "task_type", "task_key")
    listed = lambda outcome: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, name))), ",").alias({"exhausted": "failed"}.get(outcome, outcome))
    return leases(spark, d).filter("action = 'sweep'").groupBy("run_id").agg(F.count("*").alias("swept"), listed("requeued"), listed("exhausted"))


@audit(
    "X8 C27",
    f"""WITH {WORK} SELECT work_id, coalesce(CASE WHEN status = 'running' THEN phase END, status) AS phase, CASE WHEN status = 'running' AND phase IS NULL THEN 'pending' WHEN attempt = 3 AND status = 'pending' THEN 'reset' ELSE status END AS state FROM work LEFT JOIN (SELECT l_orderkey, arg_max(CASE WHEN l_linestatus = 'F' THEN 'analysing' ELSE 'reporting' END, (l_linenumber, l_linestatus)) AS phase FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = work_id""",
)
def queue_projection(spark: SparkSession, d: str) -> DataFrame:
    """Task rows merged with the local phase, which counts only while a task runs."""
    phase = F.when(F.col("l_linestatus") == "F", "analysing").otherwise("reporting")
    p = table(spark, d, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.max(F.struct("l_linenumber", "l_linestatus", phase.alias("phase"))).alias("x")).select("work_id", F.col("x.phase").alias("p"))
    w = work(spark, d).join(p, "work_id", "left")
    running = F.col("status") == "running"
    state = F.when(running & F.col("p").isNull(), "pending").when((F.col("attempt") == 3) & (F.col("status") == "pending"), "reset").otherwise(F.col("status"))
    return w.select("work_id", F.coalesce(F.when(running, F.col("p")), F.col("status")).alias("phase"), state.alias("state"))


@audit(
    "X9",
    """WITH e AS (SELECT user_id, event_id, ts, event_type || ':' || json_extract_string(props, '$.k') AS signature FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, signature ORDER BY ts, event_id) = 1 AS novel FROM e), a AS (SELECT *, sum(novel::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, event_id, signature, run <= 60 AS executed, novel AND run <= 60 AND nth <= 20 AS admitted FROM a""",
)
def feedback_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A case with a route and signature that are new admits children, until the budgets for runs and entries end."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("signature"))
    e = e.withColumn("novel", F.row_number().over(W.partitionBy("user_id", "signature").orderBy("ts", "event_id")) == 1)
    a = e.withColumns({"nth": F.sum(F.col("novel").cast("int")).over(w), "run": F.row_number().over(w)})
    inside = F.col("run") <= 60
    return a.select("user_id", "event_id", "signature", inside.alias("executed"), (F.col("novel") & inside & (F.col("nth") <= 20)).alias("admitted"))


@audit(
    "X10 C15",
    """WITH e AS (SELECT user_id, event_id, ts, json_extract(props, '$.k')::BIGINT % 6 AS a, json_extract(props, '$.k')::BIGINT % 5 AS b, event_type IN ('view', 'click') AS caller, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
x AS (SELECT *, CASE WHEN caller THEN a || '>' || b ELSE b || '>' || a END AS pair, CASE WHEN caller THEN b || '>' || a ELSE a || '>' || b END AS inverse FROM e), p AS (SELECT user_id, pair, min(i) AS first FROM x GROUP BY 1, 2)
SELECT x.user_id, x.event_id, CASE WHEN x.i > 40 THEN 'cap' WHEN x.i > own.first THEN 'duplicate' WHEN inv.first < x.i AND x.pair <> x.inverse THEN 'circular' ELSE 'answered' END AS outcome, sha256(coalesce(lag(event_type) OVER (PARTITION BY x.user_id ORDER BY x.i), '') || '|' || x.pair || '|' || x.event_id) AS link FROM x JOIN events ev USING (event_id) JOIN p own ON own.user_id = x.user_id AND own.pair = x.pair LEFT JOIN p inv ON inv.user_id = x.user_id AND inv.pair = x.inverse""",
)
def continuation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Digest-linked requests of a session: at most forty, none twice, and none that asks for the inverse of an answered pair."""
    k = F.get_json_object("props", "$.k").cast("long")
    a, b = (k % 6).cast("string"), (k % 5).cast("string")
    there, back = F.concat_ws(">", a, b), F.concat_ws(">", b, a)
    caller = F.col("event_type").isin("view", "click")
    e = R.ranked(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "i")
    x = e.withColumns({"pair": F.when(caller, there).otherwise(back), "inverse": F.when(caller, back).otherwise(there)})
    p = x.groupBy("user_id", "pair").agg(F.min("i").alias("first"))
    x = x.join(p, ["user_id", "pair"]).join(p.withColumnsRenamed({"pair": "inverse", "first": "other"}), ["user_id", "inverse"], "left")
    circular = F.coalesce((F.col("other") < F.col("i")) & (F.col("pair") != F.col("inverse")), F.lit(False))
    outcome = F.when(F.col("i") > 40, "cap").when(F.col("i") > F.col("first"), "duplicate").when(circular, "circular").otherwise("answered")
    before = F.coalesce(F.lag("event_type").over(W.partitionBy("user_id").orderBy("i")), F.lit(""))
    return x.select("user_id", "event_id", outcome.alias("outcome"), F.sha2(F.concat_ws("|", before, "pair", F.col("event_id").cast("string")), 256).alias("link"))


@audit(
    "X1 K7 S11",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","type":"' || event_type || '","event_id":' || event_id || '}' AS entry FROM events""",
)
def event_log(spark: SparkSession, d: str) -> DataFrame:
    """One compact JSON line an event, numbered in its log, and read back with its line number."""
    e = R.ranked(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "line")
    entry = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("type"), "event_id"))
    return checked_log(e.select("user_id", "line", entry.alias("entry"))).select("user_id", F.get_json_object("entry", "$.event_id").cast("long").alias("event_id"), "line", "entry")


def checked_log(lines: DataFrame) -> DataFrame:
    """Lines (line, entry) of a JSON log: blank ones skipped; a malformed one, or one without ts or type, is an error that
    names its line."""
    parsed = F.from_json("entry", "ts string, type string")
    good = parsed["ts"].isNotNull() & parsed["type"].isNotNull()
    message = F.concat(F.lit("bad event at line "), F.col("line").cast("string"))
    return lines.filter("trim(entry) <> ''").withColumn("entry", F.when(good, F.col("entry")).otherwise(F.raise_error(message).cast("string")))


@audit(
    "S13 S14 S15",
    """SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, CASE WHEN count(*) > 10 THEN 'refused' ELSE 'open' END AS schema_version, NULL::BIGINT AS missing_column FROM orders GROUP BY 1""",
)
def store_reads(spark: SparkSession, d: str) -> DataFrame:
    """Scans in a total order and point lookups; a newer schema is refused and a column that isn't there reads as null."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"), F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return o.select("o_custkey", "n", "latest", F.col("x.o_orderstatus").alias("status"), F.when(F.col("n") > 10, "refused").otherwise("open").alias("schema_version"), F.lit(None).cast("long").alias("missing_column"))


@audit(
    "S16",
    f"""WITH {FOUND}, l AS (SELECT DISTINCT ON (run_id, candidate_id) run_id, candidate_id FROM found WHERE hunter = 'R'), n AS (SELECT DISTINCT run_id, candidate_id FROM found WHERE hunter = 'N')
SELECT l.run_id, count(*) FILTER (n.run_id IS NULL) AS created, count(*) FILTER (n.run_id IS NOT NULL) AS deduplicated FROM l LEFT JOIN n USING (run_id, candidate_id) GROUP BY 1""",
)
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an old run that are stored already are counted, not inserted, so that importing again changes nothing."""
    f = found(spark, d)
    old = f.filter("hunter = 'R'").select("run_id", "candidate_id").distinct()
    have = f.filter("hunter = 'N'").select("run_id", "candidate_id", F.lit(True).alias("h")).distinct()
    return old.join(have, ["run_id", "candidate_id"], "left").groupBy("run_id").agg(tally(F.col("h").isNull(), "created"), tally(F.col("h").isNotNull(), "deduplicated"))
