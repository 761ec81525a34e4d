"""Scheduling: total orders, quotas, budgets, tiers, waves, batches, packing and selection.

Ranks that only decide who is among the first few are filtered by a constant right after the window, so Spark limits each
task's rows before the shuffle; what depends on all rows before it is folded as a stream of sorted rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.audits.metrics import ids, tally
from tracewright.audits.registry import FOUND, WORK, audit, found, whole, work
from tracewright.operators import ranking as R
from tracewright.sources.tables import table

MAX_SESSIONS = 12
_RISK = "required DESC, risk DESC, work_id"


def legacy_allocation(items: DataFrame, groups: Sequence[str], sessions: int, retries: bool = True) -> DataFrame:
    """Admits items of each group to its sessions: required ones, then risk 4 and more, then others.

    Required items get 60 % of the sessions (rounded up), high risks 30 % (down). 10 % (up) are held for retries, as far as
    the items leave room or, if there are more items than sessions, in any case, but for one session. What a class leaves
    free is borrowed in the order of the classes. Adds disposition, place (of admission, from 1) and pre_rank.
    """
    order = [F.desc("required"), F.desc("risk"), F.col("work_id")]
    kind = F.when(F.col("required"), 0).when(F.col("risk") >= 4, 1).otherwise(2)
    # No class gives more than all sessions, so the rest needs no rank.
    first = items.withColumn("_kind", kind).withColumn("_nth", F.row_number().over(W.partitionBy(*groups, "_kind").orderBy(*order))).filter(F.col("_nth") <= sessions)
    nominal = max(1, math.ceil(sessions / 10)) if retries and sessions > 1 else 0
    counts = items.groupBy(*groups).agg(F.count("*").alias("_n"))
    spare = F.greatest(F.lit(0), sessions - F.col("_n"))
    held = F.when(F.col("_n") > sessions, min(nominal, sessions - 1)).otherwise(F.least(F.lit(nominal), spare))
    capacity = (sessions - held).cast("long")
    first = first.join(counts.withColumn("_capacity", capacity), list(groups))
    critical = F.least(F.col("_capacity"), F.lit(math.ceil(sessions * 0.6)))
    high = F.least(F.col("_capacity") - critical, F.lit(math.floor(sessions * 0.3)))
    quota = F.when(F.col("_kind") == 0, critical).when(F.col("_kind") == 1, high).otherwise(0)
    first = first.withColumn("_own", F.col("_nth") <= quota)
    own = W.partitionBy(*groups).orderBy(F.desc("_own"), "_kind", *order)
    first = first.withColumn("place", F.row_number().over(own).cast("long")).filter(F.col("place") <= F.col("_capacity"))
    picked = first.select("work_id", "place")
    ranked = R.ranked(items, groups, order, "pre_rank")
    out = ranked.join(picked, "work_id", "left")
    return out.withColumn("disposition", F.when(F.col("place").isNotNull(), "admitted").otherwise("budget_deferred"))


_N = "count(*) OVER (PARTITION BY campaign, component)"


@audit(
    "O4 W2 W1",
    f"""WITH {WORK}, a AS (SELECT *, CASE WHEN required THEN 0 WHEN risk >= 4 THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY campaign, component ORDER BY {_RISK}) AS pre_rank, 12 - CASE WHEN {_N} > 12 THEN 2 ELSE least(2, greatest(0, 12 - {_N})) END AS capacity FROM work),
b AS (SELECT *, row_number() OVER (PARTITION BY campaign, component, kind ORDER BY {_RISK}) <= CASE kind WHEN 0 THEN least(capacity, 8) WHEN 1 THEN least(capacity - least(capacity, 8), 3) ELSE 0 END AS own FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY campaign, component ORDER BY own DESC, kind, {_RISK}) AS place FROM b)
SELECT work_id, campaign, component, pre_rank, CASE WHEN place <= capacity THEN place END AS place, CASE WHEN place <= capacity THEN 'admitted' ELSE 'budget_deferred' END AS disposition FROM c""",
)
def work_allocation(spark: SparkSession, d: str) -> DataFrame:
    out = legacy_allocation(work(spark, d), ["campaign", "component"], MAX_SESSIONS)
    return out.select("work_id", "campaign", "component", "pre_rank", "place", "disposition")


def evidence_points() -> Column:
    """What speaks for a candidate, each by itself: 40, 30, 20 and 10 points, which add up."""
    facts = [(F.col("required"), 40), (F.col("risk") >= 4, 30), (F.col("status") == "done", 20), (F.col("attempt") == 1, 10)]
    return sum((F.when(c, n).otherwise(0) for c, n in facts), F.lit(0))


def candidate_order() -> list[Column]:
    """The ten keys of a candidate, ascending: class, chain score, evidence, hunter (the preferred one first), required,
    risk, reachable, component, family, tie. Those that fall are negated."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    tie = F.sha2(F.concat_ws(chr(31), "component", "hunter", F.col("work_id").cast("string")), 256)
    return [rank, -F.col("score"), -evidence_points(), (F.col("hunter") != "h0").cast("int"), -F.col("required").cast("int"), -F.col("risk"), -F.col("attempt"), F.col("component"), F.col("family"), tie]


_EVIDENCE = "40 * required::INT + 30 * (risk >= 4)::INT + 20 * (status = 'done')::INT + 10 * (attempt = 1)::INT"
_ORDER = f"""CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, score DESC, {_EVIDENCE} DESC,
  CASE hunter WHEN 'h0' THEN 0 ELSE 1 END, required DESC, risk DESC, attempt DESC, component, family, sha256(component || chr(31) || hunter || chr(31) || work_id)"""


@audit("O1", f"WITH {WORK} SELECT campaign, family, work_id, row_number() OVER (PARTITION BY campaign, family ORDER BY {_ORDER}) AS place FROM work")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(work(spark, d), ["campaign", "family"], candidate_order(), "place").select("campaign", "family", "work_id", "place")


class Diverse:
    """Admission of a group's candidates in passes, each pass in the candidates' order.

    Every admission is checked: room left, obligations not all covered by its hunter, and, in the last pass, a coverage
    group that nobody has. Passes: decisive obligations (one a kind, at most four, one session left over); critical chains
    up to half the sessions, with at most two of a family until there are three families; the other obligations;
    required work of new families up to a quarter; required specialists up to a twelfth; critical ones that the family cap
    held back; high risks up to a sixth; and whoever is left.
    """

    def __init__(self, rows: list[dict], sessions: int, retries: bool):
        self.rows, self.sessions = rows, sessions
        held = (1 if sessions <= 12 else 2) if retries and len(rows) > sessions else 0
        self.capacity = max(0, sessions - min(held, max(0, sessions - 1)))
        self.picked: dict[int, tuple[int, str]] = {}
        self.families: dict[object, int] = {}
        self.covered: set[tuple[str, str]] = set()
        self.groups: set[str] = set()
        self.specialists: set[tuple[str, str]] = set()
        self.goal = min(3, len({r["family"] for r in rows if r["required"]}), self.capacity)

    def admit(self, row: dict, quota: str) -> bool:
        need = {(o, row["hunter"]) for o in row["obligations"]}
        special = {(row["chain"], row["hunter"])} if row["chain"] else set()
        full = len(self.picked) >= self.capacity or row["work_id"] in self.picked
        if full or need and need <= self.covered or special and special <= self.specialists:
            return False
        self.picked[row["work_id"]] = (len(self.picked) + 1, quota)
        self.families[row["family"]] = self.families.get(row["family"], 0) + 1
        self.covered |= need
        self.groups.add(row["group"])
        self.specialists |= special
        return True

    def capped(self, row: dict) -> bool:
        return len(self.families) < self.goal and self.families.get(row["family"], 0) >= 2

    def up_to(self, rows: Sequence[dict], most: int, quota: str) -> int:
        n = 0
        for row in rows:
            if n >= most:
                break
            n += self.admit(row, quota)
        return n

    def run(self) -> None:
        share = lambda part: max(1, math.ceil(self.sessions * part))
        alone = len({r["family"] for r in self.rows if r["required"]}) <= 1
        # An owner that is refused once is refused for good, so each pair of an obligation and a hunter is tried once, at its
        # highest weight, and the first row that has it.
        best: dict[tuple[str, str], tuple] = {}
        owners: dict[tuple[str, str], list[dict]] = {}
        for i, r in enumerate(self.rows):
            for o in r["obligations"]:
                key, at = (o, r["hunter"]), (-r["weights"][o], i)
                best[key] = min(best.get(key, at), at)
                owners.setdefault(key, []).append(r)
        pairs = sorted((*at, *key) for key, at in best.items())
        kinds: set[str] = set()
        for weight, _, obligation, hunter in pairs:
            if len(kinds) >= min(4, self.capacity - 1):
                break
            if -weight >= 100 and obligation.split(":")[0] not in kinds:
                if self.up_to(owners[obligation, hunter], 1, "decisive_obligation"):
                    kinds.add(obligation.split(":")[0])
        chains = {}
        for r in self.rows:
            if r["chain"]:
                chains.setdefault(r["chain"], set()).add(r["hunter"])
        # Of a chain that several hunters share, all hunters but its first candidate's are specialists.
        first = {}
        for r in self.rows:
            first.setdefault(r["chain"], r["hunter"])
        wanted = {(c, h) for c, hs in chains.items() if len(hs) > 1 for h in hs if h != first[c]}
        special = min(len(wanted), max(0, self.capacity - 1), share(1 / 12))
        room = min(max(0, self.capacity - special), share(0.5)) - len(kinds)
        critical = [r for r in self.rows if r["critical"]]
        most, n, held = max(int(len(self.picked) < self.capacity and any(r["work_id"] not in self.picked for r in critical)), room), 0, []
        for row in critical:
            if n >= most:
                break
            if self.capped(row) and not alone:
                held.append(row)
            else:
                n += self.admit(row, "chain_critical")
        for _, _, obligation, hunter in pairs:
            if (obligation, hunter) not in self.covered:
                self.up_to(owners[obligation, hunter], 1, "obligation_required")
        new = min(max(0, self.capacity - len(self.picked) - special), share(0.25))
        for row in self.rows:
            if new and row["required"] and row["family"] not in self.families:
                new -= self.admit(row, "seed_diverse")
        self.up_to([r for r in self.rows if (r["chain"], r["hunter"]) in wanted and (r["chain"], r["hunter"]) not in self.specialists], special, "required_specialist")
        self.up_to(held, most - n, "chain_critical_revisit")
        high = 0
        for row in self.rows:
            if high < share(1 / 6) and not row["critical"] and row["risk"] >= 4 and not self.capped(row):
                high += self.admit(row, "high_risk")
        for row in self.rows:
            if not row["chain"] and row["group"] in self.groups or self.capped(row) and not alone:
                continue
            self.admit(row, "borrowed")

    def reason(self, row: dict) -> str:
        """Why a row that wasn't admitted is deferred: the first of the reasons that holds."""
        need = {(o, row["hunter"]) for o in row["obligations"]}
        if need and need <= self.covered:
            return "duplicate_obligation"
        if row["chain"] and (row["chain"], row["hunter"]) in self.specialists:
            return "duplicate_chain"
        if not row["chain"] and row["group"] in self.groups:
            return "duplicate_coverage"
        return "max_sessions"


_CANDIDATE = ["work_id", "family", "hunter", "required", "risk", "critical", "chain", "group", "obligations", "weights"]


def diverse_allocation(items: DataFrame, groups: Sequence[str], order: Sequence[Column], sessions: int, retries: bool = True) -> DataFrame:
    """Diverse admission of each group's items (columns _CANDIDATE): work_id, place, quota, and the reason of a deferral.

    A decision looks only at an item's attributes, so of items that agree in all of them at most ``sessions`` can be
    admitted: the first ones. The passes run over these; the others are deferred by the same rules.
    """
    alike = [c for c in _CANDIDATE if c not in ("work_id", "weights", "obligations")] + ["_obligations"]
    items = items.withColumn("_obligations", F.array_join("obligations", ","))
    items = items.withColumn("_nth", F.row_number().over(W.partitionBy(*groups, *alike).orderBy(*order)))
    items = items.withColumn("_order", F.struct(*[F.struct(c.alias("x")).alias(f"k{i}") for i, c in enumerate(order)]))
    first = items.filter(F.col("_nth") <= sessions + 1)
    keys = ", ".join(f"{g} {dict(items.dtypes)[g]}" for g in groups)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("_at")[_CANDIDATE].to_dict("records")
        for r in rows:
            r["obligations"], r["weights"] = list(r["obligations"]), dict(r["weights"])
        passes = Diverse(rows, sessions, retries)
        passes.run()
        out = [(*key, r["work_id"], *(passes.picked.get(r["work_id"]) or (None, None)), None if r["work_id"] in passes.picked else passes.reason(r)) for r in rows]
        return pd.DataFrame(out, columns=[*groups, "work_id", "place", "quota", "reason"]).astype({"place": "Int64"})

    # _at: the place among the few that remain of each kind.
    placed = first.withColumn("_at", F.row_number().over(W.partitionBy(*groups).orderBy("_order")))
    decided = placed.select(*groups, "_at", *_CANDIDATE).groupBy(*groups).applyInPandas(run, f"{keys}, work_id long, place long, quota string, reason string")
    rest = items.filter(F.col("_nth") > sessions + 1).select(*groups, "work_id", *alike)
    # The last of a kind's rows that went through the passes has the reason that holds for those after it.
    told = placed.filter(F.col("_nth") == sessions + 1).select(*groups, "work_id", *alike).join(decided.select("work_id", "reason"), "work_id").drop("work_id")
    joined = rest.join(told, [*groups, *alike])
    return decided.unionByName(joined.select(*groups, "work_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("quota"), "reason"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Work items with what diverse admission looks at."""
    w = work(spark, d)
    chain = F.when(F.col("score") >= 250, F.concat_ws("/", F.col("family").cast("string"), F.floor(F.col("score") / 50).cast("string"))).otherwise("")
    kinds = F.array_compact(F.array(F.when((F.col("risk") == 5) & F.col("required"), F.concat(F.lit("integer:"), F.col("component"))), F.when((F.col("attempt") == 2) & (F.col("score") > 150), F.concat(F.lit("cursor:"), F.col("family").cast("string")))))
    weight = F.least(F.lit(120), 60 + F.floor(F.col("score") / 5)).cast("int")
    w = w.withColumns({"chain": chain, "critical": (F.col("score") >= 250) & F.col("required"), "group": F.concat_ws("/", "component", "hunter", F.col("family").cast("string")), "obligations": kinds})
    return w.withColumn("weights", F.map_from_entries(F.transform("obligations", lambda o: F.struct(o.alias("k"), weight.alias("v")))))


@audit("O5 O6 O7 J23", None)
def diverse_admission(spark: SparkSession, d: str) -> DataFrame:
    """Sequential passes have no SQL form; the test holds them against a plain run over unreduced groups."""
    return diverse_allocation(candidates(spark, d), ["campaign"], candidate_order(), 16)


@audit(
    "O3",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, l_quantity, CASE WHEN l_tax < 0.02 THEN 'absent' WHEN l_tax < 0.05 THEN 'partial' WHEN l_tax < 0.07 THEN 'unknown' ELSE 'dominates' END AS guard, l_discount > 0.05 AS x, l_quantity > 25 AS y, l_linestatus = 'O' AS z FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, kind, (CASE guard WHEN 'absent' THEN 35 WHEN 'partial' THEN 25 WHEN 'unknown' THEN 10 ELSE 0 END + 40 + CASE kind WHEN 'A' THEN 20 * x::INT + 20 * y::INT + 15 * z::INT WHEN 'N' THEN 30 * x::INT + 20 * y::INT + least(20, 5 * floor(l_quantity / 10)::INT) ELSE 35 * x::INT + 20 * y::INT + 10 * z::INT END)::BIGINT AS score FROM f""",
)
def obligation_priority(spark: SparkSession, d: str) -> DataFrame:
    """Additive scores by kind over structural facts: the guard's state, and points for each fact of the kind."""
    tax, on = F.col("l_tax"), lambda c, n: F.when(c, n).otherwise(0)
    guard = F.when(tax < 0.02, 35).when(tax < 0.05, 25).when(tax < 0.07, 10).otherwise(0)
    x, y, z = F.col("l_discount") > 0.05, F.col("l_quantity") > 25, F.col("l_linestatus") == "O"
    facts = F.when(F.col("l_returnflag") == "A", on(x, 20) + on(y, 20) + on(z, 15)).when(F.col("l_returnflag") == "N", on(x, 30) + on(y, 20) + F.least(F.lit(20), 5 * F.floor(F.col("l_quantity") / 10).cast("int"))).otherwise(on(x, 35) + on(y, 20) + on(z, 10))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), F.col("l_returnflag").alias("kind"), (guard + 40 + facts).cast("long").alias("score"))


@audit(
    "O8 O9",
    f"""WITH {WORK}, a AS (SELECT *, row_number() OVER (PARTITION BY campaign, component ORDER BY {_RISK}) AS r, least(12, count(*) OVER (PARTITION BY campaign, component)) AS n FROM work)
SELECT work_id, greatest(1, 1000000 // n)::BIGINT AS base_share, least(1000000, greatest(1, 1000000 // n) * 2 + CASE WHEN required THEN greatest(0, 1000000 - greatest(1, 1000000 // n) * n) ELSE 0 END)::BIGINT AS input_limit, least(greatest(1, 1000000 // n), greatest(32000, greatest(1, 1000000 // n) // 2))::BIGINT AS first_call_reserve,
  CASE WHEN attempt > 1 THEN 40 WHEN required OR risk >= 4 THEN 18 ELSE 6 END::BIGINT AS iterations, greatest(800, least(4000, 1600 + least(greatest(score % 9, 1), 6) * 300 + CASE WHEN required THEN 600 ELSE 0 END))::BIGINT AS output_limit FROM a WHERE r <= 12""",
)
def work_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Input shares of the admitted work, the reserve for critical first calls, iteration tiers and response sizes."""
    w, groups, most = work(spark, d), ["campaign", "component"], 1_000_000
    counts = w.groupBy(*groups).agg(F.least(F.lit(12), F.count("*")).alias("n"))
    a = R.top_k(w, groups, [F.desc("required"), F.desc("risk"), F.col("work_id")], 12).join(counts, groups)
    base = F.greatest(F.lit(1), F.floor(most / F.col("n"))).cast("long")
    spare = F.when(F.col("required"), F.greatest(F.lit(0), most - F.col("base_share") * F.col("n"))).otherwise(0)
    a = a.withColumn("base_share", base)
    tier = F.when(F.col("attempt") > 1, 40).when(F.col("required") | (F.col("risk") >= 4), 18).otherwise(6)
    size = 1600 + F.least(F.greatest(F.col("score") % 9, F.lit(1)), F.lit(6)) * 300 + F.when(F.col("required"), 600).otherwise(0)
    return a.select(
        "work_id",
        "base_share",
        F.least(F.lit(most), F.col("base_share") * 2 + spare).cast("long").alias("input_limit"),
        F.least(F.col("base_share"), F.greatest(F.lit(32000), F.floor(F.col("base_share") / 2))).cast("long").alias("first_call_reserve"),
        tier.cast("long").alias("iterations"),
        F.greatest(F.lit(800), F.least(F.lit(4000), size)).cast("long").alias("output_limit"),
    )


def reservations(calls: DataFrame, key: str, order: Sequence[str], hard: int, soft: int, output: int, per_work: int, reserve: int, deadline: int) -> DataFrame:
    """Each run's calls in order against its limits; a rejected call uses nothing.

    calls: columns key, work, at (seconds), input, output, critical. The first rule that fails is the reason: deadline, the
    work's own input, input that is kept for critical work that hasn't called yet, the soft stop, the hard limit, the
    output. Folded as a stream of sorted rows, so a run may be of any length; a task holds one batch and one run's sums.
    """
    schema = calls.schema.add("reason", "string").add("granted_output", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, began, used, out, by_work, waiting = object(), 0, 0, 0, {}, 0
        for frame in batches:
            reasons, granted = [], []
            for k, work_, at, want, wanted, critical, more in zip(*(frame[c] for c in (key, "work", "at", "input", "output", "critical", "critical_works")), strict=True):
                if k != run:
                    run, began, used, out, by_work, waiting = k, at, 0, 0, {}, more
                kept = reserve * (waiting - (1 if critical and work_ not in by_work else 0))
                rules = [
                    ("deadline", at - began >= deadline),
                    ("input_per_work", by_work.get(work_, 0) + want > per_work),
                    ("critical_reserve", want > hard - used - kept),
                    ("soft_stop", want > soft - used),
                    ("max_output", out >= output),
                ]
                reason = next((n for n, failed in rules if failed), None)
                reasons.append(reason)
                granted.append(0 if reason else min(wanted, output - out))
                if reason is None:
                    if critical and work_ not in by_work:
                        waiting -= 1
                    by_work[work_] = by_work.get(work_, 0) + want
                    used, out = used + want, out + granted[-1]
            yield frame.assign(reason=pd.Series(reasons, index=frame.index, dtype=object), granted_output=pd.Series(granted, index=frame.index, dtype="int64"))

    return calls.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


@audit("O11", None)
def call_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Rejected calls change nothing for those after them, which windows can't say; the test has a plain loop."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    calls = li.select(F.col("o_custkey").alias("run"), F.col("l_orderkey").alias("work"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at"), whole(F.col("l_extendedprice") / 10).alias("input"), whole(F.col("l_quantity") * 20).alias("output"), (F.col("o_orderpriority") < "2").alias("critical"), F.col("l_linenumber").cast("long").alias("line"))
    critical = calls.filter("critical").groupBy("run").agg(F.countDistinct("work").alias("critical_works"))
    calls = calls.join(critical, "run", "left").withColumn("critical_works", F.coalesce("critical_works", F.lit(0)).cast("long"))
    return reservations(calls, "run", ["at", "work", "line"], hard=200_000, soft=180_000, output=6_000, per_work=30_000, reserve=4_000, deadline=5 * 365 * 86_400)


@audit(
    "O10",
    f"""WITH {WORK}, a AS (SELECT *, row_number() OVER (PARTITION BY campaign, component ORDER BY {_RISK}) AS r FROM work), f AS (SELECT campaign, component, work_id, row_number() OVER (PARTITION BY campaign, component ORDER BY r) AS i FROM a WHERE r <= 12 AND status = 'pending' AND attempt = 1),
w AS (SELECT campaign, component, work_id, row_number() OVER (PARTITION BY campaign, component ORDER BY r) AS i FROM a WHERE r > 12)
SELECT campaign, component, f.work_id AS finished, w.work_id AS promoted FROM f LEFT JOIN w USING (campaign, component, i)""",
)
def slot_recycling(spark: SparkSession, d: str) -> DataFrame:
    """Admitted work that ends before it starts gives its slot to the next that waits, in order."""
    groups = ["campaign", "component"]
    ranked = R.ranked(work(spark, d), groups, [F.desc("required"), F.desc("risk"), F.col("work_id")], "r")
    ended = R.ranked(ranked.filter("r <= 12 and status = 'pending' and attempt = 1"), groups, [F.col("r")], "i").select(*groups, F.col("work_id").alias("finished"), "i")
    waiting = ranked.filter("r > 12").filter("r <= 24")  # twelve slots promote twelve at most
    waiting = R.ranked(waiting, groups, [F.col("r")], "i").select(*groups, F.col("work_id").alias("promoted"), "i")
    return ended.join(waiting, [*groups, "i"], "left").drop("i")


#: Sessions, retry slots and the last standard session of the budget profiles.
PROFILES = {"standard-12": (12, 1, 12), "deep-16": (16, 2, 12)}


@audit(
    "O13",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'standard-12' WHEN 'O' THEN 'deep-16' ELSE 'custom' END AS profile, CASE o_orderstatus WHEN 'F' THEN 12 WHEN 'O' THEN 16 ELSE greatest(1, least(64, o_custkey % 100)) END::BIGINT AS sessions, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE CASE WHEN greatest(1, least(64, o_custkey % 100)) <= 12 THEN 1 ELSE 2 END END::BIGINT AS retries, CASE WHEN o_orderstatus IN ('F', 'O') THEN 12 ELSE greatest(1, least(64, o_custkey % 100)) END::BIGINT AS boundary FROM orders""",
)
def budget_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A named profile's values, or those of a custom one, within 1 to 64 sessions."""
    name = F.when(F.col("o_orderstatus") == "F", "standard-12").when(F.col("o_orderstatus") == "O", "deep-16").otherwise("custom")
    own = F.greatest(F.lit(1), F.least(F.lit(64), F.col("o_custkey") % 100))
    pick = lambda k, other: F.coalesce(*[F.when(F.col("profile") == n, F.lit(v[k])) for n, v in PROFILES.items()], other).cast("long")
    o = table(spark, d, "orders").withColumn("profile", name)
    return o.select("o_orderkey", "profile", pick(0, own).alias("sessions"), pick(1, F.when(own <= 12, 1).otherwise(2)).alias("retries"), pick(2, own).alias("boundary"))


@audit(
    "O14 U3",
    f"""WITH {WORK} SELECT component, work_id, row_number() OVER (PARTITION BY component, family ORDER BY risk DESC, score DESC, work_id) AS place, family, score >= 5 OR required AS selected, required AND score < 5 AS forced FROM work""",
)
def file_ranking(spark: SparkSession, d: str) -> DataFrame:
    """By priority, score and path; the threshold selects, and critical files are selected in any case."""
    out = R.ranked(work(spark, d), ["component", "family"], [F.desc("risk"), F.desc("score"), F.col("work_id")], "place")
    return out.select("component", "work_id", "place", "family", ((F.col("score") >= 5) | F.col("required")).alias("selected"), (F.col("required") & (F.col("score") < 5)).alias("forced"))


@audit(
    "O15 W8",
    f"""WITH {WORK}, b AS (SELECT campaign, work_id, score, (row_number() OVER (PARTITION BY campaign ORDER BY work_id) - 1) // 150 AS batch FROM work)
SELECT campaign, work_id, batch::BIGINT AS batch, row_number() OVER (PARTITION BY campaign ORDER BY score DESC, batch, work_id) AS place FROM b""",
)
def rank_merge(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 150 rows, concatenated and sorted by score; equal scores keep their batch order."""
    b = R.waves(work(spark, d), ["campaign"], [F.col("work_id")], 150).withColumnRenamed("wave", "batch")
    return R.ranked(b, ["campaign"], [F.desc("score"), F.col("batch"), F.col("work_id")], "place").select("campaign", "work_id", "batch", "place")


@audit(
    "W7",
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, event_id, i, (CASE WHEN i <= 12 THEN (i - 1) // 5 ELSE 3 + (i - 13) // 5 END)::BIGINT AS wave FROM a""",
)
def session_waves(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of five tasks that don't cross the standard session boundary at twelve."""
    a = R.ranked(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "i")
    chunk = lambda n: F.floor(n / 5)
    return a.select("user_id", "event_id", "i", F.when(F.col("i") <= 12, chunk(F.col("i") - 1)).otherwise(3 + chunk(F.col("i") - 13)).cast("long").alias("wave"))


@audit(
    "W9 W10 W4",
    """WITH s AS (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events WHERE event_type <> 'error' GROUP BY 1, 2), o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first.ts, first.id) AS session_index FROM s)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, session_index FROM events LEFT JOIN o USING (user_id, event_type)""",
)
def provider_start_order(spark: SparkSession, d: str) -> DataFrame:
    """Sequence numbers of a log, and for each task the order of its first start."""
    e = table(spark, d, "events")
    starts = e.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    order = R.ranked(starts, ["user_id"], [F.col("first")], "session_index").select("user_id", "event_type", "session_index")
    return R.ranked(e, ["user_id"], [F.col("ts"), F.col("event_id")], "sequence").join(order, ["user_id", "event_type"], "left").select("user_id", "event_id", "sequence", "session_index")


@audit(
    "W12",
    """WITH m AS (SELECT *, event_type = 'signup' AS starts FROM events), c AS (SELECT *, max(CASE WHEN starts THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS own, min(CASE WHEN starts THEN ts END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next FROM m)
SELECT user_id, own AS case_start, count(*) FILTER (event_type = 'click') AS increments, count(*) FILTER (event_type = 'click') <= 1 AS exclusive, max(next) AS next_case FROM c WHERE own IS NOT NULL GROUP BY 1, 2""",
)
def case_increments(spark: SparkSession, d: str) -> DataFrame:
    """Increments belong to the case that starts last before them; they exclude each other if no case holds two."""
    start = F.when(F.col("event_type") == "signup", F.col("ts"))
    before = W.partitionBy("user_id").orderBy("ts", "event_id")
    after = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)
    c = table(spark, d, "events").select("*", F.max(start).over(before).alias("case_start"), F.min(start).over(after).alias("next")).filter("case_start is not null")
    out = c.groupBy("user_id", "case_start").agg(tally(F.col("event_type") == "click", "increments"), F.max("next").alias("next_case"))
    return out.withColumn("exclusive", F.col("increments") <= 1)


@audit(
    "O17",
    f"""WITH {FOUND} SELECT target_id, run_id, session_index, place FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY state = 'reportable' DESC, target_match DESC, session_index DESC, run_id, candidate_id) AS place FROM found) WHERE place <= 6""",
)
def slice_top(spark: SparkSession, d: str) -> DataFrame:
    """Six slices of a target: those of its sink first, then of its node, then by risk."""
    order = [(F.col("state") == "reportable").desc(), F.desc("target_match"), F.desc("session_index"), F.col("run_id"), F.col("candidate_id")]
    return R.top_k(found(spark, d), ["target_id"], order, 6).select("target_id", "run_id", "session_index", F.col("rank").alias("place"))


@audit(
    "O18 F25",
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END * 100 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_suppkey) AS i FROM f)
SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY i) FILTER (i <= 8) AS files, greatest(count(*) - 8, 0)::BIGINT AS omitted FROM r GROUP BY 1""",
)
def file_top(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight files of a group: the seed, the members' seeds, the rest; each once, in that order."""
    kind = F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    f = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(kind * 100 + F.col("l_linenumber")).alias("k"))
    g = f.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "l_suppkey"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform(F.slice("x", 1, 8), lambda v: v["l_suppkey"].cast("string")), ",").alias("files"), F.greatest(F.size("x") - 8, F.lit(0)).cast("long").alias("omitted"))


@audit(
    "O19 P11",
    """WITH n AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1) // 4 AS b, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), s AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) // 6 AS b, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)),
x AS (SELECT l_suppkey, b, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS nodes FROM n GROUP BY 1, 2), y AS (SELECT l_suppkey, b, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS signals FROM s GROUP BY 1, 2)
SELECT l_suppkey, b::BIGINT AS batch, coalesce(nodes, '') AS nodes, coalesce(signals, '') AS signals FROM x FULL JOIN y USING (l_suppkey, b)""",
)
def target_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of four nodes and of six signals, put together by their numbers."""
    li = table(spark, d, "lineitem")

    def chunks(key: str, size: int, name: str) -> DataFrame:
        c = R.waves(li.select("l_suppkey", key).distinct(), ["l_suppkey"], [F.col(key)], size)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda v: v.cast("string")), ",")
        return c.groupBy("l_suppkey", F.col("wave").alias("batch")).agg(listed.alias(name))

    both = chunks("l_partkey", 4, "nodes").join(chunks("l_orderkey", 6, "signals"), ["l_suppkey", "batch"], "full_outer")
    return both.na.fill("", ["nodes", "signals"])


def bounded_batches(df: DataFrame, key: str, order: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Adds batch: sequential bins of a key's rows, each sum of a size column within its limit.

    A row that fits in no bin has one alone. Folded as a stream of sorted rows.
    """
    schema = df.schema.add("batch", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number, sums = object(), 0, dict.fromkeys(sizes, 0)
        for frame in batches:
            out = []
            for k, *values in zip(frame[key], *(frame[c] for c in sizes), strict=True):
                row = dict(zip(sizes, values, strict=True))
                fits = all(sums[c] + row[c] <= most for c, most in sizes.items())
                if k != last:
                    last, number, sums = k, 0, row
                elif fits:
                    sums = {c: sums[c] + row[c] for c in sizes}
                else:
                    number, sums = number + 1, row
                out.append(number)
            yield frame.assign(batch=pd.Series(out, index=frame.index, dtype="int64"))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


@audit(
    "O20",
    """WITH RECURSIVE m AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 1 + o_orderkey % 3 AS files, 1 + o_custkey % 2 AS nodes, 1 + (o_orderkey * 7) % 4 AS signals FROM orders),
r AS (SELECT k, id, i, files, nodes, signals, 0::BIGINT AS batch FROM m WHERE i = 1 UNION ALL SELECT m.k, m.id, m.i, CASE WHEN ok THEN r.files + m.files ELSE m.files END, CASE WHEN ok THEN r.nodes + m.nodes ELSE m.nodes END, CASE WHEN ok THEN r.signals + m.signals ELSE m.signals END, CASE WHEN ok THEN batch ELSE batch + 1 END FROM r JOIN m ON m.k = r.k AND m.i = r.i + 1, LATERAL (SELECT r.files + m.files <= 8 AND r.nodes + m.nodes <= 4 AND r.signals + m.signals <= 6 AS ok) x)
SELECT k, id, batch FROM r""",
)
def member_batches(spark: SparkSession, d: str) -> DataFrame:
    """Members of a component in sequential bins of at most eight files, four nodes and six signals."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).alias("files"), (1 + F.col("o_custkey") % 2).alias("nodes"), (1 + F.col("o_orderkey") * 7 % 4).alias("signals"))
    return bounded_batches(m, "k", ["id"], {"files": 8, "nodes": 4, "signals": 6}).select("k", "id", "batch")


@audit(
    "O21",
    """SELECT p_brand, p_partkey, score, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name, p_partkey) AS place FROM (SELECT *, (CASE WHEN p_size > 40 THEN 20 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL%' OR p_type LIKE 'S%' THEN 1 ELSE 0 END)::BIGINT AS score FROM part) WHERE score > 0) WHERE place <= 4""",
)
def related_headers(spark: SparkSession, d: str) -> DataFrame:
    """Four headers by hint score (20 for a name, 1 for a folder), then path; those without a hint never."""
    folder = F.col("p_type").contains("STEEL") | F.col("p_type").startswith("S")
    score = F.when(F.col("p_size") > 40, 20).otherwise(0) + F.when(folder, 1).otherwise(0)
    hinted = table(spark, d, "part").withColumn("score", score.cast("long")).filter("score > 0")
    return R.top_k(hinted, ["p_brand"], [F.desc("score"), F.col("p_name"), F.col("p_partkey")], 4).select("p_brand", "p_partkey", "score", F.col("rank").alias("place"))


@audit(
    "O22 O23 J6",
    """WITH r AS (SELECT l_partkey AS file, l_linenumber * 10 AS line FROM lineitem UNION SELECT l_partkey, (l_suppkey % 80)::INT FROM lineitem), w AS (SELECT DISTINCT file, unnest(range(greatest(1, line - 6), least(90, line + 6) + 1)) AS line FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM w)
SELECT file, count(*) AS lines, min(line) AS first, max(line) FILTER (i <= 60) AS last, greatest(0, count(*) - 60)::BIGINT AS omitted, count(*) FILTER (i <= 60) AS kept FROM o GROUP BY 1""",
)
def selected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of all kinds united, six lines of context around each, sixty lines of a file of ninety at most."""
    li = table(spark, d, "lineitem")
    r = li.select(F.col("l_partkey").alias("file"), (F.col("l_linenumber") * 10).cast("long").alias("line")).union(li.select("l_partkey", F.col("l_suppkey") % 80))
    around = F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - 6), F.least(F.lit(90), F.col("line") + 6)))
    # A file's lines are the bits of two numbers, which tasks unite before anything is shuffled.
    bit = lambda at: F.bit_or(F.when(F.floor(F.col("line") / 60) == at, F.expr("shiftleft(1L, cast(line % 60 as int))"))).alias(f"_{at}")
    masks = r.filter("line between -5 and 96").select("file", around.alias("line")).groupBy("file").agg(bit(0), bit(1))
    has = lambda x: F.when(x < 60, F.getbit(F.coalesce("_0", F.lit(0)), x % 60)).otherwise(F.getbit(F.coalesce("_1", F.lit(0)), x % 60)) == 1
    lines = masks.select("file", F.filter(F.sequence(F.lit(1).cast("long"), F.lit(90).cast("long")), has).alias("l"))
    kept = F.slice("l", 1, 60)
    return lines.select("file", F.size("l").cast("long").alias("lines"), F.array_min("l").alias("first"), F.array_max(kept).alias("last"), F.greatest(F.lit(0), F.size("l") - 60).cast("long").alias("omitted"), F.size(kept).cast("long").alias("kept"))


@audit(
    "O26 J20",
    f"""WITH {FOUND}, o AS (SELECT run_id, candidate_id, min(CASE WHEN state = 'reportable' THEN session_index ELSE 100 + session_index END) AS k, bool_or(state = 'reportable') AS focus FROM found GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k, candidate_id) AS place, row_number() OVER (PARTITION BY run_id, focus ORDER BY k, candidate_id) AS within FROM o)
SELECT run_id, candidate_id, focus, place FROM r WHERE focus OR within <= 2""",
)
def focus_first(spark: SparkSession, d: str) -> DataFrame:
    """Chains in focus first, in the order given, then at most two supporting ones."""
    hit = F.col("state") == "reportable"
    o = found(spark, d).groupBy("run_id", "candidate_id").agg(F.min(F.when(hit, F.col("session_index")).otherwise(100 + F.col("session_index"))).alias("k"), (F.max(hit.cast("int")) == 1).alias("focus"))
    o = R.ranked(R.ranked(o, ["run_id"], [F.col("k"), F.col("candidate_id")], "place"), ["run_id", "focus"], [F.col("k"), F.col("candidate_id")], "within")
    return o.filter("focus or within <= 2").select("run_id", "candidate_id", "focus", "place")


@audit(
    "O28 O30 O34",
    """WITH r AS (SELECT *, (l_quantity * 10)::BIGINT AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey, l_orderkey, l_linenumber) AS place FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY place) AS nth FROM r WHERE place <= 40),
s AS (SELECT *, CASE WHEN place <= 4 THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END AS kind FROM n), a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY kind, place) AS i FROM s)
SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, score, place, i <= 8 AS admitted, CASE WHEN i > 8 THEN 'deferred' WHEN kind = 0 THEN 'prefix' WHEN kind = 1 THEN 'new_format' ELSE 'fill' END AS reason FROM a""",
)
def root_admission(spark: SparkSession, d: str) -> DataFrame:
    """Of the forty best functions eight roots: the ranking's prefix, the first of each new format, then by rank."""
    order = [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    r = R.top_k(table(spark, d, "lineitem"), ["l_suppkey"], order, 40).withColumnRenamed("rank", "place")
    r = R.ranked(r, ["l_suppkey", "l_returnflag"], [F.col("place")], "nth")
    r = r.withColumn("kind", F.when(F.col("place") <= 4, 0).when(F.col("nth") == 1, 1).otherwise(2))
    r = R.ranked(r, ["l_suppkey"], [F.col("kind"), F.col("place")], "i")
    reason = F.when(F.col("i") > 8, "deferred").when(F.col("kind") == 0, "prefix").when(F.col("kind") == 1, "new_format").otherwise("fill")
    return r.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long"), (F.col("l_quantity") * 10).cast("long").alias("score"), "place", (F.col("i") <= 8).alias("admitted"), reason.alias("reason"))


@audit(
    "O35",
    """WITH c AS (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bad DESC, n DESC, k) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, k, place, place <= CASE WHEN total > 6 THEN 5 ELSE 6 END AS admitted FROM r""",
)
def cluster_allocation(spark: SparkSession, d: str) -> DataFrame:
    """A prefix of the ranked clusters; one of the six slots is kept for a retry if there are more clusters."""
    c = table(spark, d, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), tally(F.col("event_type") == "error", "bad"))
    r = R.ranked(c, ["user_id"], [F.desc("bad"), F.desc("n"), F.col("k")], "place").withColumn("total", F.count("*").over(W.partitionBy("user_id")))
    return r.select("user_id", "k", "place", (F.col("place") <= F.when(F.col("total") > 6, 5).otherwise(6)).alias("admitted"))


@audit(
    "O36 O37",
    f"""WITH {FOUND} SELECT run_id, min(session_index) FILTER (target_match) AS admission_rank, min(session_index) FILTER (target_match AND state = 'reportable' AND validity = 'real') AS first_valid_session, count(*) FILTER (target_match) AS matches FROM found GROUP BY 1""",
)
def target_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first admission rank of a matching chain, and the session of the first valid finding."""
    hit = F.col("target_match")
    valid = hit & (F.col("state") == "reportable") & (F.col("validity") == "real")
    return found(spark, d).groupBy("run_id").agg(F.min(F.when(hit, F.col("session_index"))).alias("admission_rank"), F.min(F.when(valid, F.col("session_index"))).alias("first_valid_session"), tally(hit, "matches"))


@audit(
    "O27 J22",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_returnflag = 'R' THEN 30 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 20 ELSE 0 END + CASE WHEN l_quantity > 30 THEN 10 ELSE 0 END - l_linenumber)::BIGINT AS score FROM lineitem)
SELECT l_partkey, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY score DESC, l_orderkey, l_linenumber) AS facts, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_orderkey, l_linenumber) AS i FROM f) WHERE i <= 3 GROUP BY 1""",
)
def evidence_facts(spark: SparkSession, d: str) -> DataFrame:
    """The three facts of a chain with the highest context scores (keywords, operators, distance)."""
    on = lambda c, n: F.when(c, n).otherwise(0)
    score = on(F.col("l_returnflag") == "R", 30) + on(F.col("l_linestatus") == "O", 20) + on(F.col("l_quantity") > 30, 10) - F.col("l_linenumber")
    f = R.top_k(table(spark, d, "lineitem").withColumn("score", score.cast("long")), ["l_partkey"], [F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    g = f.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("f")))).alias("x"), F.max("score").alias("best"))
    return g.select("l_partkey", F.array_join(F.transform("x", lambda v: v["f"]), ",").alias("facts"), "best")


@audit(
    "U2 P7 P8",
    f"""WITH {WORK}, {FOUND}, c AS (SELECT DISTINCT run_id FROM found WHERE state = 'reportable'), s AS (SELECT work_id, component, component IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND status <> 'pending' AS in_scope FROM work)
SELECT component, count(*) FILTER (in_scope) AS in_scope, count(run_id) FILTER (in_scope) AS active_critical, count(run_id) FILTER (NOT in_scope) AS deferred FROM s LEFT JOIN c ON run_id = work_id GROUP BY 1""",
)
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Included components less excluded work; critical sinks outside the scope are deferred, not dropped."""
    critical = found(spark, d).filter("state = 'reportable'").select(F.col("run_id").alias("work_id")).distinct().withColumn("critical", F.lit(True))
    inside = F.col("component").isin("AUTOMOBILE", "BUILDING", "MACHINERY") & (F.col("status") != "pending")
    s = work(spark, d).join(critical, "work_id", "left").withColumn("inside", inside)
    hot = F.coalesce("critical", F.lit(False))
    return s.groupBy("component").agg(tally(F.col("inside"), "in_scope"), tally(F.col("inside") & hot, "active_critical"), tally(~F.col("inside") & hot, "deferred"))


@audit(
    "U4 U5 U12 W3",
    """SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS claimed_by, max(doc_id) AS last_id, count(*) AS claims, count(*) - 1 AS duplicates FROM documents GROUP BY 1""",
)
def payload_claims(spark: SparkSession, d: str) -> DataFrame:
    """A payload belongs to the first that claims its digest; later claims are duplicates."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    c = table(spark, d, "documents").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("claimed_by"), F.max("doc_id").alias("last_id"), F.count("*").alias("claims"))
    return c.withColumn("duplicates", F.col("claims") - 1)


@audit(
    "U10 J41 J43 K16",
    """WITH m AS (SELECT o_orderkey AS path, o_totalprice AS size FROM orders), a AS (SELECT l_orderkey AS path, round(sum(l_extendedprice), 2) AS size, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(m.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected' WHEN abs(m.size - a.size) < 1000 THEN 'equal' ELSE 'changed' END AS state FROM m FULL JOIN a ON m.path = a.path""",
)
def manifest_equality(spark: SparkSession, d: str) -> DataFrame:
    """A frozen manifest against what is there: each entry equal, changed, missing or unexpected."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"))
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.round(F.sum("l_extendedprice"), 2).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.abs(F.col("size") - F.col("now")) < 1000, "equal").otherwise("changed")
    return m.join(a, "path", "full_outer").select("path", state.alias("state"))


@audit(
    "U11",
    """WITH f AS (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, event_id, row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k')::BIGINT ORDER BY ts, event_id) AS i FROM events) SELECT user_id, event_id, k FROM f WHERE i = 1""",
)
def new_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that no earlier packet of the session had."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return R.top_k(e, ["user_id", "k"], [F.col("ts"), F.col("event_id")], 1).select("user_id", "event_id", "k")


@audit(
    "U8 P25",
    """WITH g AS (SELECT source, lang, min(doc_id) AS representative, count(*) AS members, row_number() OVER (PARTITION BY source ORDER BY lang) AS semantic FROM documents GROUP BY 1, 2)
SELECT source, CASE WHEN lang IS NULL OR members < 3 THEN 0 ELSE semantic END::BIGINT AS cluster, sum(members)::BIGINT AS members, string_agg(representative::VARCHAR, ',' ORDER BY representative::VARCHAR) AS representatives FROM g GROUP BY 1, 2""",
)
def cluster_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Groups of representatives expanded to their members; what is in no valid group is the leftover group 0."""
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("representative"), F.count("*").alias("members"))
    g = R.ranked(g, ["source"], [F.col("lang").asc_nulls_last()], "semantic")
    cluster = F.when(F.col("lang").isNull() | (F.col("members") < 3), 0).otherwise(F.col("semantic"))
    return g.groupBy("source", cluster.cast("long").alias("cluster")).agg(F.sum("members").cast("long").alias("members"), ids(F.col("representative").cast("string")).alias("representatives"))
