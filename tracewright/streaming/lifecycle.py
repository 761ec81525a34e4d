"""Life cycles: allowed transitions, idempotent replay, leases; over stored logs and over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transitions(log: DataFrame, entity: str, order: Sequence[str], state: str) -> DataFrame:
    """The log with from_state, the state before each row; null for the first."""
    return log.withColumn("from_state", F.lag(state).over(W.partitionBy(entity).orderBy(*order)))


def illegal(log: DataFrame, entity: str, order: Sequence[str], state: str, allowed: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows of the log whose transition isn't in the edge table, which is a constant and therefore small."""
    edges = log.sparkSession.createDataFrame(sorted(allowed), "from_state string, to_state string")
    stepped = transitions(log, entity, order, state).filter("from_state is not null")
    return stepped.join(F.broadcast(edges), (stepped["from_state"] == edges["from_state"]) & (stepped[state] == edges["to_state"]), "left_anti")


def replays(log: DataFrame, entity: str, key: str, state: str) -> DataFrame:
    """Per entity and idempotency key: n rows, and whether it is a first use, a replay or a conflict."""
    used = log.groupBy(entity, key).agg(F.count(F.lit(1)).cast("long").alias("n"), F.countDistinct(state).alias("_d"))
    return used.select(entity, key, "n", F.when(F.col("_d") > 1, "conflict").when(F.col("n") > 1, "replay").otherwise("first").alias("outcome"))


def leases(beats: DataFrame, entity: str, order: Sequence[str], at: str, seconds: int) -> DataFrame:
    """The log with expires (at + seconds), renewed (a later row of the entity came in time) and attempt.

    A lease that runs out before the next row makes that row a new attempt, counted from 1.
    """
    w = W.partitionBy(entity).orderBy(*order)
    late = F.coalesce(F.col(at).cast("timestamp") > F.lag(F.col(at).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))).over(w), F.lit(False))
    out = beats.withColumn("expires", F.col(at) + F.make_dt_interval(secs=F.lit(seconds)))
    out = out.withColumn("renewed", F.coalesce(F.lead(at).over(w) <= F.col("expires"), F.lit(False)))
    return out.withColumn("_late", late.cast("int")).withColumn("attempt", (1 + F.sum("_late").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long")).drop("_late")


def stream_leases(beats: DataFrame, seconds: int, lateness: int = 600, forget: int = 86_400) -> DataFrame:
    """leases() over a stream of (entity string, at timestamp): entity, at, attempt, by a state per entity.

    A beat waits in the state until the watermark (lateness seconds behind the latest beat) has passed it, so beats are
    counted in the order of their times whatever batches bring them; later ones are dropped by the watermark. An entity
    that is silent for forget seconds after its lease ran out is forgotten, and its attempts start again.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expires, attempt, waiting = state.get if state.exists else (None, 1, [])
        waiting = sorted([*waiting, *(at.timestamp() for batch in batches for at in batch["at"])])
        mark, rows = state.getCurrentWatermarkMs() / 1000, []
        while waiting and waiting[0] <= mark:
            at = waiting.pop(0)
            if expires is not None and at > expires:
                attempt += 1
            expires = at + seconds
            rows.append((key[0], pd.Timestamp(at, unit="s"), attempt))
        wake = waiting[0] if waiting else (expires or mark) + forget
        if wake <= mark and not waiting:
            state.remove()
        else:
            state.update((expires, attempt, waiting))
            state.setTimeoutTimestamp(int(max(wake, mark) * 1000) + 1)
        yield pd.DataFrame(rows, columns=["entity", "at", "attempt"])

    marked = beats.withWatermark("at", f"{lateness} seconds")
    return marked.groupBy("entity").applyInPandasWithState(update, "entity string, at timestamp, attempt long", "expires double, attempt long, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only log of JSON lines with ts and type; other fields stay in payload."""
    lines = spark.readStream.text(folder).filter("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", "ts string, type string", {"mode": "FAILFAST"}).alias("e"), F.col("value").alias("payload"))
    return parsed.select(F.to_timestamp("e.ts").alias("ts"), F.col("e.type").alias("type"), "payload")
