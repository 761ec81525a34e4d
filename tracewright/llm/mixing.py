"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order fixed by a hash of doc_id, are cut into blocks. With integer weights w of the
sources that still have blocks, and Q their sum, block j of a source (from 0) is released at slot floor(j * Q / w) and due
by slot ceil((j + 1) * Q / w). One block goes out in each slot: of the released ones that with the earliest deadline,
ties to the larger weight, then the source's name. So after any number of slots each source is less than one block away
from its share. When a source runs out, a new phase begins in which the others share the slots by their weights; every
row is in the result once.

Scale. The schedule repeats after Q slots, so the driver plans one frame a phase (at most ``max_sources`` phases of at
most ``max_frame`` slots each) and a row's slot follows from its block number. Block numbers come from ranks within
(source, hash range) and prefix sums of the counts of these ranges: a source that holds a third of all rows is ranked by
many tasks. The plan, bounded as above, is broadcast; documents are shuffled once.

Defined cases. Null source: a source of its own. Null or repeated doc_id: rows like others, ordered by hash, id and text.
Empty table: no rows. Weights must be positive integers; sources without one get weight 1. All columns stay as they are,
whatever their names; added columns get names that none of them has.
"""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.storage import free_names

_PLAN = "_key string, _phases array<struct<first_block: long, last_block: long, base_slot: long, base_row: long, frame: long, at: array<int>>>"


def frame(weights: dict[str, int]) -> list[str]:
    """One period of the earliest-deadline-first schedule: the source of each of sum(weights) slots."""
    total = sum(weights.values())
    coming = [(0, s, 0) for s in weights]  # release, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), -weights[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(coming, ((j + 1) * total // weights[s], s, j + 1))
    return out


def plan(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> dict[str, list[tuple]]:
    """For each source its phases: first and last block, base slot, base row, frame length, places in the frame."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[tuple]] = {s: [] for s in left}
    slot = row = 0
    while left:
        divisor = math.gcd(*(weights[s] for s in left))
        slots = frame({s: weights[s] // divisor for s in left})
        places: dict[str, list[int]] = {s: [] for s in left}
        for k, s in enumerate(slots):
            places[s].append(k)
        q = len(slots)
        ends = {s: (n - 1) // len(places[s]) * q + places[s][(n - 1) % len(places[s])] for s, n in left.items()}
        over = min(ends, key=ends.get)
        end = ends[over]
        for s in left:
            full, rest = divmod(end + 1, q)
            n = full * len(places[s]) + sum(k < rest for k in places[s])
            if n:
                out[s].append((done[s], done[s] + n - 1, slot, row, q, places[s]))
            done[s] += n
            left[s] -= n
        row += end * block_rows + rows[over] - (done[over] - 1) * block_rows
        slot += end + 1
        left = {s: n for s, n in left.items() if n}
    return out


def tempered(rows: dict[str, int], power: float, total: int) -> dict[str, int]:
    """Integer weights about in proportion to rows ** power that sum to about total, 1 at least."""
    mass = {s: n**power for s, n in rows.items()}
    return {s: max(1, round(total * m / sum(mass.values()))) for s, m in mass.items()}


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _planned(docs: DataFrame, weights: dict[str | None, int] | None, block_rows: int, power: float, max_sources: int, max_frame: int) -> tuple[DataFrame, int]:
    """docs and three columns named by free_names: block, slot and position; and how many rows there are."""
    spark = docs.sparkSession
    key, mark, span, before, rank, phases, nth, phase, j, within = free_names(docs.columns, "key", "hash", "range", "before", "rank", "phases", "nth", "phase", "j", "within")
    block, slot, position = free_names(docs.columns, "block", "slot", "position")
    keyed = docs.withColumns({key: _key(F.col("source")), mark: F.xxhash64(F.col("doc_id").cast("string"))})
    counted = keyed.groupBy(key).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    rows = {r[key]: r["n"] for r in counted}
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if weights is None:
        chosen = tempered(rows, power, max(1000, 4 * len(rows)))
    else:
        given = {"n" if s is None else f"s{s}": int(w) for s, w in weights.items()}
        chosen = {s: given.get(s, 1) for s in rows}
    if min(chosen.values(), default=1) < 1 or sum(chosen.values()) > max_frame:
        raise ValueError(f"weights must be positive integers that sum to {max_frame} at most")
    planned = spark.createDataFrame(sorted(plan(rows, chosen, block_rows).items()), _PLAN).toDF(key, phases)
    total = sum(rows.values())
    bits = max(8, math.ceil(math.log2(max(1, total / 20000))))
    keyed = keyed.withColumn(span, F.shiftrightunsigned(mark, 64 - bits))
    # The counts of the ranges: 2**bits of them a source.
    counts = keyed.groupBy(key, span).agg(F.count("*").alias("n"))
    sums = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy(span).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, span, sums.alias(before))
    order = [F.col(mark), F.col("doc_id")] + ([F.xxhash64("text")] if "text" in docs.columns else [])
    ranked = keyed.withColumn(rank, F.row_number().over(W.partitionBy(key, span).orderBy(*order))).join(counts, [key, span])
    ranked = ranked.withColumn(nth, F.col(before) + F.col(rank) - 1).join(F.broadcast(planned), key)
    ranked = ranked.withColumn(block, F.floor(F.col(nth) / block_rows).cast("long"))
    found = F.get(F.filter(phases, lambda p: (p["first_block"] <= F.col(block)) & (F.col(block) <= p["last_block"])), F.lit(0))
    ranked = ranked.withColumn(phase, found).withColumn(j, F.col(block) - F.col(f"{phase}.first_block"))
    n = F.size(f"{phase}.at")
    ranked = ranked.withColumn(within, F.floor(F.col(j) / n).cast("long") * F.col(f"{phase}.frame") + F.get(f"{phase}.at", (F.col(j) % n).cast("int")))
    ranked = ranked.withColumn(slot, F.col(f"{phase}.base_slot") + F.col(within))
    ranked = ranked.withColumn(position, F.col(f"{phase}.base_row") + F.col(within) * block_rows + F.col(nth) % block_rows)
    return ranked.select(*docs.columns, block, slot, position), total


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 16, power: float = 0.5, max_sources: int = 512, max_frame: int = 1 << 16) -> DataFrame:
    """docs with _block (number within the source), _slot and _position (place in the mixture, from 0).

    weights: by source; None: in proportion to rows ** power, in thousandths. If docs has columns that begin with
    underscores, the three new ones begin with more of them than any (see free_names).
    """
    return _planned(docs, weights, block_rows, power, max_sources, max_frame)[0]


def mixture(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 16, power: float = 0.5, max_sources: int = 512, max_frame: int = 1 << 16) -> DataFrame:
    """docs in the order of the mixture: partitions are equal ranges of positions, sorted, with all columns and rows.

    A row's partition follows from its position and the number of rows, so nothing is sampled or stored for it.
    """
    placed, total = _planned(docs, weights, block_rows, power, max_sources, max_frame)
    position = placed.columns[-1]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(position) * parts / max(1, total)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions(position).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """Stored docs and, last, their place from 0 by file and row: for a stored mixture the place in the mixture.

    The column is _position, with more underscores if docs has columns that begin with some.
    """
    file, row, base_row = free_names(docs.columns, "file", "row", "base")
    at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    # One row a file.
    files = [(r[file], r["n"]) for r in at.groupBy(file).agg((F.max(row) + 1).alias("n")).collect()]
    files.sort(key=lambda x: (int((re.findall(r"part-(\d+)", x[0]) or [0])[-1]), x[0]))
    before, base = 0, []
    for name, n in files:
        base.append((name, before))
        before += n
    bases = docs.sparkSession.createDataFrame(base, "file string, base long").toDF(file, base_row)
    return at.join(F.broadcast(bases), file).select(*docs.columns, (F.col(base_row) + F.col(row)).alias(free_names(docs.columns, "position")[0]))
