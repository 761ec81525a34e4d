"""Totals, rates, gates, verdicts and clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions.scalars import wilson


def strict_sum(value: Column) -> Column:
    """The sum; null if there is no row or any value is null."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(value) == F.count(F.lit(1))), F.sum(value))


def rate(df: DataFrame, groups: Sequence[str], hit: Column) -> DataFrame:
    """n, hits, rate and its 95 % Wilson interval for each group."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).cast("long").alias("n"), F.coalesce(F.sum(hit.cast("int")), F.lit(0)).cast("long").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counts.withColumns({"rate": F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 6)), "low": low, "high": high})


def rate_at_k(df: DataFrame, run: str, index: str, hit: Column, ks: Sequence[int]) -> DataFrame:
    """For each k the share of runs with a hit at an index up to k."""
    first = df.groupBy(run).agg(F.min(F.when(hit, F.col(index))).alias("_first"))
    each = first.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rate(each, ["k"], F.coalesce(F.col("_first") <= F.col("k"), F.lit(False)))


def verdicts(df: DataFrame, key: Sequence[str], verdict: str) -> DataFrame:
    """One verdict a key: the only one given, or conflict."""
    given = df.groupBy(*key).agg(F.array_sort(F.collect_set(verdict)).alias("_v"))
    return given.select(*key, F.when(F.size("_v") == 0, "unknown").when(F.size("_v") == 1, F.get("_v", F.lit(0))).otherwise("conflict").alias("verdict"))


def confusion(df: DataFrame, groups: Sequence[str], outcome: str) -> DataFrame:
    """tp, fp, fn, precision and recall, with denominators of at least 1."""
    count = lambda x: F.sum((F.col(outcome) == x).cast("long")).alias(x)
    counts = df.groupBy(*groups).agg(count("tp"), count("fp"), count("fn"))
    share = lambda x: F.round(F.col("tp") / F.greatest(F.lit(1).cast("long"), F.col("tp") + F.col(x)), 6)
    return counts.withColumns({"precision": share("fp"), "recall": share("fn")})


def clusters(df: DataFrame, signature: Sequence[str], order: Sequence[str], route: str) -> DataFrame:
    """For each signature its size, its first member in the order and its number of routes."""
    return df.groupBy(*signature).agg(F.count(F.lit(1)).cast("long").alias("members"), F.min(F.struct(*order)).alias("first"), F.countDistinct(route).cast("long").alias("routes"))


def longest_run(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The longest run of consecutive integers of each group."""
    runs = merged_ranges(df.select(*groups, F.col(value).alias("_s"), F.col(value).alias("_e")).distinct(), groups, "_s", "_e")
    return runs.groupBy(*groups).agg(F.max(F.col("_e") - F.col("_s") + 1).cast("long").alias("longest"))


def _merged(df: DataFrame, groups: Sequence[str], start: str, end: str) -> DataFrame:
    w = W.partitionBy(*groups).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col(start) > F.coalesce(reach, F.col(start) - 2) + 1, 1).otherwise(0)
    marked = df.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*groups, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def merged_ranges(df: DataFrame, groups: Sequence[str], start: str, end: str, width: int = 4096) -> DataFrame:
    """Closed integer ranges, merged where they overlap or touch.

    First within cells of width starts, so that a group of any size is sorted by many tasks; then what is left of each.
    """
    cells = df.select(*groups, start, end).withColumn("_cell", F.floor(F.col(start) / width))
    return _merged(_merged(cells, [*groups, "_cell"], start, end).drop("_cell"), groups, start, end)


def gates(actual: DataFrame, required: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row a gate of a one-row table: gate, actual, required, passed. A missing value fails.

    required: (column, ">=" or "<=", limit).
    """
    rows = [
        F.struct(
            F.lit(name).alias("gate"),
            F.col(name).cast("double").alias("actual"),
            F.lit(float(limit)).alias("required"),
            F.coalesce(F.col(name) >= limit if sign == ">=" else F.col(name) <= limit, F.lit(False)).alias("passed"),
        )
        for name, sign, limit in required
    ]
    return actual.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def digest_tree(rows: DataFrame, keys: Sequence[str], id: str, entry: Column, name: str, fan: int = 4096, levels: int = 2) -> DataFrame:
    """keys and name: the root of a tree of digests over each key's entries in the order of id (whole numbers, not negative).

    A leaf is an entry; a node is the SHA-256 of what is below it, joined by line feeds, for each range of fan ids, then of
    fan ranges, and so on; the root that of the nodes of the last level. No task holds more than fan entries, or the last
    level, of a key. Entries of one id are in their own order; those without id are a range of their own.
    """
    now = rows.select(*keys, F.col(id).alias("_i"), entry.alias("_e"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_e"))), lambda x: x["_e"]), "\n"), 256)
    for _ in range(levels):
        now = now.groupBy(*keys, F.floor(F.col("_i") / fan).alias("_i")).agg(digest.alias("_e"))
    return now.groupBy(*keys).agg(digest.alias(name))


def carried_sum(rows: DataFrame, keys: Sequence[str], id: str, size: str, name: str, fan: int = 4096, levels: int = 2) -> DataFrame:
    """rows with name: the sum of size over the rows of the key up to and with the row, in the order of id.

    Windows span fan ids; the sums of ranges are summed up in the same way and carried in, so a key of any size is spread.
    Rows of one id share a sum, that of all of them; those without id come first. Null keys are a key; null sizes count 0.
    """
    here = f"_range{levels}"
    ranged = rows.withColumn(here, F.floor(F.col(id) / fan))
    sums = ranged.groupBy(*keys, here).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_s"))
    if levels > 1:
        sums = carried_sum(sums, keys, here, "_s", "_upto", fan, levels - 1)
    else:
        sums = sums.withColumn("_upto", F.sum("_s").over(W.partitionBy(*keys).orderBy(here)))
    names = [*keys, here]
    carried = sums.select(*[F.col(k).alias(f"_of_{k}") for k in names], (F.col("_upto") - F.col("_s")).alias("_before"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names))
    inside = F.coalesce(F.sum(size).over(W.partitionBy(*keys, here).orderBy(id)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(carried, same).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
