"""Total orders, top-k, quota admission, budgets and ordered packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based dense position within each group under a total order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group; Spark limits each task's groups before the shuffle."""
    return ranked(df, groups, order).filter(F.col("rank") <= k)


def quota_admission(df: DataFrame, groups: Sequence[str], kind: str, order: Sequence[Column], slots: int, shares: dict[str, int]) -> DataFrame:
    """Admits up to slots rows of each group: each kind its percentage of the slots (the first kind rounded up, the others
    down), and slots that a kind leaves free go to the remaining rows by the kinds' sequence and the order.

    Adds admitted and reason (quota, borrowed or max_slots). Closed form: ranks against quotas, then one more rank.
    """
    place = F.lit(len(shares))
    quota = F.lit(0)
    for i, (name, percent) in reversed(list(enumerate(shares.items()))):
        amount = -(-slots * percent // 100) if i == 0 else slots * percent // 100
        place, quota = F.when(F.col(kind) == name, i).otherwise(place), F.when(F.col(kind) == name, amount).otherwise(quota)
    own = W.partitionBy(*groups, kind).orderBy(*order)
    df = df.withColumn("_place", place).withColumn("_in", F.row_number().over(own) <= quota)
    used = F.sum(F.col("_in").cast("int")).over(W.partitionBy(*groups))
    rest = F.row_number().over(W.partitionBy(*groups, "_in").orderBy("_place", *order))
    df = df.withColumn("_used", used).withColumn("_rest", rest)
    borrowed = ~F.col("_in") & (F.col("_rest") <= slots - F.col("_used"))
    reason = F.when(F.col("_in"), "quota").when(borrowed, "borrowed").otherwise("max_slots")
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason") != "max_slots").drop("_place", "_in", "_used", "_rest")


def within_budget(df: DataFrame, groups: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Adds before, the sum of the sizes ahead of a row, and fits: whether the row ends within the budget."""
    ahead = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum(size).over(ahead), F.lit(0)).cast("long"))
    return df.withColumn("fits", F.col("before") + F.col(size) <= budget)


def waves(df: DataFrame, groups: Sequence[str], order: Sequence[Column], width: int) -> DataFrame:
    """Adds wave: consecutive chunks of width rows."""
    nth = F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1
    return df.withColumn("wave", F.floor(nth / width).cast("long"))


def next_fit(df: DataFrame, group: str, order: str, size: str, capacity: int, separator: int = 0) -> DataFrame:
    """Adds bin: each row goes to the current bin if it fits, with a separator between rows, else to a new one.

    What a row does depends on all before it, so a group is folded in order, as a stream of sorted rows: a task holds one
    batch, whatever the group's size. Rows larger than the capacity get a bin of their own.
    """
    schema = df.schema.add("bin", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bin_, used = object(), 0, 0
        for batch in batches:
            bins = []
            for g, n in zip(batch[group], batch[size], strict=True):
                if g != last:
                    last, bin_, used = g, 0, int(n)
                elif used + separator + n <= capacity:
                    used += separator + int(n)
                else:
                    bin_, used = bin_ + 1, int(n)
                bins.append(bin_)
            yield batch.assign(bin=pd.Series(bins, index=batch.index, dtype="int64"))

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)
