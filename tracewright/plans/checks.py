"""Reads a DataFrame's physical plan before it runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df: DataFrame) -> list[str]:
    """The kinds of the plan's joins, in its order."""
    return re.findall(r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\b", physical(df))


def exchanges(df: DataFrame) -> int:
    """How often rows are shuffled."""
    return len(re.findall(r"\bExchange (?:hash|range|Round|Single)", physical(df)))


def scans(df: DataFrame) -> list[tuple[list[str], str]]:
    """Of each scan the columns that it reads and the filters that it pushes down."""
    found = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>(?:\n|$)", physical(df))
    return [(re.findall(r"(?:^|,)(\w+):", schema), filters) for filters, schema in found]


def products(df: DataFrame) -> bool:
    """Whether the plan forms pairs other than by equality."""
    return any(j in ("BroadcastNestedLoopJoin", "CartesianProduct") for j in joins(df))
