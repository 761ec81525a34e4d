"""Joins that pick, contain, overlap, precede or match best. Every choice has a total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pick_one(left: DataFrame, right: DataFrame, on: Column, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each left row (identified by key) with the first right row in the given order; left rows without a match stay."""
    joined = left.join(right, on, "left")
    return joined.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


_LEVELS = 12


def _level(start: str, end: str, width: int) -> Column:
    """The least level whose cells, width * 4**level long, are no shorter than the span."""
    out = F.lit(_LEVELS)
    for k in reversed(range(_LEVELS)):
        out = F.when(F.col(end) - F.col(start) < width * 4**k, k).otherwise(out)
    return out


def _cells(level: Column, start: str, end: str, width: int) -> Column:
    size = F.lit(width) * F.pow(F.lit(4.0), level)
    return F.explode(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor(F.col(end) / size).cast("long")))


def _levels(*spans: DataFrame) -> list[int]:
    """The levels that occur, thirteen at most."""
    found = spans[0].select("_level")
    for s in spans[1:]:
        found = found.union(s.select("_level"))
    return sorted(r["_level"] for r in found.distinct().collect())


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int, keys: Sequence[str] = (), closed: bool = True, how: str = "inner") -> DataFrame:
    """Pairs with start <= point <= end (or < end), equal in keys; how: inner or left.

    A span lies in one or two cells of a grid whose cells are no shorter than it, so long spans don't become many rows; a
    point looks into its cell of each grid that occurs (of thirteen). The join is an equality join, which distributes.
    width: the finest grid's cells, near a usual span's length. Columns must be numbers and differ by name, but for keys.
    """
    spans = spans.filter(F.col(start) <= F.col(end)).withColumn("_level", _level(start, end, width))
    grids = _levels(spans) or [0]
    spread = spans.withColumn("_cell", _cells(F.col("_level"), start, end, width)).withColumnsRenamed({k: f"_{k}" for k in keys} | {"_level": "_l", "_cell": "_c"})
    placed = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in grids])))
    placed = placed.withColumn("_cell", F.floor(F.col(point) / (F.lit(width) * F.pow(F.lit(4.0), F.col("_level")))).cast("long"))
    on = (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c")) & (F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    inner = placed.join(spread, on).drop("_level", "_cell", "_l", "_c", *[f"_{k}" for k in keys])
    if how == "inner":
        return inner
    # Points in no span, once each: a point is looked up in several grids, so an outer join would repeat it.
    met = inner.select(*[F.col(c).alias(f"_i_{c}") for c in points.columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_i_{c}")) for c in points.columns]
    rest = points.join(met, reduce(and_, same), "left_anti")
    return inner.unionByName(rest, allowMissingColumns=True)


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of closed intervals that overlap, equal in keys; each pair once, found in the cell of the later start.

    Two spans meet in the grid of the longer one (see range_join), so a span goes to its own grid and the coarser ones
    that occur, into one or two cells of each.
    """
    a, b = (df.withColumn("_level", _level(*s, width)) for df, s in ((a, a_span), (b, b_span)))
    grids = F.array(*[F.lit(k) for k in _levels(a, b) or [0]])

    def spread(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        out = df.withColumn("_grid", F.explode(F.filter(grids, lambda g: g >= F.col("_level"))))
        return out.withColumn("_cell", _cells(F.col("_grid"), *span, width)).withColumnRenamed("_level", name)

    joined = spread(a, a_span, "_own_a").join(spread(b, b_span, "_own_b"), [*keys, "_grid", "_cell"])
    meets = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    size = F.lit(width) * F.pow(F.lit(4.0), F.col("_grid"))
    first = F.col("_cell") == F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / size)
    return joined.filter(meets & first & (F.col("_grid") == F.greatest("_own_a", "_own_b"))).drop("_cell", "_grid", "_own_a", "_own_b")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the payload of the right row of equal keys and the greatest (at, tie) not after it.

    Both sides are shuffled once, together, instead of a band join that forms all pairs. A right row at the same moment
    counts as before. Columns of the payload must not occur on the left.
    """
    names = list(left.columns)
    a = left.withColumn("_side", F.lit(1)).withColumn("_pay", F.lit(None).cast(right.select(F.struct(*payload).alias("x")).schema["x"].dataType)).withColumn("_tie", F.lit(None).cast(dict(right.dtypes)[tie]))
    types = dict(left.dtypes)
    fill = [F.col(c) if c in (*keys, at) else F.lit(None).cast(types[c]).alias(c) for c in names]
    b = right.select(*fill, F.lit(0).alias("_side"), F.struct(*payload).alias("_pay"), F.col(tie).alias("_tie"))
    w = W.partitionBy(*keys).orderBy(at, "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = a.unionByName(b).withColumn("_last", F.last("_pay", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*names, "_last.*")


def best_match(candidates: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best candidate of each key."""
    return candidates.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def spread_join(left: DataFrame, right: DataFrame, on: tuple[str, str], parts: int = 64) -> DataFrame:
    """Pairs that agree in (left column, right column), for keys of many rows on both sides.

    The left rows of a key are dealt over parts by their hash and the right ones go to each, so that a key's pairs are
    formed by many tasks; the right side should be the smaller one. Pairs are many where rows are few: neither a broadcast
    nor merged partitions, which go by the rows' size, would leave enough tasks.
    """
    a = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    b = right.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    a, b = a.repartition(parts, on[0], "_part"), b.repartition(parts, on[1], "_at").hint("merge")
    return a.join(b, (a[on[0]] == b[on[1]]) & (a["_part"] == b["_at"])).drop("_part", "_at")


def match_either(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct pairs that agree in any of the (left column, right column) conditions: a union of equality joins.

    Rows are made distinct before they meet and a pair is left to the first condition that holds, so pairs, which may be
    many more than rows, aren't compared with one another.
    """
    left, right = left.distinct(), right.distinct()
    found, earlier = None, F.lit(False)
    for a, b in conditions:
        joined = spread_join(right, left, (b, a)).select(*left.columns, *right.columns).filter(~earlier)
        earlier |= F.coalesce(F.col(a) == F.col(b), F.lit(False))
        found = joined if found is None else found.unionByName(joined)
    return found


def expected_and_observed(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of both sides with outcome tp, fn or fp."""
    e, o = (df.select(*keys).distinct().withColumn(f"_{n}", F.lit(True)) for n, df in (("e", expected), ("o", observed)))
    both = e.join(o, list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("_e") & F.col("_o"), "tp").when(F.col("_e"), "fn").otherwise("fp").alias("outcome"))
