"""Graph fix-points as loops over DataFrames with columns src, dst.

Each round joins the frontier with the edges, keeps what is new by an anti-join and cuts the lineage with checkpoint(),
which writes to the session's shared checkpoint folder: executors may be lost at any time. A frontier is written once;
what was found so far is the union of the frontiers and is never written again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tracewright-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Found:
    """The rows of all rounds: their union, stored as one whenever there are 16 of them, so that plans stay small."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, frontier: DataFrame) -> None:
        self.parts.append(frontier)
        if len(self.parts) > 16:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def neighbours(edges: DataFrame, most: int = 4096) -> DataFrame:
    """src, dsts: the nodes behind each node, each once, in arrays of at most ``most``; stored and dealt in rounds at a fraction
    of the bytes of single edges. Edges without an end are left out."""
    each = edges.select("src", "dst").dropna().repartition("src").distinct()
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    return cut(each.withColumn("_n", F.floor((place - 1) / most)).groupBy("src", "_n").agg(F.collect_list("dst").alias("dsts")).drop("_n"))


#: Fixed value: a frontier of so many values is sent to all tasks, so that the edges aren't dealt for it.
FEW_VALUES = 400_000


def _behind(frontier: DataFrame, after: DataFrame, values: int) -> DataFrame:
    """The frontier's rows with src and dsts of their nodes (see neighbours); values: about how many numbers it holds."""
    frontier = F.broadcast(frontier) if values <= FEW_VALUES else frontier
    return after.join(frontier, frontier["node"] == after["src"])


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth for every node within depth steps of a seed (node); depth counts the fewest steps."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    found, step = Found(frontier), 0
    while depth is None or step < depth:
        step += 1
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(found.all(), "node", "left_anti").withColumn("depth", F.lit(step).cast("long")))
        if frontier.isEmpty():
            break
        found.add(frontier)
    return found.all()


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, length, path (array): of the shortest paths from each seed the lexicographically first."""
    edges = cut(edges.select("src", "dst").distinct())
    first = seeds.select(F.col("node").alias("seed"), "node").distinct()
    frontier = cut(first.withColumns({"length": F.lit(0).cast("long"), "path": F.array("node")}))
    found = Found(frontier)
    for step in range(1, depth + 1):
        grown = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        grown = grown.groupBy("seed", "node").agg(F.min("path").alias("path"))
        grown = grown.join(found.all().select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(grown.select("seed", "node", F.lit(step).cast("long").alias("length"), "path"))
        if frontier.isEmpty():
            break
        found.add(frontier)
    return found.all()


#: Fixed value: lists of so many seeds in all are sent to all tasks as one row, others are joined.
FEW_SEEDS = 1_000_000


def nearest_seeds(edges: DataFrame, seeds: DataFrame, depth: int, most: int = 32) -> DataFrame:
    """node, distance, seeds (sorted array): undirected distance to the nearest seeds and which ones they are.

    A node passes its seeds on one by one, or, if there are more than ``most`` of them, as a group by its own name; groups that
    it got are passed on as they are. So the rounds stay in proportion to the edges where the result, which lists the seeds of
    each node, grows faster. Groups become lists in the returned DataFrame, row by row, and are stored nowhere as such.
    """
    after = neighbours(edges.select("src", "dst").union(edges.select("dst", "src")))
    none = F.array().cast("array<long>")
    frontier = cut(seeds.select("node", F.lit(0).cast("long").alias("distance"), F.array("node").alias("seeds"), none.alias("groups")).dropDuplicates(["node"]))
    found, groups = Found(frontier), []
    left, values = after.select(F.col("src").alias("node")).distinct().join(frontier, "node", "left_anti").count(), 3 * frontier.count()
    for step in range(1, depth + 1):
        if not left:
            break
        many = F.size("seeds") > most
        groups.append(frontier.filter(many).select(F.col("node").alias("group"), "seeds"))
        passed = frontier.select("node", F.when(many, none).otherwise(F.col("seeds")).alias("seeds"), F.when(many, F.array_append("groups", F.col("node"))).otherwise(F.col("groups")).alias("groups"))
        null, kind = F.lit(None).cast("long"), "array<struct<seed: bigint, group: bigint>>"
        either = F.concat(F.transform("seeds", lambda x: F.struct(x, null)).cast(kind), F.transform("groups", lambda x: F.struct(null, x)).cast(kind))
        grown = _behind(passed, after, values).select(F.explode("dsts").alias("node"), either.alias("x")).select("node", F.explode("x").alias("x"))
        grown = grown.groupBy("node").agg(F.collect_set("x.seed").alias("seeds"), F.collect_set("x.group").alias("groups"))
        grown = grown.join(found.all().select("node"), "node", "left_anti")
        frontier = cut(grown.select("node", F.lit(step).cast("long").alias("distance"), "seeds", "groups"))
        rows, values = frontier.agg(F.count("*"), F.sum(2 + F.size("seeds") + F.size("groups"))).first()
        if not rows:
            break
        left -= rows
        found.add(frontier)
    return _listed(found.all(), reduce(DataFrame.union, groups) if groups else None)


def _listed(found: DataFrame, groups: DataFrame | None) -> DataFrame:
    """node, distance, seeds of found (node, distance, seeds, groups), with the seeds of the groups (group, seeds)."""
    size = groups.agg(F.sum(F.size("seeds"))).first()[0] if groups is not None else None
    if not size:
        return found.select("node", "distance", F.sort_array("seeds").alias("seeds"))
    alone, rest = found.filter("size(groups) = 0"), found.filter("size(groups) > 0")
    if size <= FEW_SEEDS:
        every = groups.agg(F.map_from_entries(F.collect_list(F.struct("group", "seeds"))).alias("_all"))
        lists = F.flatten(F.transform("groups", lambda g: F.element_at("_all", g)))
        rest = rest.crossJoin(F.broadcast(every)).select("node", "distance", F.array_distinct(F.concat("seeds", lists)).alias("seeds"))
    else:
        single = rest.select("node", "distance", F.explode("groups").alias("group")).join(groups, "group").select("node", "distance", F.explode("seeds").alias("seed"))
        single = single.union(rest.select("node", "distance", F.explode("seeds")))
        rest = single.groupBy("node", "distance").agg(F.collect_set("seed").alias("seeds"))
    return alone.select("node", "distance", "seeds").union(rest).withColumn("seeds", F.sort_array("seeds"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for edges (src, dst) of longs; see contracted_components."""
    return contracted_components(edges)


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _mixing(step: int) -> tuple[Column, int]:
    """By what and how far a round's order flips and turns the bits of nodes."""
    return F.lit((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 63)), 1 + (37 * step + 60) % 63


def _mixed(node: Column, step: int) -> Column:
    """Another long for each long, one to one: the order of nodes in a round."""
    flip, by = _mixing(step)
    return _turned(node.bitwiseXOR(flip), by)


def _unmixed(x: Column, step: int) -> Column:
    flip, by = _mixing(step)
    return _turned(x, 64 - by).bitwiseXOR(flip)


#: Fixed value: so few edges are solved by the driver, as the rounds that thin out a small star are many.
FEW_EDGES = 50_000


def least_ends(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node with one node of its component, the same for all."""
    to: dict[int, int] = {}

    def end(x: int) -> int:
        while to.setdefault(x, x) != x:
            to[x] = x = to[to[x]]
        return x

    for a, b in edges:
        a, b = end(a), end(b)
        to[max(a, b)] = min(a, b)
    return [(x, end(x)) for x in list(to)]


def contracted_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for edges (src, dst) of longs.

    In a round each node goes to the least of itself and its neighbours, in an order that is drawn anew, and edges follow
    their ends, each pair once. Fewer nodes are left each time, so all rounds together write a few times the
    edges, and no node gathers those of its component. The last FEW_EDGES are solved at once. What a node went to is stored
    with the least node that it stands for; at the end the rounds are read backwards.
    """
    now = edges.select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b"))
    now = cut(now.dropna().distinct())
    alone = now.filter("a = b").select(F.col("a").alias("node"))
    now, stands, rounds, step = now.filter("a <> b"), None, [], 0
    while True:
        both = now.select(F.col("a").alias("node"), "b").union(now.select("b", "a"))
        goes = both.groupBy("node").agg(F.min(_mixed(F.col("b"), step)).alias("to"))
        goes = goes.select("node", _unmixed(F.least("to", _mixed(F.col("node"), step)), step).alias("to"))
        few = now.limit(FEW_EDGES + 1).collect()
        if len(few) <= FEW_EDGES:
            goes = now.sparkSession.createDataFrame(least_ends([(x["a"], x["b"]) for x in few]), "node long, to long")
        if stands is None:  # a node stands for itself
            at = cut(goes.join(alone, "node", "full").select("node", F.col("node").alias("least"), "to"))
        else:
            at = cut(stands.join(goes, "node", "left"))
        rounds.append(at)
        step += 1
        moved = at.filter("to is not null")
        if moved.isEmpty():
            break
        first, second = (moved.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        now = now.join(first, "a").join(second, "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        stands, now = moved.groupBy(F.col("to").alias("node")).agg(F.min("least").alias("least")), cut(now)
    found = rounds.pop().select("node", "least")
    while rounds:
        last = found.select(F.col("node").alias("_to"), F.col("least").alias("_least"))
        at = rounds.pop().withColumn("_to", F.col("to"))
        found = at.join(last, "_to", "left").select("node", F.coalesce("_least", "least").alias("least"))
        found = cut(found) if len(rounds) % 4 == 1 else found
    return found.withColumnRenamed("least", "component")


def dominators(edges: DataFrame, root: int) -> DataFrame:
    """node, dominator: every node on all paths from the root, for nodes that it reaches.

    Breadth first, a node gets its dominators on the shortest ways to it, from the root down: the common start of those of
    the nodes before it, which is that of the least and the greatest of them. If no edge leads elsewhere than one step
    further, that is all, and each edge has been looked at once. Else it is where ``_relaxed_dominators`` starts from.
    """
    after = neighbours(edges)
    frontier = edges.sparkSession.createDataFrame([(root,)], "node long").withColumn("path", F.array("node"))
    found, layered, rows, step = Found(frontier), True, 1, 1
    shared = F.expr("slice(low, 1, coalesce(nullif(array_position(zip_with(low, high, (x, y) -> x <=> y), false), 0) - 1, size(low)))")
    while True:
        sent = _behind(frontier, after, rows * step).select("src", F.explode("dsts").alias("node"), "path")
        sent = sent.filter((F.col("node") != F.col("src")) & (F.col("node") != root)).select("node", "path").repartition("node")
        came = sent.groupBy("node").agg(F.min("path").alias("low"), F.max("path").alias("high"))
        came = came.join(found.all().select("node", F.lit(True).alias("known")), "node", "left")
        came = cut(came.select("node", F.concat(shared, F.array("node")).alias("path"), "known"))
        layered = layered and came.filter("known").isEmpty()
        frontier = came.filter("known is null").drop("known")
        rows, step = frontier.count(), step + 1
        if not rows:
            break
        found.add(frontier)
    if layered:
        return found.all().select("node", F.explode("path").alias("dominator"))
    single = after.select("src", F.explode("dsts").alias("dst")).filter(F.col("dst") != root)
    return _relaxed_dominators(single, found.all().select("node", F.array_sort("path").alias("dom")))


def _relaxed_dominators(edges: DataFrame, now: DataFrame) -> DataFrame:
    """The iterative rule dom(n) = {n} + intersection of dom(predecessors), on sorted arrays, from now (node, dom), which
    holds all nodes that are reached and may have too many dominators, but none too few."""
    now = cut(now)
    while True:
        known = edges.join(now.withColumnRenamed("node", "src"), "src")
        counts = known.groupBy("dst").agg(F.count("*").alias("n"))
        # A dominator of n dominates each predecessor.
        shared = known.select("dst", F.explode("dom").alias("d")).groupBy("dst", "d").agg(F.count("*").alias("c")).join(counts, "dst").filter("c = n")
        new = shared.groupBy("dst").agg(F.array_sort(F.collect_list("d")).alias("up")).select(F.col("dst").alias("node"), F.array_sort(F.array_union("up", F.array("dst"))).alias("new"))
        joined = cut(now.join(new, "node", "left").select("node", "dom", F.coalesce("new", "dom").alias("new")))
        if joined.filter("not (dom <=> new)").isEmpty():
            return joined.select("node", F.explode("dom").alias("dominator"))
        now = joined.select("node", F.col("new").alias("dom"))
