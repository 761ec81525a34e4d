"""Greedy merging of overlapping slices, and evidence slices of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.operators.folds import ordered_fold
from tracewright.operators.graph import contracted_components, cut
from tracewright.operators.ranking import ranked


class Buckets:
    """The groups of one component so far. An index from elements to groups finds the ones that a slice overlaps."""

    def __init__(self, cap: int):
        self.cap = cap
        self.files: dict[str, set] = {}  # by the group's first slice
        self.of: dict[tuple, set] = {}

    def step(self, row: dict) -> list[tuple]:
        mine = [("n", x) for x in row["nodes"] or []] + [("e", x) for x in row["edges"] or []]
        sink = [("s", row["sink"])] if row["sink"] is not None else []
        files = set(row["files"] or [])
        free = self.of.get(sink[0], set()) if sink else set()
        met = free.union(*(self.of.get(x, ()) for x in mine))
        may = [g for g in met if g in free or len(files | self.files[g]) <= self.cap]
        group = min(may, key=lambda g: (len(self.files[g]), g), default=row["slice_id"])
        self.files.setdefault(group, set()).update(files)
        for x in mine + sink:
            self.of.setdefault(x, set()).add(group)
        return [(row["slice_id"], group, row["risk"], sorted(files))]

    def end(self) -> list[tuple]:
        return []


def slice_groups(slices: DataFrame, cap: int = 8) -> DataFrame:
    """group_id, slice_ids, files, risk: slices (slice_id string, risk, nodes, edges, files: arrays of strings, sink) merged.

    In the order of falling risk, then slice_id, a slice joins a group that has one of its nodes, edges or its sink, if the
    group's files stay within the cap or the group has its sink; of several the one with the fewest files, then the least
    first slice. Otherwise it opens a group. The rule depends on order, but groups never leave a connected component of
    shared elements: components are found first, and each is folded by itself, as a stream that holds its groups.

    Slices without elements are groups of their own; nulls in arrays are ignored; rows that repeat a slice_id are one
    slice, the first in order of all columns. Empty table: no rows.
    """
    clean = slices.select("slice_id", F.col("risk").cast("long").alias("risk"), *[F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))).alias(c) for c in ("nodes", "edges", "files")], "sink")
    clean = cut(clean.groupBy("slice_id").agg(F.min(F.struct("risk", "nodes", "edges", "files", "sink")).alias("x")).select("slice_id", "x.*"))
    # Components only deal slices to tasks, so hashes do: elements that share one would only unite two components.
    tagged = lambda tag, c: F.transform(c, lambda x: F.xxhash64(F.lit(tag), x))
    elements = F.concat(tagged("n", "nodes"), tagged("e", "edges"), F.array_compact(F.array(F.when(F.col("sink").isNotNull(), F.xxhash64(F.lit("k"), "sink")))))
    slice_ = F.xxhash64("slice_id")
    ends = clean.select(slice_.alias("src"), F.explode(elements).alias("_e"))
    # Each slice with the least one of an element that they share; an element of one slice links nothing.
    links = ends.withColumn("dst", F.min("src").over(W.partitionBy("_e"))).filter("src <> dst").select("src", "dst")
    parts = contracted_components(links)
    dealt = clean.withColumn("_s", slice_).join(parts.withColumnRenamed("node", "_s"), "_s", "left").withColumn("component", F.coalesce("component", "_s"))
    rows = dealt.select("component", (-F.col("risk")).alias("order"), "slice_id", "risk", "nodes", "edges", "files", "sink")
    merged = ordered_fold(rows, ["component"], ["order", "slice_id"], lambda: Buckets(cap), "slice_id string, first string, risk long, files array<string>")
    groups = merged.groupBy("component", "first").agg(F.array_sort(F.collect_list("slice_id")).alias("slice_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.max("risk").alias("risk"))
    return groups.select(F.concat(F.lit("group:"), F.array_join("slice_ids", "+")).alias("group_id"), "slice_ids", "files", "risk")


class Definitions:
    """One function's last definitions so far, of each name one, and the names that instructions with an own priority use.

    A node is an instruction's address and index, its operands, the blocks of its rows without an own priority, and whether
    a row has one. A task holds nodes that are the last to define a name, however many instructions there are.
    """

    def __init__(self):
        self.last: dict[str, list] = {}
        self.used: set[str] = set()
        self.node: list | None = None

    def step(self, row: dict) -> list[tuple]:
        at = (row["address"], row["index"])
        if self.node is None or self.node[0] != at:
            done, self.node = self._own(), [at, set(), [], False]
        else:
            done = []
        operands = [x for x in row["operands"] or [] if x is not None]
        if row["own"] is None:
            self.node[2].append(row["block"])
        else:
            self.node[3] = True
        self.node[1].update(operands)
        if row["result"] is not None:
            self.last[row["result"]] = self.node
        return done

    def _own(self) -> list[tuple]:
        """Of the node that has ended, if it has an own priority, rows that have none."""
        if self.node is None or not self.node[3]:
            return []
        self.used |= self.node[1]
        return [(block, *self.node[0], 3) for block in self.node[2]]

    def end(self) -> list[tuple]:
        out, names, steps, seen = self._own(), self.used, 0, set()
        while names:
            steps += 1
            nodes = {id(n): n for x in names if (n := self.last.get(x)) is not None and not n[3] and id(n) not in seen}
            seen |= nodes.keys()
            out += [(block, *n[0], min(6, 3 + steps)) for n in nodes.values() for block in n[2]]
            names = set().union(*(n[1] for n in nodes.values()))
        return out


def needed_instructions(instructions: DataFrame) -> DataFrame:
    """fn, block, address, index, priority of the instructions that have one: their own, or that of what needs them.

    instructions: fn, block, address, index, result, operands (array), own (priority or null). An instruction that defines
    an operand of one with priority p has min(6, max(4, p + 1)) at most; of several definitions of a name in a function the
    last by address and index counts. As own priorities are below 4, that is 3 plus the fewest steps from one that has
    its own: a function's last definitions are found in a stream of its sorted rows, and solved when they end.
    """
    place = ["fn", "block", "address", "index"]
    own = instructions.filter("own is not null").select(*place, F.col("own").cast("long").alias("priority"))
    types = dict(instructions.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in place[1:]) + ", priority long"
    # What neither defines nor has a priority is no reason for one.
    operands = F.when(F.col("result").isNotNull() | F.col("own").isNotNull(), F.col("operands"))
    rows = instructions.filter("fn is not null").select(*place, "result", operands.alias("operands"), "own")
    return own.unionByName(ordered_fold(rows, ["fn"], ["address", "index"], Definitions, schema))


def instruction_priorities(instructions: DataFrame) -> DataFrame:
    """instructions with priority, that of needed_instructions; null: not needed."""
    key = ["fn", "address", "index"]
    relaxed = needed_instructions(instructions.filter("result is not null or own is not null")).groupBy(*key).agg(F.max("priority").alias("_p"))
    return instructions.join(relaxed, key, "left").withColumn("priority", F.coalesce(F.col("own").cast("long"), F.col("_p"))).drop("_p")


def evidence_slices(instructions: DataFrame, most_instructions: int, most_blocks: int) -> DataFrame:
    """fn, block, priority, address (the block's best), kept (indexes of instructions), full, omitted, limited.

    Of a function the first ``most_instructions`` by priority, address and index are chosen; of their blocks the first
    ``most_blocks`` by best priority, its address and the block. limited: whether either bound left something out. A function
    without any such instruction has the first of its first block, and is limited.
    """
    rows, some = instructions, cut(needed_instructions(instructions))
    ordered = ranked(some, ["fn"], [F.col("priority"), F.col("address"), F.col("index")], "_place")
    chosen = ordered.filter(F.col("_place") <= most_instructions)
    best = F.min(F.struct("priority", "address"))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("address", "index"))), lambda x: x["index"])
    blocks = chosen.groupBy("fn", "block").agg(best.alias("b"), kept.alias("kept"))
    blocks = ranked(blocks, ["fn"], [F.col("b"), F.col("block")], "_block")
    counts = rows.groupBy("fn", "block").agg(F.count("*").alias("full"))
    whole = some.groupBy("fn").agg(F.count("*").alias("_n"))
    spans = blocks.groupBy("fn").agg(F.max("_block").alias("_m"))
    limits = whole.join(spans, "fn", "left").withColumn("limited", (F.col("_n") > most_instructions) | F.coalesce(F.col("_m") > most_blocks, F.lit(True)))
    some = blocks.filter(F.col("_block") <= most_blocks).join(limits.select("fn", "limited"), "fn").select("fn", "block", "b.priority", "b.address", "kept", "limited")
    bare = rows.join(whole.select(F.col("fn").alias("_f")), F.col("fn").eqNullSafe(F.col("_f")), "left_anti")
    bare = bare.groupBy("fn").agg(F.min(F.struct("block", "address", "index")).alias("_first"))
    none = bare.select("fn", "_first.block", F.lit(None).cast("long").alias("priority"), "_first.address", F.array("_first.index").alias("kept"), F.lit(True).alias("limited"))
    return some.union(none).join(counts, ["fn", "block"]).select("fn", "block", "priority", "address", "kept", "full", (F.col("full") - F.size("kept")).alias("omitted"), "limited")
