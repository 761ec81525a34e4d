"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct ``shingle``-word shingles after lower-casing A-Z; with fewer words, the whole sequence
as one shingle; without words, the empty set, linked with nothing. Two documents are linked if 100 * |A & B| is at least
``percent`` * |A | B|.

Method. Two permutations give all signature coordinates: the first scatters a shingle over a universe of 2**21 places,
the second, shifted circularly by k places, orders them for coordinate k. The coordinates of one shingle are therefore
one contiguous slice. Signatures are cut into bands; documents that agree in a whole band are candidates, and a candidate
counts only after its full shingle sets, recomputed from the whole texts, have been compared.

Scale. Documents with equal sets become one class first. A bucket proposes no set of pairs: each class is only tied to the
smallest class of its bucket, and the components of these ties are clusters that hold every candidate pair. A cluster's
texts go once to a task, which compares its classes there and returns a spanning forest of their links, so no table of
pairs exists anywhere. Within a task two classes are compared only if they are not connected yet and if their sizes, less
the shingles that no other class of the task has, still allow the similarity. A cluster of more than ``block_rows``
classes is dealt to blocks, and a task gets two blocks; one of more than ``giant_blocks`` blocks is first thinned by
verifying its ties, then taken bucket by bucket, where blocks of one component don't meet each other. Components are
found by alternating large-star and small-star steps, and at once where the edges are few. Each step is written to the shared folder. With 64 bands of 8 rows
a pair at a Jaccard similarity of 0.8 is missed with probability 8e-6.

Defined cases. Null text: empty set. Null doc_id: linked with nothing, component_id null, kept. Rows that share a doc_id
are rows like others, each judged by its own text; a component is named by the smallest doc_id in it. Empty table: no
rows. Extra columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import hashing
from tracewright.llm.storage import Scratch
from tracewright.operators.graph import FEW_EDGES, least_ends

_UNIVERSE = 1 << 21
#: What tells a set from others.
_SET = ["n_shingles", "low", "high"]
#: Documents whose signatures are held at a time.
_ROWS = 1024


class Shingler:
    """Distinct shingle hashes of the documents of an Arrow string array."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.hasher = hashing.WordHasher(5, lower=True)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, bounds = hashing.string_buffers(column)
        for i, j in hashing.runs(bounds, 1 << 20):
            part, edges = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            starts, ends, first = hashing.find_words(part, edges)
            words = self.hasher.words(part, starts, ends)
            windows = self.hasher.windows(words, self.shingle)
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a >= self.shingle:
                    yield np.unique(windows[a : b - self.shingle + 1])
                else:
                    yield self.hasher.windows(words[a:b], b - a) if b > a else words[:0]


class CirculantMinHash:
    """Signatures of bands * rows coordinates from two permutations."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(7)
        self.bands, self.rows = bands, rows
        self.scatter = rng.permutation(_UNIVERSE).astype(np.int32)
        order = rng.permutation(_UNIVERSE).astype(np.int32)
        width = bands * rows
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:width]]), width)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.scatter[(hashes % np.uint64(_UNIVERSE)).astype(np.int64)]
        return np.min([self.slices[at[k : k + 2048]].min(axis=0) for k in range(0, len(at), 2048)], axis=0)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each signature."""
        parts = signatures.astype(np.uint64).reshape(-1, self.bands, self.rows)
        key = np.tile(hashing.mix(np.arange(1, self.bands + 1, dtype=np.uint64)), (len(parts), 1))
        for k in range(self.rows):
            key = hashing.mix(key + parts[:, :, k])
        return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, two 64-bit digests of the set, and the band keys (null for an empty set)."""

    @hashing.trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = hashing.held(("signatures", shingle, bands, rows), lambda: (Shingler(shingle), CirculantMinHash(bands, rows)))
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            sizes, low, high, rest = [], [], [], []
            for s in shingler.sets(batch.column(2)):
                sizes.append(len(s))
                low.append(int(np.bitwise_xor.reduce(hashing.mix(s))) if len(s) else 0)
                high.append(int(np.add.reduce(hashing.mix(s ^ np.uint64(0x9E3779B97F4A7C15)))) if len(s) else 0)
                if len(s):
                    rest.append(sketch.signature(s))
            keys = sketch.keys(np.array(rest, dtype=np.int32).reshape(-1, bands * rows))
            full = np.array(sizes, dtype=np.int64) > 0
            offsets = pa.array(np.append(0, np.cumsum(full * bands)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(low, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(high, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "low", "high", "keys"],
            )

    return texts(docs).mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, low long, high long, keys array<long>")


def texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def once(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows without those that repeat a key of earlier rows of the same task, so that each key leaves a task once."""

    @hashing.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            new = np.zeros(len(keys), dtype=bool)
            for k, x in enumerate(keys):
                if x not in seen:
                    seen.add(x)
                    new[k] = True
            if new.any():
                yield batch if new.all() else batch.filter(pa.array(new))

    return rows.mapInArrow(run, rows.schema)


def jaccard_need(percent: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """How many shingles sets of these sizes must share with set i."""
    return lambda sizes, i: -(-percent * (sizes + sizes[i]) // (100 + percent))


def forest(sets: list[np.ndarray], labels: list[int], sides: list[int] | None, need: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
    """Places (i, j) of sets that share enough, as few as connect what such sets and equal labels connect.

    need: from all sizes and i, how many elements each set must share with set i, one at least. sides: sets of one side are
    not compared. Sets are arrays of distinct hashes and not empty.
    """
    k = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    _, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.add.reduceat((seen[ids] > 1).astype(np.int64), bounds[:-1])  # shingles that another set has as well
    weight = np.add.reduceat(seen[ids], bounds[:-1]) / sizes
    _, group = np.unique(np.array(labels, dtype=np.int64), return_inverse=True)
    side = None if sides is None else np.array(sides)
    flag, left, out = np.zeros(len(seen), dtype=np.int64), np.ones(k, dtype=bool), []
    # Sets of common shingles first: they connect most.
    for i in np.argsort(-weight, kind="stable").tolist():
        left[i] = False
        least = need(sizes, i)
        may = left & (group != group[i]) & (np.minimum(common, common[i]) >= least)
        if side is not None:
            may &= side != side[i]
        if not may.any():
            continue
        mine = ids[bounds[i] : bounds[i + 1]]
        flag[mine] = 1
        others = np.flatnonzero(may)
        if 4 * sizes[others].sum() < len(ids):
            shared = np.array([flag[ids[bounds[j] : bounds[j + 1]]].sum() for j in others])
        else:
            shared = np.add.reduceat(flag[ids], bounds[:-1])[others]
        flag[mine] = 0
        for j in others[shared >= least[others]].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


ROW = "u long, x long, y long, part long, side int, label long, node long"
UNIT = ["u", "x", "y"]


def _compared(wanted: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int, id_bytes: int) -> DataFrame:
    """The links (a, b) of each unit (u, x, y) of wanted, a table of ROW; parts are compared each by itself."""

    @hashing.trimmed
    def compare(group: pa.Table) -> pa.Table:
        shingler = hashing.held(("sets", shingle), lambda: Shingler(shingle))
        order = group.select(["part", "node"]).append_column("at", pa.array(range(group.num_rows))).sort_by([("part", "ascending"), ("node", "ascending"), ("at", "ascending")])["at"].to_numpy()
        part, node, side, label = (group[c].to_numpy()[order] for c in ("part", "node", "side", "label"))
        # A class whose text occurs in repeated rows comes once for each.
        new = np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1]))
        order, part, node, side, label = order[new], part[new], node[new], side[new], label[new]
        texts = group["text"].combine_chunks()
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1:
                sets = list(shingler.sets(texts.take(pa.array(order[lo:hi]))))
                sides = side[lo:hi].tolist() if side[lo:hi].any() else None
                for i, j in forest(sets, label[lo:hi].tolist(), sides, jaccard_need(percent)):
                    a.append(node[lo + i])
                    b.append(node[lo + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    wanted = wanted.join(classes.select("node", F.col("rep").alias("doc_id"), "text_hash"), "node")
    few = 96 * wanted.count() <= id_bytes
    rows = texts(docs).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select(*UNIT, "part", "side", "label", "node", "text")
    return once(rows, [*UNIT, "part", "node"]).groupBy(*UNIT).applyInArrow(compare, "a long, b long")


def sized_blocks(block_rows: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("long").alias("blocks")


def units(sized: DataFrame, spread: int, giant_blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ROW for the clusters (node, cluster, blocks) of at most giant_blocks, and the nodes of the others."""
    none, zero = F.lit(-1).cast("long"), F.lit(0)
    small = sized.filter("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(spread)).cast("long").alias("u"), none.alias("x"), none.alias("y"), F.col("cluster").alias("part"), zero.alias("side"), F.col("node").alias("label"), "node")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("long")
    dealt = sized.filter(F.col("blocks").between(2, giant_blocks)).withColumn("own", own)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    large = dealt.select(F.col("cluster").alias("u"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.lit(0).cast("long").alias("part"), side.alias("side"), F.col("node").alias("label"), "node")
    # Two blocks compare across; one block with itself has one side.
    return small.unionByName(large), sized.filter(F.col("blocks") > giant_blocks).select("node")


def _bucket_units(members: DataFrame, labels: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """The rows of ROW for members (node, n, key), bucket by bucket; labels (node, root): what is connected already.

    A label of more than a block has blocks of its own in a bucket, which meet all blocks there but those.
    """
    labelled = members.join(labels, "node", "left").select("node", "n", "key", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    labelled = labelled.join(mixed, "key", "left_semi")
    per = labelled.groupBy("key", "label").agg(sized_blocks(block_rows, block_shingles), F.sum("n").alias("n"), F.count("*").alias("m"))
    rest = per.filter("blocks = 1").groupBy("key").agg(F.greatest(F.ceil(F.sum("m") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("long").alias("shared"))
    rows = labelled.join(per.select("key", "label", "blocks"), ["key", "label"]).join(rest, "key", "left")
    pure = F.col("blocks") > 1
    rows = rows.select("node", "key", "label", F.when(pure, F.col("label")).otherwise(-1).alias("pure"), F.pmod(F.xxhash64("node"), F.when(pure, F.col("blocks")).otherwise(F.col("shared"))).cast("long").alias("block"))
    listed = rows.select("key", "pure", "block").distinct()
    first, second = (listed.select("key", F.col("pure").alias(f"{s}pure"), F.col("block").alias(f"{s}block")) for s in "ab")
    order = (F.col("apure") < F.col("bpure")) | (F.col("apure") == F.col("bpure")) & (F.col("apure") == -1) & (F.col("ablock") <= F.col("bblock"))
    pairs = first.join(second, "key").filter(order)
    name = [F.col("key").alias("u"), F.xxhash64("apure", "ablock").alias("x"), F.xxhash64("bpure", "bblock").alias("y")]
    out = []
    for mine, side in (("a", 0), ("b", 1)):
        met = pairs if side == 0 else pairs.filter("apure <> bpure or ablock <> bblock")
        met = met.select("key", F.col(f"{mine}pure").alias("pure"), F.col(f"{mine}block").alias("block"), *name)
        out.append(rows.join(met, ["key", "pure", "block"]).select(*UNIT, F.lit(0).cast("long").alias("part"), F.lit(side).alias("side"), "label", "node"))
    return out[0].unionByName(out[1])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of edges (a, b): node, root, for every node that has an edge; root is the smallest.

    At most FEW_EDGES are solved at once: a round would shuffle them six times, and the driver would hold its plans, tasks
    and threads. Else a round of stars follows. They end, too, as soon as the edges are stars: no node has two edges
    downwards, and none that has one is below another.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges, step = scratch.keep(edges.distinct(), f"{name}_0"), 0
    while True:
        if edges.count() <= FEW_EDGES:
            few = edges.toArrow()
            ends = least_ends(zip(few["a"].to_pylist(), few["b"].to_pylist(), strict=True))
            found = pa.table({"node": pa.array([x for x, _ in ends], pa.int64()), "root": pa.array([x for _, x in ends], pa.int64())})
            return scratch.keep(scratch.spark.createDataFrame(found), f"{name}_roots")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        small = scratch.keep(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{name}_{step + 1}")
        scratch.drop(f"{name}_{step}")
        ends = small.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        per = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
        if not per.agg(F.sum(((F.col("up") > 1) | (F.col("up") == 1) & (F.col("low") == 0)).cast("int"))).first()[0]:
            roots = small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        edges, step = small, step + 1


def named_classes(signed: DataFrame, *carry: str) -> DataFrame:
    """A row for each different set of signed rows: node, n_shingles, low, high, rep (the smallest doc_id), its text_hash."""
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    classes = signed.filter("n_shingles > 0").groupBy(*_SET).agg(F.min(named).alias("rep"), *[F.first(c).alias(c) for c in carry]).filter("rep is not null")
    return classes.select(F.monotonically_increasing_id().alias("node"), *_SET, F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("text_hash"), *carry)


def joined(docs: DataFrame, signed: DataFrame, classes: DataFrame, ties: DataFrame, members_of: Callable[[DataFrame], DataFrame], scratch: Scratch, shingle: int, percent: int, id_bytes: int, block_rows: int, block_shingles: int, giant_blocks: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for every row of signed, which names the sets of docs.

    ties (a, b) connect all classes that share a bucket; members_of gives node, n, key and head of some nodes' buckets.
    """
    clusters = components(ties, scratch, "clusters")
    inside = clusters.select("node", F.col("root").alias("cluster")).join(classes.select("node", F.col("n_shingles").alias("n")), "node")
    inside = scratch.keep(inside, "inside")
    sizes = inside.groupBy("cluster").agg(sized_blocks(block_rows, block_shingles), F.count("*").alias("m"), F.sum("n").alias("s"))
    most, n, shingles = sizes.agg(*[F.coalesce(f, F.lit(0)) for f in (F.max("blocks"), F.sum("m"), F.sum("s"))]).first()
    spread = max(1, math.ceil(4 * n / block_rows), math.ceil(4 * shingles / block_shingles))
    wanted, giant = units(inside.join(sizes, "cluster"), spread, giant_blocks)
    links = scratch.keep(_compared(scratch.keep(wanted, "wanted"), docs, classes, shingle, percent, id_bytes), "links")
    if most > giant_blocks:
        crowd = scratch.keep(members_of(giant), "crowd")
        # Each tie is a unit of two classes.
        pairs = crowd.filter("node <> head").select("head", "node").distinct().withColumn("part", F.xxhash64("head", "node"))
        none = F.lit(-1).cast("long")
        ends = [pairs.select(F.pmod("part", F.lit(max(1, n // 64))).cast("long").alias("u"), none.alias("x"), none.alias("y"), "part", F.lit(0).alias("side"), F.col(c).alias("label"), F.col(c).alias("node")) for c in ("head", "node")]
        tied = scratch.keep(_compared(scratch.keep(ends[0].unionByName(ends[1]), "ties"), docs, classes, shingle, percent, id_bytes), "tied")
        labels = components(tied, scratch, "labels")
        wanted = scratch.keep(_bucket_units(crowd.select("node", "n", "key"), labels, block_rows, block_shingles), "crowds")
        links = links.union(tied).union(scratch.keep(_compared(wanted, docs, classes, shingle, percent, id_bytes), "crowded"))
    roots = components(links, scratch, "edges").join(classes.select("node", "rep"), "node")
    found = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    classes = classes.join(found, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in _SET], F.coalesce("component_id", "rep").alias("component_id"))
    matches = F.col("doc_id").isNotNull() & F.expr(" and ".join(f"{c} = _{c}" for c in _SET))
    out = signed.select("doc_id", "text_hash", *_SET).join(classes, matches, "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _judged(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, id_bytes: int, block_rows: int, block_shingles: int, giant_blocks: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(signatures(docs, shingle, bands, rows), "signed")
    classes = scratch.keep(named_classes(signed, "keys"), "classes")
    cells = classes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    heads = scratch.keep(cells.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("m")).filter("m > 1").select("key", "head"), "heads")
    few = 16 * heads.count() <= id_bytes
    members = scratch.keep(cells.join(F.broadcast(heads) if few else heads, "key"), "members")
    ties = members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    return joined(docs, signed, classes, ties, lambda giant: members.join(giant, "node", "left_semi"), scratch, shingle, percent, id_bytes, block_rows, block_shingles, giant_blocks)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, id_bytes: int = 8 << 20, block_rows: int = 1024, block_shingles: int = 1 << 19, giant_blocks: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest document reachable by links) and kept for every row.

    id_bytes: ids of candidates are broadcast to pick their texts while they need no more bytes than this; beyond it, the
    same join is a shuffle. block_rows, block_shingles: the classes, and shingles in all, of a block.
    """
    return _judged(docs, shingle, percent, bands, rows, id_bytes, block_rows, block_shingles, giant_blocks).drop("text_hash")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows whose near-duplicate component has a smaller doc_id. All columns stay.

    Rows that repeat both doc_id and text are kept, or go, together. id_bytes: what goes is broadcast while it needs no
    more bytes than this, so that no text moves; beyond it, the same join is a shuffle.
    """
    judged = _judged(docs, shingle, percent, 64, 8, id_bytes, 1024, 1 << 19, 16)
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    gone = Scratch(docs.sparkSession, "gone").keep(gone, "ids")
    few = 24 * gone.count() <= id_bytes
    same = (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_hash"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
