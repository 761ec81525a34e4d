"""N-gram Jaccard join by PartEnum signatures: every pair of documents that is similar enough, exactly.

A document's set is its distinct ``shingle``-word shingles after lower-casing A-Z; with fewer words, the whole sequence as
one shingle; without words, the empty set, linked with nothing. Two documents link if 100 * |A & B| is at least ``percent``
* |A | B|.

Method. Linked sets of sizes a and b differ in at most k = (100 - percent) * (a + b) / (100 + percent) shingles. Sizes are
cut into bands, each ``RATIO`` times as wide as the one before, so linked sets lie in one band or in neighbouring ones; each
band, and each border between two bands for the sets that can reach over it, has a scheme of its own for its largest k.
A scheme partitions the domain of shingles, in two levels: n1 parts of n2 parts each. Of n1 parts one has k // n1
differences at most, so there all but so many of the n2 parts agree, and the signatures, which are the contents of subsets
of the n2 parts, have one in common. Small sets have n1 = 1 and all pairs of k + 3 parts; others have n2 = 2 and all single
ones. A set with more than k parts that aren't empty shares one of those, so it needs no signature of empty parts; sets with
fewer give these as well. Of single parts there are about 1.5 k, and any k + 1 of a set's signatures have one that a linked
set has as well: it is enough for both to keep the k + 1 rarest, in one order for all. A set with more than k signatures
that no other set has is linked with nothing.

Scale. Sets that are equal become one class first, and only classes have signatures, about three for four shingles. These
go, packed by ranges of their hash, to the task of their bucket, once, and those that several classes have come back with
their frequency; from ``COMMON`` on all are alike, and a task that has so many classes of one signature sends it once and
knows their answer. Documents that share a passage have rarer signatures, and keep these. Pairs aren't made: a tie leads
from each class to the smallest of a signature that both kept, and the components of ties are clusters that hold every pair.
What still chains up to large clusters is thinned by signatures alone: of two linked
sets with x and y signatures in a scheme of single parts, min(x, y) - k agree at least, and the components of such pairs are
the clusters that count. For that, a cluster's classes are dealt into slabs of sizes as wide as linked sets can differ, and
a slab meets itself and the next one alone. The thin clusters are compared as in ``minhash``: on the full sets, in blocks,
without pairs that are connected already. Two slabs beyond ``giant_blocks`` blocks aren't thinned, and go bucket by bucket.

Defined cases. As ``minhash``: null text: empty set. Null doc_id: linked with nothing, component_id null. Rows that share a
doc_id are each judged by their own text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm import hashing
from tracewright.llm.minhash import UNIT, Shingler, components, forest, joined, named_classes, once, sized_blocks, texts, units
from tracewright.llm.storage import Scratch

#: Largest size of a band to its smallest.
RATIO = 2.25
#: Largest k with subsets of two parts.
_PAIRS = 6
_ROWS = 1024
#: Signatures that a task holds before it sends them.
_HELD = 1 << 21
#: Classes of a signature from which on its frequency counts no further.
COMMON = 64


@dataclass(frozen=True)
class Scheme:
    """Signatures of the sets of one band or border."""

    tag: int
    parts: int
    subset: int  # parts in a signature

    def signatures(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Signatures of a set of hashes that differs from what it may link with in at most k."""
        return self.signed(hashes, k)[0]

    def signed(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
        """The signatures, and whether any k + 1 of them have one in common with a linked set."""
        part = (hashing.mix(hashes ^ np.uint64(self.tag + 1)) % np.uint64(self.parts)).astype(np.int64)
        content = np.zeros(self.parts, dtype=np.uint64)
        np.add.at(content, part, hashing.mix(hashes))
        full = np.bincount(part, minlength=self.parts) > 0
        enough = self.subset == 1 and bool(full.sum() > k)
        if full.sum() <= k:
            full[:] = True  # empty parts may be all that agrees
        named = hashing.mix(content + hashing.mix(np.arange(self.parts, dtype=np.uint64) + np.uint64(self.tag << 32)))
        if self.subset == 1:
            return named[full], enough
        some = [(i, j) for i, j in combinations(range(self.parts), 2) if full[i] or full[j]]
        i, j = np.array(some, dtype=np.int64).T
        return hashing.mix(named[i] + hashing.mix(named[j])), enough


def scheme(tag: int, k: int) -> Scheme:
    """More than k parts: a set keeps k + 1 of its signatures, so with more parts it keeps rarer ones."""
    return Scheme(tag, k + 3, 2) if k <= _PAIRS else Scheme(tag, 2 * -(-(k + 3 + k // 2) // 2), 1)


class PartEnum:
    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = max(RATIO, 101 / percent)
        self.slab = np.log(100 / percent * (1 + 1e-6))  # a trifle wider than linked sets differ, for rounding

    @lru_cache(maxsize=256)
    def band(self, number: int) -> tuple[int, int]:
        low = 1 if number == 0 else self.band(number - 1)[1] + 1
        return low, max(low, int(self.ratio * low))

    def number(self, size: int) -> int:
        n = 0
        while self.band(n)[1] < size:
            n += 1
        return n

    def most(self, total: int) -> int:
        """Differences of linked sets whose sizes sum to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def schemes(self, size: int) -> list[tuple[Scheme, int]]:
        """Schemes of a set of this size, each with the differences that it can have from what it may link with there."""
        number, reach = self.number(size), 100 * size // self.percent
        low, high = self.band(number)
        out = []
        if mine := self.most(size + min(high, reach)):
            out.append((scheme(2 * number, self.most(2 * high)), mine))
        across = lambda last: self.most(last + 100 * last // self.percent)
        if reach > high and (mine := self.most(size + reach)):
            out.append((scheme(2 * number + 1, across(high)), mine))
        if number and (before := self.band(number - 1)[1]) * 100 >= self.percent * size and (mine := self.most(before + size)):
            out.append((scheme(2 * number - 1, across(before)), mine))
        return out

    def need(self, sizes: np.ndarray, bands: np.ndarray, own: np.ndarray, across: np.ndarray, i: int) -> np.ndarray:
        """How many signatures sets must share with set i to be linked with it perhaps.

        own: how many signatures each has in its band's scheme; across: in those of the border below and the border above;
        0 where the scheme has pairs of parts.
        """
        most = (100 - self.percent) * (sizes + sizes[i]) // (100 + self.percent)
        step = bands - bands[i]
        mine = np.where(step == 0, np.minimum(own, own[i]), np.where(step == 1, np.minimum(across[0], across[1, i]), np.minimum(across[1], across[0, i])))
        far = (abs(step) > 1) | (100 * np.minimum(sizes, sizes[i]) < self.percent * np.maximum(sizes, sizes[i]))
        return np.where(far, 1 << 40, np.maximum(1, mine - most))

    def counted(self, hashes: np.ndarray) -> tuple[np.ndarray, int, list[int]]:
        """The signatures as 32 bits, the band, and the numbers of signatures in its scheme and in those of its borders."""
        band, found, counts = self.number(len(hashes)), [np.empty(0, dtype=np.uint64)], {}
        for s, k in self._schemes(len(hashes)):
            found.append(s.signatures(hashes, k))
            counts[s.tag] = len(found[-1]) if s.subset == 1 else 0
        return np.unique(np.concatenate(found) >> np.uint64(32)).astype(np.uint32), band, [counts.get(2 * band + d, 0) for d in (0, -1, 1)]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set; sets that are linked and not equal have one in common."""
        found = [s.signatures(hashes, k) for s, k in self._schemes(len(hashes))]
        return np.concatenate(found).view(np.int64) if found else np.empty(0, dtype=np.int64)

    def kept(self, hashes: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """For each scheme of a set its different signatures, whose last two bits name the scheme, that name, and how many
        of the rarest must be kept."""
        out = []
        for s, k in self._schemes(len(hashes)):
            name = s.tag % 4  # a set has schemes of three consecutive tags at most
            found, enough = s.signed(hashes, k)
            mine = np.unique(found & ~np.uint64(3) | np.uint64(name)).view(np.int64)
            out.append((mine, name, k + 1 if enough else len(mine)))
        return out

    @lru_cache(maxsize=4096)
    def _schemes(self, size: int) -> list[tuple[Scheme, int]]:
        return self.schemes(size)


def digests(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and two 64-bit digests of the set of every row."""

    @hashing.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = hashing.held(("sets", shingle), lambda: Shingler(shingle))
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            sizes, low, high = [], [], []
            for s in shingler.sets(batch.column(2)):
                sizes.append(len(s))
                low.append(np.bitwise_xor.reduce(hashing.mix(s)) if len(s) else np.uint64(0))
                high.append(np.add.reduce(hashing.mix(s ^ np.uint64(0x9E3779B97F4A7C15))) if len(s) else np.uint64(0))
            both = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *both], names=["doc_id", "text_hash", "n_shingles", "low", "high"])

    return texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, low long, high long")


def _rows_of(classes: DataFrame, docs: DataFrame, id_bytes: int) -> DataFrame:
    """node, n and text of the classes, once a task."""
    few = 32 * classes.count() <= id_bytes
    wanted = classes.select("node", F.col("n_shingles").alias("n"), F.col("rep").alias("doc_id"), "text_hash")
    return once(texts(docs).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("node", "n", "text"), ["node"])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys start, and their lengths."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return starts, np.diff(np.append(starts, len(keys)))


def common(rows: DataFrame, buckets: int, shingle: int, percent: int) -> DataFrame:
    """node, key and level (classes, COMMON at most) of each signature that several nodes have; and, with level 0, for each
    scheme of a node its name as key, its number of signatures x and how many of them to keep. rows: node, n, text."""
    kinds, names = "bucket long, kind int, a binary, b binary", ["bucket", "kind", "a", "b"]
    number = lambda *x: np.array(x, dtype=np.int64)

    @hashing.trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, enum = hashing.held(("partenum", shingle, percent), lambda: (Shingler(shingle), PartEnum(percent)))
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        facts: list[tuple[int, int, int, int]] = []

        def send() -> Iterator[pa.RecordBatch]:
            key, node = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (keys, nodes))
            order = np.argsort(key.view(np.uint64), kind="stable")
            key, node = key[order], node[order]
            starts, lengths = _runs(key)
            hot = np.repeat(lengths > COMMON, lengths)
            rows = []
            if hot.any():  # these nodes know the level; the bucket has to know that there are so many
                h, m = key[hot], node[hot]
                rows += [(int(m[k]) % buckets, 1, h[k : k + 4096].tobytes(), m[k : k + 4096].tobytes()) for k in range(0, len(h), 4096)]
            cold = np.concatenate([key[~hot], key[starts[lengths > COMMON]]]), np.concatenate([node[~hot], np.full((lengths > COMMON).sum(), -1)])
            to = ((cold[0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, key, node = to[order], cold[0][order], cold[1][order]
            starts, lengths = _runs(to)
            rows += [(int(to[i]), 0, key[i : i + n].tobytes(), node[i : i + n].tobytes()) for i, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            rows += [(f[0] % buckets, 2, number(f[0], f[1]).tobytes(), number(f[2], f[3]).tobytes()) for f in facts]
            for x in (keys, nodes, facts):
                x.clear()
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 64]], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=names)

        n = 0
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            for node, found in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(2)), strict=True):
                for mine, name, most in enum.kept(found):
                    keys.append(mine)
                    nodes.append(np.full(len(mine), node, dtype=np.int64))
                    facts.append((node, name, len(mine), most))
                    n += len(mine)
            if n >= _HELD:
                yield from send()
                n = 0
        yield from send()

    @hashing.trimmed
    def meet(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        packed = {c: [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in group[c]] for c in "ab"}
        of = lambda c, k: np.concatenate([np.empty(0, dtype=np.int64), *(x for x, w in zip(packed[c], kind, strict=True) if w == k)])
        key, node = of("a", 0), of("b", 0)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)] | (node < 0)  # a class may come twice
        key, node = key[new], node[new]
        _, lengths = _runs(key)
        level = np.repeat(lengths, lengths)
        if (node < 0).any():
            level[np.isin(key, key[node < 0])] = COMMON
        some = (node >= 0) & (level > 1)
        key, node, level = key[some], node[some], np.minimum(level[some], COMMON)
        hot, facts = (of("a", 1), of("b", 1)), (of("a", 2).reshape(-1, 2), of("b", 2).reshape(-1, 2))
        join = lambda *x: pa.array(np.concatenate([np.empty(0, dtype=np.int64), *x]).astype(np.int64))
        blank = np.zeros(len(key) + len(hot[0]), dtype=np.int64)
        return pa.table({"node": join(node, hot[1], facts[0][:, 0]), "key": join(key, hot[0], facts[0][:, 1]), "level": join(level, np.full(len(hot[0]), COMMON), np.zeros(len(facts[0]))), "x": join(blank, facts[1][:, 0]), "most": join(blank, facts[1][:, 1])})

    return rows.mapInArrow(sign, kinds).groupBy("bucket").applyInArrow(meet, "node long, key long, level long, x long, most long")


def bucket_ties(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """Ties (a, b) that connect all nodes which keep a signature; shared: as ``common`` gives it."""
    name = F.when(F.col("level") == 0, F.col("key")).otherwise(F.col("key").bitwiseAND(3))
    rows = shared.withColumn("name", name).repartition("node", "name").dropDuplicates(["node", "name", "level", "key"])
    whole = W.partitionBy("node", "name")
    # The row of the scheme itself comes first. Signatures that no other node has are kept before these.
    room = F.max("most").over(whole) - F.max("x").over(whole) + F.count("*").over(whole)
    rows = rows.withColumns({"_place": F.row_number().over(whole.orderBy("level", "key")), "_room": room})
    kept = scratch.keep(rows.filter("level > 0 and _place <= _room").select("node", "key"), "kept")
    heads = kept.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last")).filter("head < _last").drop("_last")
    return kept.join(heads, "key").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()


def _sketches(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, size, slab, band, own, low, high (as ``PartEnum.counted``) and keys of each row of node, n, text."""

    @hashing.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, enum = hashing.held(("partenum", shingle, percent), lambda: (Shingler(shingle), PartEnum(percent)))
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            got = [enum.counted(s) for s in shingler.sets(batch.column(2))]
            numbers = [pa.array([g[1] for g in got], pa.int64()), *(pa.array([g[2][d] for g in got], pa.int64()) for d in range(3))]
            slab = pa.array((np.log(batch.column(1).to_numpy()) / enum.slab).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), slab, *numbers, pa.array([g[0].tobytes() for g in got], pa.binary())], names=["node", "size", "slab", "band", "own", "low", "high", "keys"])

    return rows.mapInArrow(run, "node long, size long, slab long, band long, own long, low long, high long, keys binary")


def thinned(ties: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int, percent: int, id_bytes: int, block_rows: int, block_keys: int, giant_blocks: int) -> DataFrame:
    """Ties (a, b) that connect all classes that may be linked, by the numbers of signatures that they share."""
    clusters = scratch.keep(components(ties, scratch, "tied").withColumnRenamed("root", "cluster"), "tied")
    sketches = scratch.keep(_sketches(_rows_of(classes.join(clusters, "node", "left_semi"), docs, id_bytes), shingle, percent), "sketches")
    one = sketches.groupBy("node").agg(F.max(F.length("keys") / 4).cast("long").alias("n"), F.max("slab").alias("slab"))
    # A class is of its slab's group, and of the one below, where it meets the classes of that slab alone.
    inside = clusters.join(one, "node").select("node", "n", F.col("cluster").alias("_c"), "slab", F.explode(F.array("slab", F.col("slab") - 1)).alias("_s"))
    inside = inside.select("node", "n", F.xxhash64("_c", "_s").alias("cluster"), (F.col("slab") == F.col("_s")).cast("int").alias("lower"))
    sizes = inside.groupBy("cluster").agg(sized_blocks(block_rows, block_keys), F.count("*").alias("m"), F.sum("n").alias("s"), F.max("lower").alias("lower"))
    sizes = scratch.keep(sizes.filter("lower = 1 and m > 1").drop("lower"), "tied_sizes")
    m, keys = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    wanted, giant = units(inside.join(sizes.select("cluster", "blocks"), "cluster"), max(1, -(-4 * m // block_rows), -(-4 * keys // block_keys)), giant_blocks)

    @hashing.trimmed
    def compare(group: pa.Table) -> pa.Table:
        enum = hashing.held(("thin", percent), lambda: PartEnum(percent))
        order = group.select(["part", "node"]).append_column("at", pa.array(range(group.num_rows))).sort_by([("part", "ascending"), ("node", "ascending"), ("at", "ascending")])["at"].to_numpy()
        part, node, side, label, size, slab, band, own, low, high = (group[c].to_numpy()[order] for c in ("part", "node", "side", "label", "size", "slab", "band", "own", "low", "high"))
        new = np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1]))  # a class may have come from several tasks
        order, part, node, side, label, size, slab, band, own, low, high = (x[new] for x in (order, part, node, side, label, size, slab, band, own, low, high))
        packed = group["keys"].combine_chunks()
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1:
                sets = [np.frombuffer(packed[k].as_buffer(), dtype=np.uint32) for k in order[lo:hi].tolist()]
                here = size[lo:hi], band[lo:hi], own[lo:hi], np.array([low[lo:hi], high[lo:hi]])
                sides = side[lo:hi].tolist() if side[lo:hi].any() else None
                upper = slab[lo:hi] > slab[lo:hi].min()
                need = lambda _, i, here=here, upper=upper: np.where(upper & upper[i], 1 << 40, enum.need(*here, i))
                for i, j in forest(sets, label[lo:hi].tolist(), sides, need):
                    a.append(node[lo + i])
                    b.append(node[lo + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = wanted.join(sketches, "node").select(*UNIT, "part", "side", "label", "node", "size", "slab", "band", "own", "low", "high", "keys")
    kept = rows.groupBy(*UNIT).applyInArrow(compare, "a long, b long")
    loose = [ties.join(giant.select(F.col("node").alias(end)), end, "left_semi").select("a", "b") for end in "ab"]
    return scratch.keep(kept.union(loose[0]).union(loose[1]), "thinned")


def _members(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, n, key and head (the smallest node of the key) of each signature that several of the nodes have."""

    @hashing.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, enum = hashing.held(("partenum", shingle, percent), lambda: (Shingler(shingle), PartEnum(percent)))
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            keys = [enum.signatures(s) for s in shingler.sets(batch.column(2))]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys))], names=["node", "n", "key"])

    cells = rows.mapInArrow(run, "node long, n long, key long").distinct()
    heads = cells.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last")).filter("head < _last").drop("_last")
    return cells.join(heads, "key")


def similar(docs: DataFrame, shingle: int = 5, percent: int = 80, id_bytes: int = 8 << 20, block_rows: int = 1024, block_shingles: int = 1 << 19, giant_blocks: int = 16, bucket_rows: int = 1 << 18) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest document reachable by links) of every row.

    bucket_rows: signatures of a bucket, about. The other parameters are those of ``minhash.near_duplicates``.
    """
    scratch = Scratch(docs.sparkSession, "partenum")
    signed = scratch.keep(digests(docs, shingle), "signed")
    classes = scratch.keep(named_classes(signed), "classes")
    buckets = max(1, 3 * (classes.agg(F.sum("n_shingles")).first()[0] or 0) // (4 * bucket_rows))
    shared = scratch.keep(common(_rows_of(classes, docs, id_bytes), buckets, shingle, percent), "shared")
    ties = scratch.keep(bucket_ties(shared, scratch), "bucket_ties")
    ties = thinned(ties, docs, classes, scratch, shingle, percent, id_bytes, 4 * block_rows, block_shingles, 4 * giant_blocks)
    members = lambda giant: _members(_rows_of(classes.join(giant, "node", "left_semi"), docs, id_bytes), shingle, percent)
    return joined(docs, signed, classes, ties, members, scratch, shingle, percent, id_bytes, block_rows, block_shingles, giant_blocks).drop("text_hash", "kept")
