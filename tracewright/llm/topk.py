"""Exact top-k by integer inner product: dual-tree search over cover trees.

Vectors become floor(scale * x) per component. Every row is assigned to the nearest of at most 256 pivots, the top level
of the cover tree; a cell is cut into blocks of about ``block_rows``, and each block, of data or of queries, is indexed by
a cover tree of its own. Two nodes with centres p and q and covering radii r and s can score at most
<p, q> + |p| s + |q| r + r s, so a pair of nodes is skipped when this is below the worst kth score of its queries.

1. Each query block meets the data blocks of its own cell, which gives every query a kth score to beat.
2. Pairs of cells whose bound reaches the least kth score of the query cell remain. Their blocks meet, and the two trees
   are descended together, best bound first; leaves are compared by one matrix product.
3. The best k of a query's candidates are the result, ties to the smaller vec_id.

All rows are indexed and the bounds are exact, so the result is that of brute force. In data without clusters the bounds
prune little and the work is that of a blocked brute force.

Scale. The driver sees counts, radii and kth scores of at most 256 cells, and a sample of 4096 vectors to choose pivots
from; pivots affect speed only. A cell that holds a third of all rows, equal vectors included, has many blocks, and
blocks meet by (cell, block), so it is searched by many tasks.

Defined cases. A row whose vec_id or vector is null, or with a null or non-finite component, takes no part. Vectors of
different lengths: the shorter one is padded with zeros. Empty vector: all its scores are 0. Rows that share a vec_id are
one candidate for each distinct vector, and none of them is a candidate of that id. Extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.storage import Scratch

MAX_CELLS, SAMPLE, LEAF = 256, 4096, 128
_BLOCK = "cell int, part long, block binary"
_FOUND = "query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, padded with zeros to one length."""
    lists = column.to_pylist() if column.null_count else None
    if lists is None:
        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) and (sizes == sizes[0]).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sizes), -1)
        lists = column.to_pylist()
    width = max((len(x) for x in lists), default=0)
    return np.array([x + [0] * (width - len(x)) for x in lists], dtype=np.int64).reshape(len(lists), width)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class CoverTree:
    """Points in tree order; node i has points lo[i] to hi[i], a centre, a covering radius and children.

    A node's children have half its covering radius and centres further apart than that; the node's own centre is the
    first child's. Neighbouring small children share a leaf of at most LEAF points around their mean.
    """

    def __init__(self, points: np.ndarray):
        self.x = points.astype(np.float64)
        self.order: list[np.ndarray] = []
        self.size = 0
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[list[int]] = []
        self.root = self._build(np.arange(len(points)), 0)
        self.permutation = np.concatenate(self.order) if self.order else np.empty(0, dtype=np.int64)
        self.x = self.x[self.permutation]
        self.centre = np.array([self.x[a:b].mean(axis=0) for a, b in zip(self.lo, self.hi, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.radius = np.array([math.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.lo, self.hi, self.centre, strict=True)])

    def _add(self, lo: int) -> int:
        self.lo.append(lo)
        self.hi.append(lo)
        self.children.append([])
        return len(self.lo) - 1

    def _leaf(self, parts: list[np.ndarray]) -> int:
        node = self._add(self.size)
        for p in parts:
            self.order.append(p)
            self.size += len(p)
        self.hi[node] = self.size
        return node

    def _build(self, at: np.ndarray, depth: int) -> int:
        if len(at) <= LEAF:
            return self._leaf([at])
        distance = ((self.x[at] - self.x[at[0]]) ** 2).sum(axis=1)
        cover = distance.max() / 4  # squared half of the covering radius
        if not cover or depth > 60:
            return self._leaf([at])
        node = self._add(self.size)
        waiting: list[np.ndarray] = []
        rest = at
        while len(rest):
            near = (distance if rest is at else ((self.x[rest] - self.x[rest[0]]) ** 2).sum(axis=1)) <= cover
            child, rest = rest[near], rest[~near]
            if len(child) > LEAF // 2:
                self.children[node].append(self._build(child, depth + 1))
                continue
            if sum(map(len, waiting)) + len(child) > LEAF:
                self.children[node].append(self._leaf(waiting))
                waiting = []
            waiting.append(child)
        if waiting:
            self.children[node].append(self._leaf(waiting))
        self.hi[node] = self.size
        return node


class Search:
    """The k best data points of each query, as sortable keys score * n + (n - 1 - rank of the id)."""

    def __init__(self, queries: CoverTree, query_ids: np.ndarray, floor: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int):
        self.q, self.d, self.k = queries, data, k
        self.query_ids, self.data_ids = query_ids[queries.permutation], data_ids[data.permutation]
        self.n = len(data_ids)
        self.by_rank, rank = np.sort(self.data_ids, kind="stable"), np.empty(self.n, dtype=np.int64)
        rank[np.argsort(self.data_ids, kind="stable")] = np.arange(self.n)
        self.low = self.n - 1 - rank
        self.best = np.full((len(query_ids), k), _NONE, dtype=np.int64)
        self.worst = floor[queries.permutation].copy()

    def bounds(self, a: int, nodes: list[int]) -> np.ndarray:
        q, d = self.q, self.d
        r, s = q.radius[a], d.radius[nodes]
        top = d.centre[nodes] @ q.centre[a] + q.norm[a] * s + d.norm[nodes] * r + r * s
        return top + 1e-6 + 1e-9 * np.abs(top)

    def run(self) -> None:
        self._visit(self.q.root, self.d.root, float(self.bounds(self.q.root, [self.d.root])[0]))

    def _visit(self, a: int, b: int, bound: float) -> None:
        if bound < self.worst[self.q.lo[a] : self.q.hi[a]].min():
            return
        mine, theirs = self.q.children[a], self.d.children[b]
        if not mine and not theirs:
            self._compare(a, b)
        elif mine and (not theirs or self.q.radius[a] > self.d.radius[b]):
            for c in mine:
                self._visit(c, b, float(self.bounds(c, [b])[0]))
        else:
            tops = self.bounds(a, theirs)
            for i in np.argsort(-tops, kind="stable"):
                self._visit(a, theirs[i], float(tops[i]))

    def _compare(self, a: int, b: int) -> None:
        qs, ds = slice(self.q.lo[a], self.q.hi[a]), slice(self.d.lo[b], self.d.hi[b])
        scores = self.q.x[qs] @ self.d.x[ds].T
        own = self.query_ids[qs, None] == self.data_ids[None, ds]
        good = (scores >= self.worst[qs, None]) & ~own
        rows = np.flatnonzero(good.any(axis=1))
        if not len(rows):
            return
        keys = np.where(good[rows], scores[rows].astype(np.int64) * self.n + self.low[None, ds], _NONE)
        merged = np.concatenate([self.best[qs][rows], keys], axis=1)
        best = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k :]
        at = np.arange(qs.start, qs.stop)[rows]
        self.best[at] = best
        least = best.min(axis=1)
        self.worst[at] = np.maximum(self.worst[at], np.where(least == _NONE, -np.inf, np.floor_divide(least, self.n)))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(self.best != _NONE)
        keys = self.best[row, column]
        return self.query_ids[row], self.by_rank[self.n - 1 - keys % self.n], keys // self.n


def _brute(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For components so large that double precision isn't exact."""
    out = []
    columns = data.astype(object)
    for q, i in zip(queries.astype(object), query_ids.tolist(), strict=True):
        scored = sorted((-int(s), v) for s, v in zip(columns @ q if len(q) else [0] * len(columns), data_ids.tolist(), strict=True) if v != i)
        out += [(i, v, -s) for s, v in scored[:k]]
    return out


def _search(q: bytes, d: bytes, k: int) -> list[tuple[int, int, int]] | tuple[np.ndarray, np.ndarray, np.ndarray]:
    (qx, query_ids, floor, query_tree), (dx, data_ids, _, data_tree) = pickle.loads(q), pickle.loads(d)
    width = max(qx.shape[1], dx.shape[1])
    largest = float(np.abs(qx).max(initial=0)) * float(np.abs(dx).max(initial=0)) * max(1, width)
    if largest * (len(dx) + 1) >= 2**62 or largest >= 2**53:
        return _brute(_padded(qx, width), query_ids, _padded(dx, width), data_ids, k)
    if not width or qx.shape[1] != dx.shape[1]:
        query_tree, data_tree = CoverTree(_padded(qx, max(1, width))), CoverTree(_padded(dx, max(1, width)))
    search = Search(query_tree, query_ids, floor, data_tree, data_ids, k)
    search.run()
    return search.found()


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """The candidates of pairs (queries, data) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column(0), batch.column(1), strict=True):
                got = _search(q.as_py(), d.as_py(), k)
                columns = [np.array(c, dtype=np.int64) for c in (zip(*got, strict=True) if isinstance(got, list) and got else got or ([], [], []))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return pairs.select("queries", "data").mapInArrow(run, _FOUND)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector furthest from those before it."""
    x = sample.astype(np.float64)
    chosen, distance = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell and the distance from its pivot. The pivots, 256 vectors at most, are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(np.float64)
            width = max(x.shape[1], shared.value.shape[1])
            x, p = _padded(x, width), _padded(shared.value, width)
            cell = np.concatenate([((p**2).sum(axis=1) - 2 * x[i : i + 4096] @ p.T).argmin(axis=1) for i in range(0, len(x), 4096)])
            distance = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cell", "distance"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, cell int, distance double")


def _blocks(rows: DataFrame, sizes: dict[int, int], block_rows: int) -> DataFrame:
    """One row for each block of about block_rows rows: its cell, and its vectors, ids, floors and tree."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending")])
        x = _matrix(group["v"].combine_chunks())
        small = np.int16 if len(x) and np.abs(x).max(initial=0) < 2**15 else np.int64
        floor = group["floor"].to_numpy().astype(np.float64)
        tree = CoverTree(x) if x.shape[1] else None
        block = pickle.dumps((x.astype(small), group["vec_id"].to_numpy(), floor, tree), protocol=5)
        return pa.table({"cell": group["cell"].slice(0, 1), "part": group["part"].slice(0, 1), "block": pa.array([block], pa.binary())})

    part = F.pmod(F.xxhash64("vec_id"), _parts(sizes, block_rows)).cast("long")
    return rows.withColumn("part", part).groupBy("cell", "part").applyInArrow(pack, _BLOCK)


def _parts(sizes: dict[int, int], block_rows: int) -> Column:
    """How many blocks the cell in column cell has."""
    if not sizes:
        return F.lit(1).cast("long")
    counts = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, max(1, math.ceil(n / block_rows)))])
    return F.coalesce(F.try_element_at(counts, F.col("cell")), F.lit(1)).cast("long")


def _dealt(queries: DataFrame, data: DataFrame, sizes: dict[int, int], block_rows: int) -> DataFrame:
    """Pairs (queries, data): each block of queries (cell, queries) with each data block of its cell.

    A query block goes to every data block by the latter's own number, so a cell of many blocks is spread over many tasks.
    """
    sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(sizes, block_rows) - 1)))
    return sent.join(data.withColumnRenamed("block", "data"), ["cell", "part"]).select("queries", "data")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that satisfies is_query (a Column on vec_id)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    valid = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")).distinct()
    rows = scratch.keep(rows, "rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select("v").toArrow()
    pivots = _pivots(_matrix(sample["v"].combine_chunks()), min(MAX_CELLS, math.ceil(n / block_rows)))
    placed = scratch.keep(_assigned(rows, pivots), "placed")
    asked = placed.filter(is_query)
    stats = lambda df: {r["cell"]: (r["n"], r["radius"]) for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    cells, query_cells = stats(placed), stats(asked)
    none = F.lit(float("-inf"))
    sizes, query_sizes = {c: s[0] for c, s in cells.items()}, {c: s[0] for c, s in query_cells.items()}
    data = scratch.keep(_blocks(placed.withColumn("floor", none), sizes, block_rows), "data")
    first = _blocks(asked.withColumn("floor", none), query_sizes, block_rows).select("cell", F.col("block").alias("queries"))
    near = scratch.keep(_meet(_dealt(first, data, sizes, block_rows), k), "near")
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    asked = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    asked = scratch.keep(asked, "asked")
    least = {r["cell"]: r["floor"] for r in asked.groupBy("cell").agg(F.min("floor").alias("floor")).collect()}
    norms = np.sqrt((pivots**2).sum(axis=1))
    pairs = []
    for a, (_, s) in query_cells.items():
        for b, (_, r) in cells.items():
            top = float(pivots[a] @ pivots[b] + norms[a] * r + norms[b] * s + r * s)
            if a != b and top + 1e-6 + 1e-9 * abs(top) >= least[a]:
                pairs.append((a, b))
    out = near
    if pairs:
        left = spark.createDataFrame(pairs, "cell int, other int")  # 65536 rows at most
        again = _blocks(asked, query_sizes, block_rows).select("cell", F.col("block").alias("queries"))
        again = again.join(F.broadcast(left), "cell").select(F.col("other").alias("cell"), "queries")
        out = near.union(_meet(_dealt(again, data, sizes, block_rows), k))
    ranked = out.distinct().withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
