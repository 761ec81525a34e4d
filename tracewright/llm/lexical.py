"""Ranked lexical search of a stated set of items against all documents, by a tiered index.

Terms are maximal runs of ASCII letters, digits and code points beyond ASCII, with A-Z lower-cased. N documents have a term,
L terms in all; a document of n terms has m = 100 - b + (b * n * N) div L, b = 50. A term of document frequency df has the
weight floor(1000 * ln((2N + 2) / (2df + 1))); where it occurs tf times in a document its impact there is
(10**9 * tf) div (1000 * tf + 20 * m). A document's score is the sum of weight * impact over the item's terms, once each.

Method. The index has a row for each document, whose postings (term, impact) lie in columns by tier: the first tier has, of
each term, the postings of highest impact, ``first`` at most, the next ``growth`` times as many, the last all others. Each
term has a residual bound for each tier: the highest impact that lies below it. Items are first scored on the first tier
alone. The k-th best partial score is a lower bound of the k-th best score, so an item is proven on a tier if a document
without any posting of its terms there, which scores the sum of weight * residual at most, stays below it. Its candidates
are then the documents whose partial score plus the residuals of the terms not seen there reaches that bound, and only these
are scored in full. Items without proof fall through to the next tier; on the last one scores are whole. So results are
exact, ties included, and tiers below an item's proof are read for its candidates alone.

Scale. Tiers are columns, so a scan reads those that it needs, and nothing is shuffled but histograms of impacts, each task's
best k of an item, and candidates. Cutoffs come from these histograms, without sorting postings. Documents are read once for
each block of items; a block's different terms have some ``block_bytes``, so what is broadcast and held by the driver is
bounded however many items there are. Where one impact is shared by more postings of a term than a tier takes (copies of
one document), all of them go below it. Best k are merged in two rounds, so no task gets a row for each task.

Defined cases. Null text: no term. Items without a term that occurs: no rows. Rows that share an item_id are one item of all
their terms; a null item_id is an item like others. Documents that share a doc_id are rows like others; a null doc_id comes
last among equal scores. Equal scores: smaller doc_id first. Empty tables: no rows. Very long texts are read in slices.
Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.hashing import held, trimmed
from tracewright.llm.storage import Scratch
from tracewright.llm.terms import terms

_NULL_ID = np.iinfo(np.int64).max
_SCALE, _FLAT = 1_000_000_000, 20
#: Impacts of one level are not told apart by cutoffs.
_LEVEL = 8
#: Cells (documents times items) and products of a step within a task.
_CELLS, _PRODUCTS = 1 << 21, 1 << 21
_ROWS = 4096


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its different terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted({t for part in terms(text) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "item_id long, term binary").distinct()


def occurrences(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """row, doc_id, n (terms with repeats), and the numbers and frequencies of those in the vocabulary, for every document."""
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held(("terms", name), lambda: {t: k for k, t in enumerate(shared.value)})
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            sizes, ends, at, tf = [], [0], [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
            for text in batch.column(2):
                n, parts = 0, [np.empty(0, dtype=np.int32)]
                for words in terms(text):
                    n += len(words)
                    known = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    parts.append(known[known >= 0])
                found, times = np.unique(np.concatenate(parts), return_counts=True)
                sizes.append(n)
                ends.append(ends[-1] + len(found))
                at.append(found)
                tf.append(times)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], names=["row", "doc_id", "n", "at", "tf"])

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "row long, doc_id long, n long, at array<int>, tf array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of the lists of an array, nulls as empty lists."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def impacts(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, docs: int, words: int, b: int) -> np.ndarray:
    """Impact of each posting; n: terms of each document; sizes: its postings."""
    m = np.array([100 - b + b * int(x) * docs // words for x in n], dtype=np.int64)  # may pass 64 bits on the way
    return _SCALE * tf // (1000 * tf + _FLAT * np.repeat(m, sizes))


def term_statistics(found: DataFrame, docs: int, words: int, b: int, capacities: list[int]) -> DataFrame:
    """at, df, and for each tier but the last its least level and the highest impact below it."""

    @trimmed
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, _ROWS) for x in batches for k in range(0, x.num_rows, _ROWS)):
            sizes, at = _flat(batch.column("at"))
            impact = impacts(batch.column("n").to_numpy(), sizes, _flat(batch.column("tf"))[1], docs, words, b)
            order = np.argsort(at.astype(np.int64) << 32 | impact)
            at, impact = at[order], impact[order]
            last = np.flatnonzero(np.append((at[1:] != at[:-1]) | (impact[1:] >> _LEVEL != impact[:-1] >> _LEVEL), True)[: len(at)])
            counts = np.diff(last, prepend=-1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[last].astype(np.int64), impact[last] >> _LEVEL, counts, impact[last])], names=["at", "level", "n", "top"])

    levels = found.filter(F.size("at") > 0).select("n", "at", "tf").mapInArrow(histogram, "at long, level long, n long, top long")
    levels = levels.groupBy("at", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    levels = levels.withColumn("upto", F.sum("n").over(W.partitionBy("at").orderBy(F.col("level").desc())))
    wanted = [F.sum("n").alias("df")]
    for j, most in enumerate(capacities):
        inside = F.col("upto") <= most
        wanted += [F.coalesce(F.min(F.when(inside, F.col("level"))), F.lit(1 << 40)).alias(f"cut_{j}"), F.coalesce(F.max(F.when(~inside, F.col("top"))), F.lit(0)).alias(f"below_{j}")]
    return levels.groupBy("at").agg(*wanted)


def tiered(found: DataFrame, docs: int, words: int, b: int, cuts: np.ndarray, useful: np.ndarray) -> DataFrame:
    """row, doc_id and, by tier, terms and impacts (null where there are none) of documents with a useful term."""
    tiers = len(cuts) + 1
    shared = found.sparkSession.sparkContext.broadcast((cuts, useful))
    names = ["row", "doc_id", *(f"{c}_{j}" for j in range(tiers) for c in ("at", "impact"))]

    @trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, useful = shared.value
        for batch in (x.slice(k, _ROWS) for x in batches for k in range(0, x.num_rows, _ROWS)):
            sizes, at = _flat(batch.column("at"))
            impact = impacts(batch.column("n").to_numpy(), sizes, _flat(batch.column("tf"))[1], docs, words, b)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tier = (impact >> _LEVEL < cuts[:, at]).sum(axis=0) if len(cuts) else np.zeros(len(at), dtype=np.int64)
            columns = [batch.column("row"), batch.column("doc_id")]
            for j in range(tiers):
                here = (tier == j) & useful[at]
                each = np.bincount(doc[here], minlength=len(sizes))
                ends, none = pa.array(np.append(0, np.cumsum(each)), pa.int32()), pa.array(each == 0)
                columns += [pa.ListArray.from_arrays(ends, pa.array(x[here], pa.int32()), mask=none) for x in (at, impact)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "row long, doc_id long, " + ", ".join(f"{c}_{j} array<int>" for j in range(tiers) for c in ("at", "impact"))
    rows = found.filter(F.size("at") > 0).mapInArrow(deal, kinds)
    return rows.filter(F.coalesce(*(f"at_{j}" for j in range(tiers))).isNotNull())


class Items:
    """A block's items by term: item numbers of term t in items[starts[t] : starts[t + 1]]."""

    def __init__(self, pairs: np.ndarray, n_terms: int, n_items: int, weight: np.ndarray):
        """pairs: term and item numbers, sorted by term."""
        self.items, self.n_items, self.weight = pairs[1], n_items, weight
        self.starts = np.searchsorted(pairs[0], np.arange(n_terms + 1))
        whole = np.zeros(n_items)
        np.add.at(whole, pairs[1], weight[pairs[0]].astype(float) * 1e6)
        self.wide = bool(len(whole)) and whole.max() >= 2**53  # sums beyond what doubles hold exactly

    def only(self, some: np.ndarray) -> Items:
        """The same with those items alone for which some is true; numbers stay."""
        at = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        keep = some[self.items]
        return Items(np.array([at[keep], self.items[keep]]), len(self.starts) - 1, self.n_items, self.weight)

    def sums(self, sizes: np.ndarray, at: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First document and, for each of the values (by posting), its weighted sum by document and item."""
        each = np.diff(self.starts)[at]
        ends = np.append(0, np.cumsum(sizes))
        products = np.append(0, np.cumsum(each))[ends]
        lo, step = 0, max(1, _CELLS // max(1, self.n_items))
        while lo < len(sizes):
            hi = int(np.searchsorted(products, products[lo] + _PRODUCTS, side="right")) - 1
            hi = min(max(lo + 1, hi), lo + step, len(sizes))
            part = slice(ends[lo], ends[hi])
            n = each[part]
            place = np.arange(n.sum()) + np.repeat(self.starts[at[part]] - np.append(0, np.cumsum(n)[:-1])[: len(n)], n)
            key = np.repeat(np.repeat(np.arange(hi - lo), sizes[lo:hi]), n) * self.n_items + self.items[place]
            yield lo, [self._binned(key, np.repeat(v[part] * self.weight[at[part]], n), (hi - lo) * self.n_items) for v in values]
            lo = hi

    def _binned(self, key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        if not self.wide:
            out = np.bincount(key, weights=value, minlength=size).astype(np.int64)
        else:
            high, low = (np.bincount(key, weights=v, minlength=size).astype(np.int64) for v in (value >> 24, value & 0xFFFFFF))
            out = (high << 24) + low
        return out.reshape(-1, self.n_items)


class Best:
    """The k best (score, smaller doc_id) of each item among what is added."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, scores: np.ndarray, doc_id: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.held.append(np.array([item, scores[doc, item], doc_id[doc]]))
        self.n += len(doc)
        if self.n > 1 << 19:
            self.cut()

    def cut(self) -> np.ndarray:
        """Rows item, score, doc_id."""
        item, score, doc_id = np.concatenate([np.empty((3, 0), dtype=np.int64), *self.held], axis=1)
        order = np.lexsort((doc_id, -score, item))
        item, score, doc_id = item[order], score[order], doc_id[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        keep = place < self.k
        self.held, self.n = [np.array([item[keep], score[keep], doc_id[keep]])], int(keep.sum())
        return self.held[0]


def _postings(batch: pa.RecordBatch, tiers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by document of the first tiers: how many, terms, impacts."""
    sizes, at, impact, doc = np.zeros(batch.num_rows, dtype=np.int64), [], [], []
    for j in range(tiers):
        n, a = _flat(batch.column(f"at_{j}"))
        sizes += n
        at.append(a)
        impact.append(_flat(batch.column(f"impact_{j}"))[1])
        doc.append(np.repeat(np.arange(len(n)), n))
    order = np.argsort(np.concatenate(doc), kind="stable")
    return sizes, np.concatenate(at)[order], np.concatenate(impact).astype(np.int64)[order]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


class Index:
    """A stored index of one block of items, with its items' structure."""

    def __init__(self, rows: DataFrame, items: Items, below: np.ndarray, k: int):
        self.rows, self.items, self.below, self.k = rows, items, below, k
        self.tiers = len(below) + 1

    def _some(self, tiers: int) -> DataFrame:
        seen = F.coalesce(*(f"at_{j}" for j in range(tiers))).isNotNull()
        return self.rows.select("row", "doc_id", *(f"{c}_{j}" for j in range(tiers) for c in ("at", "impact"))).filter(seen)

    def residual(self, tier: int) -> np.ndarray:
        """Most that a document can get from below a tier, for each item."""
        at = np.repeat(np.arange(len(self.items.starts) - 1), np.diff(self.items.starts))
        out = np.zeros(self.items.n_items, dtype=np.int64)
        np.add.at(out, self.items.items, self.items.weight[at] * self.below[tier, at])
        return out

    def top(self, tier: int, some: np.ndarray) -> DataFrame:
        """item, doc_id, score: k best of the items by the postings down to a tier."""
        k, shared = self.k, self.rows.sparkSession.sparkContext.broadcast(self.items.only(some))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            best = Best(items.n_items, k)
            for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
                doc_id = _ids(batch.column("doc_id"))
                sizes, at, impact = _postings(batch, tier + 1)
                for lo, (scores,) in items.sums(sizes, at, impact):
                    best.add(scores, doc_id[lo : lo + len(scores)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.cut()], names=["item", "score", "doc_id"])

        return best_of(self._some(tier + 1).mapInArrow(run, "item long, score long, doc_id long"), k)

    def candidates(self, tier: int, least: np.ndarray, some: np.ndarray) -> DataFrame:
        """row and its items: documents that may reach an item's least score by the bounds of a tier."""
        left, below = self.residual(tier), self.below[tier]
        shared = self.rows.sparkSession.sparkContext.broadcast((self.items.only(some), least, left, below))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, least, left, below = shared.value
            for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
                row = batch.column("row").to_numpy()
                sizes, at, impact = _postings(batch, tier + 1)
                for lo, (scores, known) in items.sums(sizes, at, impact, below[at]):
                    doc, item = np.nonzero((scores > 0) & (scores + left - known >= least))
                    cuts = np.searchsorted(doc, np.unique(doc))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(doc)), pa.int32()), pa.array(item, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(row[lo + np.unique(doc)]), lists], names=["row", "items"])

        return self._some(tier + 1).mapInArrow(run, "row long, items array<int>")

    def scored(self, wanted: DataFrame, id_bytes: int) -> DataFrame:
        """item, doc_id, score, k best of each item among the wanted (row, items), by all tiers; wanted is stored."""
        k, tiers, shared = self.k, self.tiers, self.rows.sparkSession.sparkContext.broadcast(self.items)
        size = wanted.agg(F.sum(16 + 4 * F.size("items"))).first()[0] or 0
        rows = self.rows.join(F.broadcast(wanted) if size <= id_bytes else wanted, "row")

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            best = Best(items.n_items, k)
            for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
                doc_id = _ids(batch.column("doc_id"))
                n, listed = _flat(batch.column("items"))
                asked = np.zeros((batch.num_rows, items.n_items), dtype=bool)
                asked[np.repeat(np.arange(len(n)), n), listed] = True
                for lo, (scores,) in items.sums(*_postings(batch, tiers)):
                    best.add(scores * asked[lo : lo + len(scores)], doc_id[lo : lo + len(scores)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.cut()], names=["item", "score", "doc_id"])

        return best_of(rows.mapInArrow(run, "item long, score long, doc_id long"), k)


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank, from those of each task: first among some tasks, then among all."""
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = rows.withColumn("salt", F.spark_partition_id() % 32)
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return few.drop("salt").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _block(docs: DataFrame, pairs: pa.Table, k: int, b: int, capacities: list[int], id_bytes: int, scratch: Scratch, name: str, proofs: list[int] | None) -> DataFrame | None:
    """Results of the items of one block, with their numbers; pairs: item_id and term."""
    vocabulary, term = np.unique(np.array(pairs["term"].to_pylist(), dtype=object), return_inverse=True)
    ids, item = np.unique(pairs["item_id"].fill_null(_NULL_ID).to_numpy(), return_inverse=True)
    found = scratch.keep(occurrences(docs, vocabulary.tolist()), f"{name}_found")
    size = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, words = size[0], size[1] or 0
    if not words:
        return None
    known = term_statistics(found, n_docs, words, b, capacities).toArrow()
    at = known["at"].to_numpy()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    cuts, below = (np.zeros((len(capacities), len(vocabulary)), dtype=np.int64) for _ in range(2))
    df[at] = known["df"].to_numpy()
    for j in range(len(capacities)):
        cuts[j, at], below[j, at] = known[f"cut_{j}"].to_numpy(), known[f"below_{j}"].to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64) * (df > 0)
    index = scratch.keep(tiered(found, n_docs, words, b, cuts, weight > 0), f"{name}_index")
    scratch.drop(f"{name}_found")
    keep = weight[term] > 0
    order = np.argsort(term[keep], kind="stable")
    items = Items(np.array([term[keep][order], item[keep][order]]), len(vocabulary), len(ids), weight)
    search = Index(index, items, below, k)
    still, results = np.ones(len(ids), dtype=bool), []
    for tier in range(search.tiers):
        if not still.any():
            break
        best = scratch.keep(search.top(tier, still), f"{name}_top_{tier}")
        if tier == search.tiers - 1:
            results.append(best)
            break
        least, left = np.zeros(len(ids), dtype=np.int64), search.residual(tier)
        kth = best.filter(F.col("rank") == k).select("item", "score").toArrow()
        least[kth["item"].to_numpy()] = kth["score"].to_numpy()
        whole = still & (left == 0)  # nothing lies below
        proven = still & ~whole & (left < least)
        if whole.any():
            results.append(best.join(F.broadcast(_numbers(docs, whole)), "item"))
        if proven.any():
            wanted = scratch.keep(search.candidates(tier, least, proven), f"{name}_candidates_{tier}")
            results.append(search.scored(wanted, id_bytes))
        if proofs is not None:
            proofs.append(int(whole.sum() + proven.sum()))
        still &= ~(whole | proven)
    names = docs.sparkSession.createDataFrame([(k, None if x == _NULL_ID else int(x)) for k, x in enumerate(ids)], "item long, item_id long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more.select(*out.columns))
    out = out.join(F.broadcast(names), "item")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != int(_NULL_ID), F.col("doc_id")).alias("doc_id"), "score")


def _numbers(docs: DataFrame, some: np.ndarray) -> DataFrame:
    return docs.sparkSession.createDataFrame([(int(k),) for k in np.flatnonzero(some)], "item long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, first: int = 4096, growth: int = 32, tiers: int = 3, block_bytes: int = 1 << 20, id_bytes: int = 8 << 20, proofs: list[int] | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of highest score above 0 for each item.

    proofs: gets, for each tier but the last of each block, how many items ended there.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    wanted = scratch.keep(item_terms(items), "items")
    size = wanted.agg(F.sum(F.length("term") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    capacities, out = [first * growth**j for j in range(tiers - 1)], None
    for block in range(blocks if size else 0):
        pairs = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if pairs.num_rows:
            found = _block(docs, pairs, k, b, capacities, id_bytes, scratch, f"block_{block}", proofs)
            if found is not None:
                out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
