"""Resampling of documents towards a target distribution by importance weights of hashed n-grams of words.

Words are maximal runs of ASCII letters and digits and of code points beyond ASCII, with A-Z lower-cased. Features are all
runs of 1 to ``longest`` consecutive words, joined by one blank; a feature's bucket is the unsigned crc32 of its UTF-8 bytes
modulo ``buckets``. With S features and s in the bucket in all documents, T and t in all target texts, a bucket's gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), and a document's weight is the sum of the gains of its
features. A document's noise is floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256("seed:doc_id"):
drawing the highest weight + noise draws without replacement in proportion to exp(weight / 1000).

Method. Identical texts are collapsed first, by grouping the full text, so that features are computed, hashed and weighed
once a text; counts over the corpus multiply by the number of copies. Weights go back to the documents by the text's
sha256, and only then comes the noise, which is each document's own. The ranks come from one sort by ranges: a row's place
within its range plus the sizes of the ranges before it.

Scale. Texts are shuffled once, with copies merged before they move, so a text that a third of the rows share moves once a
task. What is kept of a text is two bytes a word (four with over 2**16 buckets). Weights return through a join of narrow
rows, which Spark splits where one text has very many copies. Driver and broadcasts hold ``buckets`` numbers and one
number for each range. The drawn number is counted, not estimated.

Defined cases. Null text: no words, weight 0. Null doc_id: noise of the empty id, after others at equal scores. Repeated
doc_id: rows like others, each with its own text's weight and the same noise. Rows equal in score and doc_id: fewer features
first, and then they are alike. No target texts, or no documents: counts of 0. Empty table: no rows. Very long texts are
read in slices. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.hashing import held, trimmed
from tracewright.llm.storage import Scratch
from tracewright.llm.terms import terms

_KNOWN = 100_000
_ROWS = 512


class Buckets(dict):
    """Buckets of features, kept for those seen lately."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, text: pa.Scalar) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature of a text."""
        n, out, before = 0, [np.empty(0, dtype=self.kind)], deque(maxlen=self.longest - 1)
        for words in terms(text):
            n += len(words)
            out.append(np.fromiter(map(self.__getitem__, words), dtype=self.kind, count=len(words)))
            if self.longest > 1:
                row = [*before, *words]
                for size in range(2, self.longest + 1):
                    runs = [b" ".join(row[k - size + 1 : k + 1]) for k in range(max(len(before), size - 1), len(row))]
                    out.append(np.fromiter(map(self.__getitem__, runs), dtype=self.kind, count=len(runs)))
                before.extend(words)
        return n, np.concatenate(out)


def features(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """digest, copies, n_words, n_features and packed buckets of every different text."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = held(("buckets", buckets, longest), lambda: Buckets(buckets, longest))
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            got = [find.of(text) for text in batch.column("text")]
            columns = [
                batch.column("digest"),
                batch.column("copies"),
                pa.array([n for n, _ in got], pa.int64()),
                pa.array([len(b) for _, b in got], pa.int64()),
                pa.array([b.tobytes() for _, b in got], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "copies", "n_words", "n_features", "packed"])

    collapsed = texts.select(F.col("text").cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    return collapsed.select(_digest(), "copies", "text").mapInArrow(run, "digest binary, copies long, n_words long, n_features long, packed binary")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies included."""
    kind = Buckets(buckets, 1).kind

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed, copies in zip(batch.column("packed"), batch.column("copies").to_numpy(), strict=True):
                total += int(copies) * np.bincount(np.frombuffer(packed.as_buffer(), dtype=kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = found.select("packed", "copies").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, rounded down."""
    n, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n_words, n_features and weight of every different text; gain: a number for each bucket."""
    shared, kind = found.sparkSession.sparkContext.broadcast(gain), Buckets(len(gain), 1).kind

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(shared.value[np.frombuffer(packed.as_buffer(), dtype=kind)].sum()) for packed in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "n_words", "n_features")), pa.array(sums, pa.int64())], names=["digest", "n_words", "n_features", "weight"])

    return found.select("digest", "n_words", "n_features", "packed").mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise of a doc_id in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Adds rank: 1, 2, 3... by falling score among the eligible rows, null beyond that percentage of them, rounded down.

    scored: a stored table of doc_id, n_features, weight, score and eligible.
    """
    names = scored.columns
    kinds = scored.schema.add("part", "long").add("place", "long")
    ranges = max(1, -(-scored.count() // 250_000))

    @trimmed
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int64)), place], names=[*names, "part", "place"])

    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    placed = scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(number, kinds)
    placed = scratch.keep(placed, "placed")
    sizes = sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("able")).collect())
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    drawn = percent * sum(r["able"] for r in sizes) // 100
    offsets = scored.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(F.col("eligible") & (rank <= drawn), rank)).select(*names, "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; target: a table of texts.

    percent of the rows with at least least_words words are drawn; the others' rank is null.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    found = scratch.keep(features(docs, buckets, longest), "features")
    wanted = scratch.keep(features(target, buckets, longest), "target")
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weighed = scratch.keep(weights(found, gain), "weights")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest()).join(weighed, "digest", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.select("doc_id", number(F.col("n_features")).alias("n_features"), number(F.col("weight")).alias("weight"), (number(F.col("n_words")) >= least_words).alias("eligible"))
    scored = scratch.keep(rows.withColumn("score", F.col("weight") + noise(seed)), "scored")
    return ranked(scored, percent, scratch).select("doc_id", "n_features", "weight", "score", "rank")
