"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features. A text is lower-cased, runs of anything but letters become one blank, and its 1- to 4-grams of code points are
hashed into 2**16 features. The weight of a feature in a document is its share of the document's n-grams times its
inverse document frequency. Document frequencies count every whole labelled document that may be learned from.

Model. One-against-each logits trained by follow-the-regularised-leader with elastic-net penalties, so that most weights
are exactly zero, on a bounded sample: the ``per_label`` documents a label with the smallest id hashes, fewer if there are
so many labels that this would be more than ``sample_rows`` documents, 8 at least. Every label is learned. A fifth of the
sample stays out of training; on it a temperature is fitted, which makes the score a calibrated probability.

Rejection. A probability among the learned labels says nothing of other languages, as one label always comes out best. So
``identified`` looks at the n-grams themselves: a feature is foreign if fewer than one in 500 of the learnable documents has
it, and a text of n n-grams is in none of the learned languages if its share of foreign ones is above a limit plus
1 / sqrt(n), or plus 4 / n if that is more, at any length. The limit is 0.06, or half as much again as what the sample's documents that stayed out of
training reach, each against the counts of the others. Passages in several learned languages aren't foreign.

Learning sees only the text and label of rows for which ``learnable`` is true. Prediction sees only the text.

Defined cases. Null text or text without a letter: ``und`` with score 0. No labelled row at all: ``und`` with score 0 for
every row. Very long texts are read in slices that overlap by three characters, whole. Null ids: predicted like others,
never learned from. Labels of equal probability: the first in the order of code points. Empty table: no rows. Extra
columns are ignored (``identified`` keeps them).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.hashing import give_back, held, mix, trimmed
from tracewright.llm.storage import free_names, limit_batches

FEATURES = 1 << 16
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"
_SLICE = 1 << 18
#: Rows that a worker turns into Python strings at a time.
_ROWS = 256


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """By code point: the lower-case letter, or 0 where it isn't a letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Grams:
    """Hashed n-grams of texts, slice by slice."""

    def __init__(self) -> None:
        self.table = _letter_table()
        rng = np.random.default_rng(11)
        self.base = [np.uint64(int(x) * 2 + 1) for x in rng.integers(1, 2**62, len(ORDERS))]

    def slices(self, text: str | None) -> Iterator[np.ndarray]:
        """Feature numbers of all n-grams of a text; nothing if it has no letter."""
        tail = np.zeros(1, dtype=np.uint32)
        for at in range(0, len(text or ""), _SLICE):
            raw = np.frombuffer(text[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes = np.concatenate([tail, self.table[raw], np.zeros(int(at + _SLICE >= len(text)), dtype=np.uint32)])
            keep = np.ones(len(codes), dtype=bool)
            keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
            codes = codes[keep]
            old, tail = (len(tail) if at else 0), codes[-(ORDERS[-1] - 1) :]
            if codes.any():
                yield self._hash(codes.astype(np.uint64) + np.uint64(1), old)

    def _hash(self, codes: np.ndarray, old: int) -> np.ndarray:
        """old: that many codes at the front were in the slice before; n-grams of these alone were counted there."""
        out = []
        for k, n in enumerate(ORDERS):
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = codes[:m].copy()
            for j in range(1, n):
                h = h * self.base[k] + codes[j : j + m]
            h = h[max(0, old - n + 1) :]
            if n == 1:
                h = h[h != 1]
            out.append(mix(h + np.uint64(n << 40)) >> np.uint64(48))
        return np.concatenate(out).astype(np.int64)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(FEATURES, dtype=np.float64)
        for f in self.slices(text):
            total += np.bincount(f, minlength=FEATURES)
        at = np.flatnonzero(total)
        return at, total[at]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    foreign: np.ndarray  # by feature
    limit: float = 0.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (counts * self.idf[at] / counts.sum()) @ self.weights[at] + self.bias


def foreign_limit(rows: list[tuple[np.ndarray, np.ndarray]], seen: np.ndarray, least: float, floor: float = 0.06) -> float:
    """Limit for the share of foreign n-grams; rows: (features, counts) of documents that are among those of seen."""
    most = [float(counts[seen[at] - 1 < least].sum() / counts.sum() - counts.sum() ** -0.5) for at, counts in rows]
    return max([floor, *(1.5 * x for x in most)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; rows: (features, values). The values' scale is part of the penalties' meaning."""
    z, n, w = (np.zeros((FEATURES + 1, n_labels)) for _ in range(3))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            error = _softmax(x @ w[at])
            error[labels[i]] -= 1
            g = x[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w[at]
            n[at] = more
            za = z[at]
            l1_here = np.where(at == FEATURES, 0.0, l1)[:, None]
            w[at] = np.where(np.abs(za) <= l1_here, 0.0, -(za - np.sign(za) * l1_here) / ((beta + np.sqrt(more)) / alpha + l2))
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Targets are smoothed by one doubtful document, so that a sample without errors doesn't give certainty.
    """
    if not len(labels):
        return 1.0

    smooth = 1.0 / (len(labels) + 2)
    target = np.full(logits.shape, smooth / logits.shape[1])
    target[np.arange(len(labels)), labels] += 1 - smooth

    def loss(t: float) -> float:
        return -float((target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean())

    lo, hi, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(df: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with letters, and how many of them have each feature."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, n = held("grams", Grams), np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in (t.as_py() for t in batch.column(0)):
                here = np.zeros(FEATURES, dtype=bool)
                for f in grams.slices(text):
                    here[f] = True
                seen += here
                n += bool(here.any())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, FEATURES)), pa.array(np.append(seen[at], n))], names=["f", "n"])

    got = df.select(F.col("text").cast("string")).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    out[got["f"].to_numpy()] = got["n"].to_numpy()
    return int(out[FEATURES]), out[:FEATURES]


def fit(docs: DataFrame, learnable: Column, per_label: int = 500, sample_rows: int = 64_000) -> Model | None:
    """Learns from (text, lang) of the learnable rows; None if there is nothing to learn from.

    The driver holds the feature vectors of at most sample_rows rows (8 a label at least), and 2**16 counts.
    """
    limit_batches(docs.sparkSession)
    rows = docs.filter(F.coalesce(learnable, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not per:
        return None
    n_docs, seen = _frequencies(rows)
    idf = np.log((1 + n_docs) / (1 + seen)) + 1.0
    least = max(1.0, n_docs / 500)
    labels = sorted(r["lang"] for r in per)
    place = {label: k for k, label in enumerate(labels)}
    per_label = min(per_label, max(8, sample_rows // len(labels)))
    # A share of each label by the hash of the id, with room to spare; then the smallest hashes of these few.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * (per_label + 20) / r["n"])) for r in per], "lang string, share double")
    rank = F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(""))), 11) / float(1 << 53)
    few = rows.withColumn("rank", rank).join(F.broadcast(shares), "lang").filter("rank < share")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("rank", "id", "text"))).filter(F.col("r") <= per_label)

    @trimmed
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held("grams", Grams)
        for batch in batches:
            for lang, r, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at, counts = grams.counts(text)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "r": [r], "at": [at.astype(np.uint16).tobytes()], "counts": [counts.astype(np.float32).tobytes()]})

    sample = few.select("lang", "r", "text").mapInArrow(vectors, "lang string, r long, at binary, counts binary").toArrow().to_pylist()
    sample = sorted((x for x in sample if x["at"]), key=lambda x: (x["r"], x["lang"]))
    grams = [(np.frombuffer(x.pop("at"), dtype=np.uint16).astype(np.int64), np.frombuffer(x.pop("counts"), dtype=np.float32).astype(np.float64)) for x in sample]
    y = np.array([place[x["lang"]] for x in sample], dtype=np.int64)
    apart = np.array([x["r"] % 5 == 0 for x in sample], dtype=bool)
    scale = 10.0
    fed = [(at, scale * counts * idf[at] / counts.sum()) for at, counts in grams]
    use = [i for i in range(len(fed)) if not apart[i]]
    weights, bias = train_ftrl([fed[i] for i in use], y[use], len(labels))
    model = Model(labels, idf, np.ascontiguousarray(weights * scale), bias, 1.0, seen < least)
    model.limit = foreign_limit([grams[i] for i in np.flatnonzero(apart)], seen, least)
    out = np.array([model.logits(*grams[i]) for i in np.flatnonzero(apart)]).reshape(-1, len(labels))
    model.temperature = fit_temperature(out, y[apart])
    del sample, grams, fed
    give_back()  # on the driver, which holds no more than the model from now on
    return model


def _predictor(model: Model | None, reject: bool) -> Callable[[pa.Array], tuple[list[str], list[float]]]:
    grams = held("grams", Grams)
    heavy = None if model is None else np.ascontiguousarray(model.idf[:, None] * model.weights)

    def predict(column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in column.to_pylist():
            total, n, foreign = 0.0, 0, 0
            if model is not None:
                for f in grams.slices(text):
                    total = total + heavy[f].sum(axis=0)
                    n += len(f)
                    foreign += int(model.foreign[f].sum())
            if n:
                p = _softmax((total / n + model.bias) / model.temperature)
                k = int(np.argmax(p))
                names.append(UNDETERMINED if reject and foreign / n > model.limit + max(n**-0.5, 4 / n) else model.labels[k])
                scores.append(float(p[k]))
            else:
                names.append(UNDETERMINED)
                scores.append(0.0)
        return names, scores

    return predict


def predict(docs: DataFrame, model: Model | None, carry: list[str], added: tuple[str, str] = ("lang_pred", "score"), reject: bool = False) -> DataFrame:
    """The carried columns and the two added ones, prediction and score, for every row.

    The model, 2**16 * (labels + 1) numbers however long the input, is broadcast. reject: texts in none of the learned
    languages get ``und``, their score kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = "text" in carry and dict(docs.dtypes)["text"] == "string"
    chosen = docs.select(*carry) if whole else docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*carry).schema.add(added[0], "string").add(added[1], "double")
    at = carry.index("text") if whole else len(carry)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _predictor(shared.value, reject)
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            names, scores = use(batch.column(at))
            columns = [batch.column(k) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*carry, *added])

    return chosen.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def identify(docs: DataFrame, per_label: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fold 0 of five is held out from learning."""
    model = fit(docs, fold() != 0, per_label)
    return predict(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), model, ["doc_id", "held_out"])


def identified(docs: DataFrame, per_label: int = 500) -> DataFrame:
    """docs in which a learned language was found, with all their columns.

    Those without any letter go, with or without a model, and so do texts in none of the learned languages.
    """
    model = fit(docs, fold() != 0, per_label)
    names = docs.columns
    pred, score = free_names(names, "pred", "score")
    if model is None:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    return predict(docs, model, names, (pred, score), reject=True).filter(F.col(pred) != UNDETERMINED).select(*names)
