"""Removal of word sequences that repeat anywhere in the corpus, by fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes if some window that covers it also starts earlier:
in a document with a smaller id, or further left in the same document. Windows are judged on the input.

Method. Every document is cut into non-overlapping reference blocks of ``anchor = window // 2`` words. A window holds at
least one whole block, so a window that occurs twice holds a block that some other place of the corpus holds as well.

1. Index and probe: the hash of every rolling run of ``anchor`` words, with a flag where it is a reference block, goes to
   the bucket of its leading bits. A hash is an anchor if one of its places is a block and it has a second place.
2. Extend: around the anchors of a document, all full windows go to buckets by their 96-bit hash, each with the smallest
   document that has it. Adjacent repeated windows merge into maximal repeats when the covered words are marked.
3. The words covered are cut from the texts.

Layout. Documents are packed, about ``pack_bytes`` of text to a row, into a table hashed by pack. A pack sends each of
its distinct hashes once, sorted and delta-coded, one row per bucket; the answer is one bit per hash sent. So a passage
that a third of all documents share costs one entry a pack, texts move through no shuffle, and no row is dropped.

Defined cases. Null text: no words. Null doc_id: the row is kept whole and is nobody's earlier document. Rows that share
a doc_id: none is earlier than the other. Empty table: no rows. Extra columns are ignored (``corpus`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import hashing
from tracewright.llm.storage import Scratch, free_names, numbers_in_bucket

_PACK = "pack long, ids array<long>, texts array<string>"
_ANCHOR_BITS, _WINDOW_BITS = 32, 48


def _list(values: np.ndarray | pa.Array, bounds: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def pack_documents(df: DataFrame, pack_bytes: int, buckets: int = 1) -> DataFrame:
    """Neighbouring documents as one row: pack, ids, texts.

    A task numbers its packs so that all of them fall into one of the buckets: it then writes one file.
    """

    @hashing.trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        numbers = numbers_in_bucket(task << 32, task % buckets, buckets)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            texts = batch.column(1).cast(pa.string()).fill_null("")
            _, bounds = hashing.string_buffers(texts)
            share = bounds[-1] / max(1, round(bounds[-1] / pack_bytes))
            for i, j in hashing.runs(bounds, int(1.05 * share) + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(numbers)], pa.int64()), _list(ids[i:j], [0, j - i]), _list(texts[i:j], [0, j - i])],
                    names=["pack", "ids", "texts"],
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, _PACK)


class _Pack:
    """The words of a pack's documents, and which windows lie inside one document."""

    def __init__(self, ids: pa.Array, texts: pa.Array, hasher: hashing.WordHasher):
        self.has_id = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.data, self.bounds = hashing.string_buffers(texts)
        self.starts, self.ends, self.first = hashing.find_words(self.data, self.bounds)
        self.hashes = hasher.words(self.data, self.starts, self.ends)
        self.hasher = hasher
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))

    def places(self, width: int) -> np.ndarray:
        """Word positions at which a run of width words starts within one document that has an id."""
        last = self.first[1:][self.doc] - width
        return np.flatnonzero((np.arange(len(self.doc)) <= last) & self.has_id[self.doc])

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, their hashes, and whether they are reference blocks."""
        at = self.places(width)
        return at, self.hasher.windows(self.hashes, width)[at], (at - self.first[:-1][self.doc[at]]) % width == 0

    def windows(self, width: int, anchor: int, hits: np.ndarray) -> np.ndarray:
        """Places of the windows that hold an anchor; hits: the anchors' places."""
        near = np.zeros(len(self.doc) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(hits - (width - anchor), 0), 1)
        np.add.at(near, hits + 1, -1)
        at = self.places(width)
        return at[np.cumsum(near)[at] > 0]


def _planes(values: np.ndarray, width: int) -> bytes:
    """Sorted values as differences, byte by byte, so that the leading zeros lie together."""
    diff = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(blob: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8).reshape(width, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(bucket):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
    return at, np.append(at[1:], len(bucket))


def _bits(spread: int) -> int:
    return max(1, math.ceil(math.log2(spread)))


def _fold(hashes: np.ndarray, bits: int, low: int) -> np.ndarray:
    """The leading bits + low bits of each hash: bucket, then what is sent."""
    return hashes >> np.uint64(64 - bits - low)


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the values, the distinct ones, and where each begins in that order."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    return order, ranked[begin], begin


def _anchor_rows(pack: _Pack, anchor: int, bits: int):
    """(places, order, begin, distinct folded hashes, block flag, repeated flag) of a pack's rolling runs."""
    at, hashes, block = pack.anchors(anchor)
    order, distinct, begin = _grouped(_fold(hashes, bits, _ANCHOR_BITS))
    if not len(at):
        return at, order, begin, distinct, np.empty(0, dtype=bool), np.empty(0, dtype=bool)
    size = np.diff(begin, append=len(order))
    return at, order, begin, distinct, np.logical_or.reduceat(block[order], begin), size > 1


def _window_rows(pack: _Pack, second: hashing.WordHasher, window: int, anchor: int, bits: int, anchor_hit: np.ndarray):
    """(places, order, begin, distinct keys, check, smallest document) of a pack's windows around anchors."""
    at, order, begin, _, _, _ = _anchor_rows(pack, anchor, bits)
    size = np.diff(begin, append=len(order))
    places = pack.windows(window, anchor, at[order[np.repeat(anchor_hit, size)]])
    if not len(places):
        none = np.empty(0, dtype=np.uint64)
        return places, places, places, none, none, none
    words = second.words(pack.data, pack.starts, pack.ends)
    key, check = pack.hasher.windows(pack.hashes, window)[places], second.windows(words, window)[places] >> np.uint64(32)
    order = np.lexsort((check, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(pack.ids[pack.doc[places]][order], begin)
    return places, order, begin, key[order[begin]], check[order[begin]], least


def _narrow(values: np.ndarray) -> tuple[int, int, bytes]:
    """Frame of reference: base, bytes a value, differences from the base."""
    base = int(values.min())
    diff = (values.astype(np.int64).view(np.uint64) - np.uint64(base % 2**64)).astype("<u8")
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(diff.max()) < 256**w)
    return base, width, diff.astype(f"<u{width}").tobytes()


def _wide(base: int, width: int, blob: bytes) -> np.ndarray:
    return (np.frombuffer(blob, dtype=f"<u{width}").astype(np.uint64) + np.uint64(base % 2**64)).view(np.int64)


def _hashers() -> tuple[hashing.WordHasher, hashing.WordHasher]:
    return hashing.WordHasher(1), hashing.WordHasher(2)


def _answers(column: pa.Array, bucket: np.ndarray) -> np.ndarray:
    """Joins a pack's answers, a list of (bucket, bits), to its hashes, which are sorted by bucket."""
    hit = np.zeros(len(bucket), dtype=bool)
    given = {a["bucket"]: a["hit"] for a in column.as_py() or ()}
    for lo, hi in zip(*_cuts(bucket), strict=True):
        if (blob := given.get(int(bucket[lo]))) is not None:
            hit[lo:hi] = np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=hi - lo).astype(bool)
    return hit


def _by_pack(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "hit")).alias(name))


def _reply(packs: list[int], sizes: list[int], bucket: int, hit: np.ndarray) -> pa.Table:
    """One row for each pack that has a hit."""
    rows, at = [], 0
    for pack, n in zip(packs, sizes, strict=True):
        part = hit[at : at + n]
        at += n
        if part.any():
            rows.append((pack, np.packbits(part).tobytes()))
    return pa.table({
        "pack": pa.array([r[0] for r in rows], pa.int64()),
        "bucket": pa.array([bucket] * len(rows), pa.int64()),
        "hit": pa.array([r[1] for r in rows], pa.binary()),
    })


def bucket_size(total: int) -> int:
    """Bytes of text a bucket: 8 MB; from 2 GB of text on as many as make 256 buckets, up to 32 MB; from 64 GB on 2,048, up to 64 MB."""
    return min(max(8 << 20, min(total // 256, 32 << 20), total // 2048), 64 << 20)


def repeated_passages(docs: DataFrame, window: int = 20, pack_bytes: int = 2 << 20, bucket_bytes: int | None = None, with_text: bool = False) -> DataFrame:
    """Cuts repeated passages: doc_id, n_words, n_removed, kept_sha256, and the kept text if with_text.

    kept_sha256 is of the kept words joined by one space; text is the original where nothing was removed; was is the
    original's MD5.
    bucket_bytes: text for each hash bucket; a task holds the hashes of one bucket. A pack has a row a bucket, so rows would
    grow as the square of the text; unless given, it is ``bucket_size`` of the text.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    spark, anchor = docs.sparkSession, window // 2
    scratch = Scratch(spark, "substring")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bucket_bytes = bucket_bytes or bucket_size(total)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(2, math.ceil(total / bucket_bytes))
    bits = _bits(spread)
    buckets = max(shuffle, spread // 2)
    packs = scratch.keep_bucketed(pack_documents(docs, pack_bytes, buckets), "packs", "pack", buckets)

    @hashing.trimmed
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, _ = hashing.held("windows", _hashers)
        for batch in batches:
            for number, ids, texts in zip(*(batch.column(c) for c in ("pack", "ids", "texts")), strict=True):
                *_, distinct, block, again = _anchor_rows(_Pack(ids.values, texts.values, hasher), anchor, bits)
                bucket = distinct >> np.uint64(_ANCHOR_BITS)
                low = distinct & np.uint64(2**_ANCHOR_BITS - 1)
                lo, hi = _cuts(bucket)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[lo].astype(np.int64)),
                    "pack": pa.array([number.as_py()] * len(lo), pa.int64()),
                    "n": pa.array((hi - lo).astype(np.int32)),
                    "hashes": pa.array([_planes(low[a:b], 4) for a, b in zip(lo, hi, strict=True)], pa.binary()),
                    "flags": pa.array([np.packbits([block[a:b], again[a:b]]).tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
                })

    @hashing.trimmed
    def match_anchors(group: pa.Table) -> pa.Table:
        packs, sizes = group["pack"].to_pylist(), group["n"].to_pylist()
        hashes = np.concatenate([_unplanes(b, n, 4) for b, n in zip(group["hashes"].to_pylist(), sizes, strict=True)])
        flags = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=2 * n).reshape(2, n).astype(bool) for b, n in zip(group["flags"].to_pylist(), sizes, strict=True)]
        block, again = np.concatenate(flags, axis=1)
        order, _, begin = _grouped(hashes)
        size = np.diff(begin, append=len(order))
        good = np.logical_or.reduceat(block[order], begin) & ((size > 1) | np.logical_or.reduceat(again[order], begin))
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = np.repeat(good, size)
        return _reply(packs, sizes, group["bucket"][0].as_py(), hit)

    sent = packs.mapInArrow(first, "bucket long, pack long, n int, hashes binary, flags binary")
    reply = "pack long, bucket long, hit binary"
    anchors = scratch.keep(_by_pack(sent.groupBy("bucket").applyInArrow(match_anchors, reply), "anchors"), "anchors")

    def anchor_hits(pack: _Pack, column: pa.Scalar) -> np.ndarray:
        *_, distinct, _, _ = _anchor_rows(pack, anchor, bits)
        return _answers(column, distinct >> np.uint64(_ANCHOR_BITS))

    @hashing.trimmed
    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = hashing.held("windows", _hashers)
        for batch in batches:
            for number, ids, texts, found in zip(*(batch.column(c) for c in ("pack", "ids", "texts", "anchors")), strict=True):
                pack = _Pack(ids.values, texts.values, hasher)
                *_, key, check, least = _window_rows(pack, other, window, anchor, bits, anchor_hits(pack, found))
                bucket = key >> np.uint64(64 - bits)
                lo, hi = _cuts(bucket)
                spans = list(zip(lo, hi, strict=True))
                framed = [_narrow(least[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[lo].astype(np.int64)),
                    "pack": pa.array([number.as_py()] * len(lo), pa.int64()),
                    "n": pa.array((hi - lo).astype(np.int32)),
                    "keys": pa.array([_planes(key[a:b] & np.uint64(2 ** (64 - bits) - 1), 8) for a, b in spans], pa.binary()),
                    "checks": pa.array([check[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    "base": pa.array([f[0] for f in framed], pa.int64()),
                    "width": pa.array([f[1] for f in framed], pa.int32()),
                    "least": pa.array([f[2] for f in framed], pa.binary()),
                })

    @hashing.trimmed
    def match_windows(group: pa.Table) -> pa.Table:
        packs, sizes = group["pack"].to_pylist(), group["n"].to_pylist()
        key = np.concatenate([_unplanes(b, n, 8) for b, n in zip(group["keys"].to_pylist(), sizes, strict=True)])
        check = np.concatenate([np.frombuffer(b, dtype="<u4") for b in group["checks"].to_pylist()])
        least = np.concatenate([_wide(*x) for x in zip(*(group[c].to_pylist() for c in ("base", "width", "least")), strict=True)])
        order = np.lexsort((check, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(order))
        hit = np.empty(len(order), dtype=bool)
        hit[order] = least[order] > np.repeat(np.minimum.reduceat(least[order], begin), size)
        return _reply(packs, sizes, group["bucket"][0].as_py(), hit)

    found = packs.join(anchors.hint("shuffle_hash"), "pack")
    sent = found.mapInArrow(second_pass, "bucket long, pack long, n int, keys binary, checks binary, base long, width int, least binary")
    earlier = scratch.keep(_by_pack(sent.groupBy("bucket").applyInArrow(match_windows, reply), "earlier"), "earlier")
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string, was string" * with_text

    @hashing.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = hashing.held("windows", _hashers)
        for batch in batches:
            for ids, texts, found, before in zip(*(batch.column(c) for c in ("ids", "texts", "anchors", "earlier")), strict=True):
                pack = _Pack(ids.values, texts.values, hasher)
                hits = anchor_hits(pack, found)
                cover = np.zeros(len(pack.doc) + 1, dtype=np.int64)
                if hits.any():
                    places, order, begin, key, _, least = _window_rows(pack, other, window, anchor, bits, hits)
                    if len(places):
                        size = np.diff(begin, append=len(order))
                        elsewhere = np.repeat(_answers(before, key >> np.uint64(64 - bits)), size)
                        doc = pack.doc[places[order]]
                        here = pack.ids[doc] > np.repeat(least, size)
                        # Of a window's places in one document the leftmost stays, if no document has it earlier.
                        later = np.zeros(len(order), dtype=bool)
                        later[1:] = doc[1:] == doc[:-1]
                        later[begin] = False
                        gone = places[order[elsewhere | here | later]]
                        np.add.at(cover, gone, 1)
                        np.add.at(cover, gone + window, -1)
                yield _kept(pack, ids.values, texts.values, np.cumsum(cover[:-1]) == 0, with_text)

    plan = packs.join(anchors.hint("shuffle_hash"), "pack", "left").join(earlier.hint("shuffle_hash"), "pack", "left")
    return plan.mapInArrow(cut, fields)


def _kept(pack: _Pack, ids: pa.Array, texts: pa.Array, keep: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """What is left of each document of a pack."""
    first, data = pack.first, pack.data.copy()
    sums = np.append(0, np.cumsum(keep))
    n_kept = sums[first[1:]] - sums[first[:-1]]
    marks = np.zeros(len(data) + 1, dtype=np.int8)
    marks[pack.starts[keep]] += 1
    marks[pack.ends[keep]] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    joint = kept[:-1][pack.doc[kept[:-1]] == pack.doc[kept[1:]]]
    data[pack.ends[joint]] = 0x20
    inside[pack.ends[joint]] = True
    bytes_before = np.append(0, np.cumsum(inside))[pack.bounds]
    out = data[inside].tobytes()
    parts = [out[a:b] for a, b in zip(bytes_before[:-1], bytes_before[1:], strict=True)]
    n_words = np.diff(first)
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        whole = (n_words == n_kept).tolist()
        before = texts.to_pylist()
        columns.append(pa.array([t if w else p.decode() for t, w, p in zip(before, whole, parts, strict=True)], pa.string()))
        columns.append(pa.array([hashlib.md5(t.encode()).hexdigest() for t in before], pa.string()))
        names += ["text", "was"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def corpus(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with repeated passages cut and n_chars renewed; documents that consisted of repeats only go.

    Every other column stays. Rows with a null doc_id, and rows in which nothing repeats, stay as they are.
    Rows that share a doc_id and text are cut alike. Columns may have any names.
    """
    cut_id, was, cut_text = free_names(docs.columns, "cut_id", "cut_was", "cut_text")
    cut = repeated_passages(docs, window, with_text=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(cut_id), F.col("was").alias(was), F.col("text").alias(cut_text)).dropDuplicates([cut_id, was])
    out = docs.join(cut, (docs["doc_id"] == cut[cut_id]) & (F.md5(docs["text"].cast("binary")) == cut[was]), "left")
    out = out.filter(F.coalesce(F.col(cut_text) != "", F.lit(True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut_id).isNull(), F.col("n_chars")).otherwise(F.length(cut_text).cast("long")))
    return out.withColumn("text", F.coalesce(cut_text, "text")).select(*docs.columns)
