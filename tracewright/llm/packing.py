"""Best-fit packing of tokenised documents into sequences of bounded length, improved by swap-based local search.

A document is its token ids and then an end id. Only documents longer than a sequence are cut, into pieces of full length;
the last piece may be shorter. Full pieces are sequences by themselves; the others are packed.

Method. Pieces are dealt evenly to shards of about ``shard_pieces``. A shard is packed best-fit, longest piece first, and
then improved: from the emptiest underfull sequence a piece moves to a fuller one, or is exchanged for a shorter piece or
for two shorter ones there, or two of its pieces for a shorter one, as long as the sum of squared fills grows: until as
few sequences are left as the lengths' sum needs, or no such trade among all underfull sequences is left. A shard's emptiest
sequences, of ``shard_pieces`` / 64 pieces together or a single one, then go on to the next level, where those of 64 shards
become one, until one shard is left; all others are final. So the loss is a sequence or so for the whole corpus, not one for
each shard, and a task of a later level holds ``shard_pieces`` pieces at most (64 sequences, if these have more), whatever
the lengths: documents of which no two fit together stay where they are.

Order. If the documents have positions, each range of consecutive positions is packed by itself, without further levels,
and a sequence's number is the place (position, then piece) of its longest piece, the first of equal ones. So the
sequences numbered up to a range's end hold exactly the pieces of the documents up to there; the loss is a sequence or so
for each range.

Tokens. Blanks always separate words in the tokenizer's pre-tokenisation, so a text's ids are those of its
blank-separated chunks put together, and a bounded cache holds the ids of chunks already seen.

Defined cases. Null or empty text: the end id alone. Null or repeated doc_id: rows like any others. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.hashing import held, trimmed
from tracewright.llm.storage import Scratch

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, final boolean"
_PIECE_BITS = 20  # of a place; the others are the document's position
_CHUNKS = 500_000


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: the printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + k for k, b in enumerate(rest)}


class ChunkCache(dict):
    """Token ids, as little-endian unsigned 32-bit, of a chunk of text without blanks.

    Texts of code points that are below U+0250 in lower case as well are lower-cased first, as the tokenizer does, and
    their chunks are put together from their runs of letters, digits and other characters, which are the tokenizer's
    pre-tokens: these go to its merges directly, in the byte-level alphabet. Chunks with an apostrophe (contractions) or
    ``<|`` (special tokens), and all other texts, are encoded chunk by chunk.
    """

    other = re.compile("[%s\u0250-\U0010ffff]" % "".join(chr(c) for c in range(0x250) if max(map(ord, chr(c).lower())) >= 0x250))
    runs = re.compile("[a-zß-öø-\u024f]+|[0-9]|[^a-zß-öø-\u024f0-9]+")
    odd = re.compile("['ªµº¼-¾²³¹\u00d7\u00f7\u0100-\u024f]|<[|]|[\x00-\x1f\x7f-\xa0]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _merged(self, chunk: str) -> bytes:
        ids: list[int] = []
        for run in (chunk,) if chunk.isalpha() else self.runs.findall(chunk):
            raw = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.merges(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, chunks: list[str], plain: bool) -> None:
        if len(self) + len(chunks) > _CHUNKS:
            self.clear()
        slow = [c for c in chunks if not plain or self.odd.search(c)]
        self.update(zip(slow, self._each(slow), strict=True))
        for c in chunks:
            if c not in self:
                self[c] = self._merged(c)

    def ids(self, text: str) -> bytes:
        plain = not self.other.search(text)
        chunks = (text.lower() if plain else text).replace("\n", " ").split(" ")
        parts = []
        for k in range(0, len(chunks), 1 << 16):
            some = chunks[k : k + (1 << 16)]
            distinct = set(some)
            new = [c for c in distinct if c not in self]
            if new:
                if len(self) + len(new) > _CHUNKS:
                    new = list(distinct)
                self.learn(new, plain)
            parts.append(b"".join(map(self.__getitem__, some)))
        return b"".join(parts)


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and its place if order has positions."""
    end = np.array([end_id], dtype="<u4").tobytes()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held(("tokens", tokenizer), lambda: ChunkCache(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = cache.ids(text.as_py() or "") + end
                n = len(ids) // 4
                if at is not None and n > length << _PIECE_BITS:
                    raise ValueError(f"document {doc_id} has more than {1 << _PIECE_BITS} pieces")
                rows += [(doc_id, k, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), None if at is None else (at << _PIECE_BITS) + k) for k, s in enumerate(range(0, n, length))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    at = (F.col(order) if order else F.lit(None)).cast("long").alias("place")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at).mapInArrow(cut, _PIECE)


class Bins:
    """Bins of one capacity; sizes[i] is item i's size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the bin that it leaves the least room in."""
        with_room: dict[int, list[int]] = {}
        rooms = 0  # bit r: some bin has r free
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            fitting = rooms >> self.sizes[i]
            if fitting:
                room = self.sizes[i] + (fitting & -fitting).bit_length() - 1
                b = with_room[room].pop()
                if not with_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.free.append(room)
            self.items[b].append(i)
            self.free[b] = left = room - self.sizes[i]
            if left:
                with_room.setdefault(left, []).append(b)
                rooms |= 1 << left

    def _trade(self, a: int, give: list[int], b: int, take: list[int]) -> None:
        for i in give:
            self.items[a].remove(i)
            self.items[b].append(i)
        for i in take:
            self.items[b].remove(i)
            self.items[a].append(i)
        gain = sum(self.sizes[i] for i in give) - sum(self.sizes[i] for i in take)
        self.free[a] += gain
        self.free[b] -= gain

    def search(self) -> None:
        """Empties underfull bins, the emptiest first, until the bound is met or no trade between underfull bins gains."""
        left = sum(map(bool, self.items)) + sum(self.sizes) // -self.capacity
        underfull = [b for b in range(len(self.items)) if self.items[b] and self.free[b]]
        if left <= 0 or len(underfull) < 2:
            return
        offers = Offers(self.capacity)
        for b in underfull:
            offers.put(b, self.free[b], self._by_size(b))
        seen = dict.fromkeys(underfull, 0)  # offers before it can't gain for the bin as it is
        moved = True
        while moved:
            moved = False
            for a in sorted(underfull, key=lambda b: -self.free[b]):
                while self.items[a] and self.free[a]:
                    mine = self._by_size(a)
                    trade = offers.best(a, self.free[a], mine, seen[a])
                    if trade is None:
                        seen[a] = offers.n
                        break
                    b, take, pair, value = trade
                    give = _chosen(mine, value, [1] if pair else [1, 2])
                    self._trade(a, give, b, _chosen(self._by_size(b), take, [2] if pair else [0, 1]))
                    moved = True
                    for x in (a, b):
                        if offers.put(x, self.free[x], self._by_size(x) if self.items[x] and self.free[x] else {}):
                            seen = dict.fromkeys(seen, 0)
                        seen[x] = 0
                    if not self.items[a]:
                        left -= 1
                        if not left:
                            return
            underfull = [b for b in underfull if self.items[b] and self.free[b]]

    def _by_size(self, b: int) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for i in self.items[b]:
            found.setdefault(self.sizes[i], []).append(i)
        return found


def _pairs(by_size: dict[int, list[int]]) -> set[int]:
    """Sums of two different items."""
    sizes = sorted(by_size)
    return {x + y for k, x in enumerate(sizes) for y in sizes[k + 1 :]} | {2 * x for x in sizes if len(by_size[x]) > 1}


def _chosen(by_size: dict[int, list[int]], total: int, counts: list[int]) -> list[int]:
    """Items that sum to total: as many as counts allows, the first that is possible."""
    for n in counts:
        if n == 0 and total == 0:
            return []
        if n == 1 and total in by_size:
            return [by_size[total][0]]
        if n == 2:
            for x, i in by_size.items():
                if total - x in by_size and (2 * x != total or len(i) > 1):
                    return [i[0], by_size[total - x][1 if 2 * x == total else 0]]
    raise ValueError("no items of this sum")


class Offers:
    """What bins give for something longer: sums of none, one or two of their items, with the room they have besides.

    Only grows, until it is rewritten without the withdrawn offers: what comes after a place is new since then.
    """

    def __init__(self, capacity: int):
        self.capacity, self.n, self.withdrawn = capacity, 0, 0
        self.where: dict[int, tuple[int, int]] = {}
        self.rows = np.empty((4, 1024), dtype=np.int32)  # bin, sum, room, 1 if of two items

    def put(self, b: int, room: int, by_size: dict[int, list[int]]) -> bool:
        """Replaces bin b's offers, by none if by_size is empty; True if all offers have moved."""
        start, end = self.where.pop(b, (0, 0))
        self.rows[1, start:end], self.rows[2, start:end] = self.capacity, 0
        self.withdrawn += end - start
        one, two = ([0, *by_size], sorted(_pairs(by_size))) if by_size else ([], [])
        more, moved = len(one) + len(two), self.withdrawn > 4096 and 2 * self.withdrawn > self.n
        if moved:
            self._rewrite()
        while self.n + more > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], axis=1)
        if more:
            to = self.n + more
            self.rows[0, self.n : to], self.rows[1, self.n : to], self.rows[2, self.n : to] = b, one + two, room
            self.rows[3, self.n : to] = [0] * len(one) + [1] * len(two)
            self.where[b], self.n = (self.n, to), to
        return moved

    def _rewrite(self) -> None:
        kept = sorted(self.where.items(), key=lambda x: x[1])
        pieces = [self.rows[:, s:e] for _, (s, e) in kept]
        at = 0
        for b, (s, e) in kept:
            self.where[b], at = (at, at + e - s), at + e - s
        self.rows = np.concatenate([*pieces, np.empty((4, at + 1024), dtype=np.int32)], axis=1)
        self.n, self.withdrawn = at, 0

    def best(self, a: int, free: int, by_size: dict[int, list[int]], since: int) -> tuple[int, int, bool, int] | None:
        """Bin, sum taken, whether of two items, sum given: the largest gain for a bin not emptier than a; None without gain.

        Two of a's items go for none or one only, one of them for none, one or two.
        """
        if since == self.n:
            return None
        most = np.zeros((2, self.capacity + 1), dtype=np.int32)  # the largest sum of a's up to each size
        ones = list(by_size)
        most[:, ones] = ones
        twos = [x for x in _pairs(by_size) if x <= self.capacity]
        most[0, twos] = twos
        np.maximum.accumulate(most, axis=1, out=most)
        bins, sums, rooms, pair = self.rows[:, since : self.n]
        gains = most[pair, sums + rooms] - sums
        gains[(rooms > free) | (bins == a)] = 0
        k = int(gains.argmax())
        if gains[k] <= 0:
            return None
        return int(bins[k]), int(sums[k]), bool(pair[k]), int(gains[k] + sums[k])


def pack_shard(lengths: list[int], capacity: int, send: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its offset there, and whether the bin is final.

    send: the emptiest underfull bins aren't, as many as have no more pieces together, one at least; 0: all are final.
    """
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    final = np.ones(len(lengths), dtype=bool)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            place[i], offset[i] = b, at
            at += lengths[i]
    sent = 0
    for b in sorted((b for b, items in enumerate(bins.items) if send and items and bins.free[b]), key=lambda b: (-bins.free[b], b)):
        sent += len(bins.items[b])
        if sent > max(send, len(bins.items[b])):
            break
        final[bins.items[b]] = False
    return place, offset, final


def _placed(table: pa.Table, level: int, shard: int, capacity: int, send: int) -> pa.Table:
    # By content first: a task that runs again may get its rows in another order.
    table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32", "place")])
    lengths, places = table["length"].to_pylist(), table["place"].to_pylist()
    bins, offset, final = pack_shard(lengths, capacity, send)
    if places and places[0] is not None:
        longest: dict[int, tuple[int, int]] = {}
        for b, n, place in zip(bins.tolist(), lengths, places, strict=True):
            longest[b] = min(longest.get(b, (0, 0)), (-n, place))
        number = np.array([longest[b][1] for b in bins.tolist()], dtype=np.int64)
    else:
        number = (np.int64(level) << 58) + (np.int64(shard) << 26) + bins
    out = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "place"]).append_column("sequence_id", pa.array(number))
    return out.append_column("offset", pa.array(offset)).append_column("final", pa.array(final))


def _repack(level: int, capacity: int, send: int):
    @trimmed
    def again(group: pa.Table) -> pa.Table:
        return _placed(group, level, group["shard"][0].as_py(), capacity, send)

    return again


def pack_pieces(pieces: DataFrame, length: int, shard_pieces: int, scratch: Scratch) -> DataFrame:
    """Adds sequence_id and offset; pieces must be a stored table."""
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    send = lambda shards: 0 if shards == 1 else max(1, shard_pieces // 64)
    more = send(shards)

    @trimmed
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield from _placed(pa.Table.from_batches(got), 0, TaskContext.get().partitionId(), length, more).to_batches()

    # Dealt round-robin, not by doc_id: repeated ids don't meet in one shard.
    level = scratch.keep(pieces.repartition(shards).mapInArrow(first, _PLACED), "level_0")
    done, k = level.filter("final"), 0
    while shards > 1:
        rest = level.filter("not final").withColumn("shard", F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 26 + 6))
        k, shards = k + 1, math.ceil(shards / 64)
        level = scratch.keep(rest.groupBy("shard").applyInArrow(_repack(k, length, send(shards)), _PLACED), f"level_{k}")
        done = done.union(level.filter("final"))
    return done.drop("final")


def pack_ranges(pieces: DataFrame, length: int, range_pieces: int) -> DataFrame:
    """Like pack_pieces(), each range of consecutive positions, of about range_pieces, by itself."""
    size = pieces.agg(F.count("*").alias("n"), F.max(F.shiftright("place", _PIECE_BITS)).alias("last")).first()
    positions = math.ceil(((size["last"] or 0) + 1) / max(1, math.ceil(size["n"] / range_pieces)))
    ranges = pieces.withColumn("shard", F.floor(F.shiftright("place", _PIECE_BITS) / positions).cast("long"))
    return ranges.groupBy("shard").applyInArrow(_repack(0, length, 0), _PLACED).drop("final")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, shard_pieces: int = 16384, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; tokenizer: path of a vocabulary.

    order: column of the documents' different positions (from 0, below 2**43) that the sequences are to keep.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, tokenizer, length, end_id, order), "pieces")
    whole = pieces.filter(F.col("length") == length)
    number = F.col("place") if order else -1 - F.monotonically_increasing_id()
    whole = whole.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < length)
    packed = pack_ranges(short, length, shard_pieces) if order else pack_pieces(short, length, shard_pieces, scratch)
    return packed.unionByName(whole).drop("place")
