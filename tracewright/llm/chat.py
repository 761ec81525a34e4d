"""Chat formatting by token-level assembly.

A turn is rendered as a role mark, the text and an end mark. Known roles have a mark of their own; any other role is
written out between two marks. In token form the marks are reserved ids above the vocabulary, spliced between segments
that are encoded separately, so that no text can produce a mark and no token spans a boundary. Control strings inside a
text or role get one backslash before them, and before those that they already have; taking one away restores the text.
The loss mask covers the assistant's texts; it is derived from the segment lengths by prefix sums.

Turns are formatted row by row, so a conversation of any length needs no task of its own; reading back streams the rows
of a conversation in order with constant memory.

Defined cases. Null text: empty. Null role: the empty role, which is an unknown one. Null conv_id: one conversation. Rows
of equal turn are ordered by role, then formatted text; a null turn comes first. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks in their order of reserved ids.
KNOWN = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
ROLE, TEXT, END = "### Role: ", "### Text: ", "</turn>"
MARKS = [*KNOWN.values(), ROLE, TEXT, END]
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, MARKS)) + ")")
_ESCAPED = re.compile(r"\\(\\*)(" + "|".join(map(re.escape, MARKS)) + ")")
_TURN = "conv_id long, turn long, role string, ids array<int>, loss array<byte>, formatted string"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


#: The white space of the tokenizer's pattern. Runs this long aren't given to its matcher, which backtracks.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encode(encoding, text: str) -> list[int]:
    """Ids of a text, as the tokenizer gives them.

    White space before other characters is one pre-token up to its last character, and at a text's end up to there. So a
    long run is merged by itself, and what lies around it is encoded separately.
    """
    ids, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def assemble(segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of segments (ids, in the loss?)."""
    ends = np.cumsum([len(s) for s, _ in segments])
    change = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
    for (ids, counts), end in zip(segments, ends, strict=True):
        if counts:
            change[end - len(ids)] += 1
            change[end] -= 1
    return np.concatenate([np.asarray(s, dtype=np.int32) for s, _ in segments]), np.cumsum(change[:-1], dtype=np.int8)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, ids, loss and formatted of every turn; tokenizer: path of a byte-level vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, reserved = _encoding(tokenizer)
        number = {mark: reserved + k for k, mark in enumerate(MARKS)}
        for batch in batches:
            ids, loss, formatted = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                body = escape(text)
                if role in KNOWN:
                    head, segments = KNOWN[role], [([number[KNOWN[role]]], False)]
                else:
                    head = ROLE + escape(role) + TEXT
                    segments = [([number[ROLE]], False), (encode(encoding, escape(role)), False), ([number[TEXT]], False)]
                segments += [(encode(encoding, body), role == "assistant"), ([number[END]], False)]
                a, b = assemble(segments)
                ids.append(a)
                loss.append(b)
                formatted.append(f"{head}{body}{END}\n")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8())), pa.array(formatted, pa.string())],
                names=["conv_id", "turn", "role", "ids", "loss", "formatted"],
            )

    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"))
    return chosen.mapInArrow(run, _TURN)


def read_turn(ids: np.ndarray, loss: np.ndarray, encoding, reserved: int) -> tuple[str, str, str]:
    """Role, text and text under the loss mask, from the ids alone."""
    marks = np.flatnonzero(ids >= reserved)
    text = lambda a, b: unescape(encoding.decode_bytes(ids[a:b].tolist()).decode())
    first = MARKS[ids[marks[0]] - reserved]
    if first == ROLE:
        role, begin = text(marks[0] + 1, marks[1]), marks[1] + 1
    else:
        role, begin = next(r for r, m in KNOWN.items() if m == first), marks[0] + 1
    under = np.flatnonzero(loss)
    learned = text(under[0], under[-1] + 1) if len(under) else ""
    return role, text(begin, marks[-1]), learned


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, learned: str, formatted: str) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(learned), self.chars + len(formatted)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """For each conversation its number of turns, the digests of turns and of the text under the mask, and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, reserved = _encoding(tokenizer)
        last: object = ()
        digest = _Digest()

        def row() -> pa.RecordBatch:
            got = [[last], [digest.n], [digest.turns.hexdigest()], [digest.loss_chars], [digest.loss.hexdigest()], [digest.chars]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            convs, ids, loss, texts = (batch.column(c) for c in ("conv_id", "ids", "loss", "formatted"))
            for k, conv in enumerate(convs.to_pylist()):
                if conv != last:
                    if last != ():
                        done.append(row())
                    last, digest = conv, _Digest()
                digest.add(*read_turn(ids[k].values.to_numpy(), loss[k].values.to_numpy(), encoding, reserved), texts[k].as_py())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if last != ():
            yield row()

    text = F.col("formatted")
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text)
    return ordered.select("conv_id", "ids", "loss", "formatted").mapInArrow(run, _DIGEST)


def round_trip(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Formats all turns, stores them in the shared folder and reads them back."""
    from tracewright.llm.storage import Scratch

    stored = Scratch(turns.sparkSession, "chat").keep(format_turns(turns, tokenizer), "turns")
    return read_back(stored, tokenizer)
