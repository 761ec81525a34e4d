"""Ordered folds: rules whose effect on a row depends on all rows of its key before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """The state of one key. Both methods give rows of the result without the key."""

    def step(self, row: dict) -> list[tuple]:
        """What the next row of the key does."""

    def end(self) -> list[tuple]:
        """What is left when the key's rows have ended."""


def _values(column: pa.Array) -> list:
    """The column's values as to_pylist gives them; lists and texts without an object of Arrow's for each value."""
    kind = column.type
    if pa.types.is_list(kind):
        flat, ends = _values(column.flatten()), column.value_lengths().fill_null(0).to_numpy().cumsum().tolist()
        lists = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return lists if not column.null_count else [x if v else None for x, v in zip(lists, column.is_valid().to_pylist(), strict=True)]
    if pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def ordered_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Fold], schema: str, unread: Sequence[str] = ()) -> DataFrame:
    """Folds the rows of each key in the order, which should be total; schema: the columns after the keys; unread: columns
    of the order that the fold doesn't look at.

    Rows are dealt by key, sorted by Spark (which spills) and streamed: a task holds one batch and one key's state, however
    many rows the key has. The same rows give the same result on a retry.
    """
    kinds = StructType([rows.schema[k] for k in keys])
    for field in StructType.fromDDL(schema):
        kinds = kinds.add(field)
    arrow, n, names = to_arrow_schema(kinds), len(keys), [c for c in rows.columns if c not in unread]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out = None, None, []

        def send() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for values in zip(*map(_values, batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                mine = tuple(row[k] for k in keys)
                if fold is None or mine != key:
                    if fold is not None:
                        out.extend((*key, *x) for x in fold.end())
                    key, fold = mine, start()
                out.extend((*key, *x) for x in fold.step(row))
            if len(out) >= 4096:
                yield send()
                out.clear()
        if fold is not None:
            out.extend((*key, *x) for x in fold.end())
        yield send()

    assert arrow.names[:n] == list(keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names).mapInArrow(run, kinds)
