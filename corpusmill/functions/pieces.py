"""Arrow functions that turn a few rows of a batch at a time into Python objects.

A batch has thousands of rows. All of them at once as Python strings, with the results of all beside them, take several times their
own size, in each of an executor's Python workers. Here a batch stays an Arrow array, one piece of it is objects, and a piece's
results leave the worker before the next piece is begun. Each function that a task applies has a worker of its own, so steps
on one text are one function wherever they can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

#: Bytes of text and rows that are Python objects at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 1_000


def pieces(columns: tuple[pa.Array, ...], limit: int = PIECE_BYTES, most: int = PIECE_ROWS) -> Iterator[list[list]]:
    """The columns' values, piece by piece; one piece of no rows if there are none."""
    size = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in columns))]
    start = total = 0
    for k, bytes_ in enumerate(size):
        if k > start and (total + bytes_ > limit or k - start >= most):
            yield [c.slice(start, k - start).to_pylist() for c in columns]
            start, total = k, 0
        total += bytes_
    yield [c.slice(start).to_pylist() for c in columns]


def by_pieces(kind: str, f: Callable[..., pa.Array], columns: int = 1):
    """A column function of type ``kind`` of string columns; ``f`` gets a list of each column's values and returns an array as long."""
    if columns == 1:

        @arrow_udf(kind)
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for values in pieces((batch,)):
                    yield f(*values)
                del batch  # before the next one is read

        return one

    @arrow_udf(kind)
    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for values in pieces(batch):
                yield f(*values)
            del batch

    return several


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def structs(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.Array:
    """Tuples as structs."""
    columns = zip(*rows) if rows else ((),) * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))
