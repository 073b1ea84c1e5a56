"""Arrow batches in Python in bounded memory: a batch is read in slices, and results are handed on as they fill a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: rows that are Python objects at once, and characters of results that are handed on together
SLICE, CHARACTERS = 64, 1 << 20


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as tuples."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def gathered(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about CHARACTERS."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, str) else 8 for v in row)
        if size >= CHARACTERS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
