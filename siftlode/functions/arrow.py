"""Arrow batches by groups of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from .ship import ship

ship(__name__)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows that agree in ``keys``; such rows stand together."""
    rest: list[pa.Table] = []
    key = None
    for b in batches:
        t = pa.Table.from_batches([b])
        start = 0
        for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in keys), strict=True)):
            if k != key:
                if i > start:
                    rest.append(t.slice(start, i - start))
                if rest:
                    yield pa.concat_tables(rest)
                rest, key, start = [], k, i
        if b.num_rows > start:
            rest.append(t.slice(start))
    if rest:
        yield pa.concat_tables(rest)
