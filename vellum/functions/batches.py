"""Batches of Arrow in parts of bounded bytes, so that the memory of a function follows the part and not the rows that Spark sends at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20


def parts(columns: list[pa.Array], most: int = PART_BYTES, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of stretches whose strings or bytes in columns are together at most so many, or one row; and at most so many rows."""
    n = len(columns[0]) if columns else 0
    sizes = [pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
    at, held = 0, 0
    for i in range(n):
        size = sum(int(s[i]) for s in sizes)
        if i > at and (held + size > most or i - at >= rows):
            yield at, i - at
            at, held = i, 0
        held += size
    if n:
        yield at, n - at
