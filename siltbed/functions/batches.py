"""Arrow batches in Python, worked on a piece at a time, so that a worker holds little besides the batch that Spark sends.

A batch has up to 10,000 rows and 64 MB. Lists of values, intermediate results and output are made for a megabyte of it at a
time; only a single value that is longer makes a piece longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of values, in or out, that make a piece.
PIECE = 1 << 20


def pieces(values: pa.Array, *others: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of binary columns, of PIECE bytes of the first at most, or of one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield tuple(x.slice(at, end - at) for x in (values, *others))
        at, done = end, int(ends[end - 1])


def arrays(values: Iterable[bytes | None]) -> Iterator[pa.Array]:
    """Values as binary arrays, each handed on once it has PIECE bytes."""
    held, size = [], 0
    for x in values:
        held.append(x)
        size += len(x or b"")
        if size >= PIECE:
            yield pa.array(held, pa.binary())
            held, size = [], 0
    if held:
        yield pa.array(held, pa.binary())


def each(f: Callable[..., Iterable[bytes]], values: pa.Array, *others: pa.Array) -> Iterator[pa.Array]:
    """f over the values that are not null, with those of the other columns, piece by piece; null for null."""
    for part in pieces(values, *others):
        known = part[0].is_valid()
        got = iter(f(*(x.filter(known).to_pylist() for x in part)))
        yield from arrays(next(got) if k else None for k in known.to_pylist())
