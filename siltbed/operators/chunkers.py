"""Chunkers: one byte string to many slices.

Each chunker keeps five properties: an input that is not empty gives one slice or more; slices joined are the input; the
same input gives the same slices; no slice is longer than the maximum; only the last may be shorter than the minimum.
Empty input gives no slice. `StaticSize` is built-in expressions only. The rolling-hash chunkers find candidate cuts for
all positions at once with numpy, since their hashes depend on a window of bytes and not on earlier cuts, and only choose
among the candidates one after another.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def rotate_left(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, U64) & U64(63)
    return (x << n) | (x >> ((U64(64) - n) & U64(63)))


def derived_table(nonce: int) -> np.ndarray:
    """256 words: the first eight bytes, big-endian, of HMAC-SHA256(nonce, byte)."""
    key = (nonce % (1 << 64)).to_bytes(8, "little")
    return np.array([int.from_bytes(hmac.digest(key, bytes([i]), "sha256")[:8], "big") for i in range(256)], U64)


def choose(size: int, least: int, most: int, candidates: np.ndarray, early: np.ndarray | None = None, middle: int = 0) -> list[int]:
    """Ends (exclusive) of slices: the first candidate from `least` bytes on, else `most` bytes, else the end of input.
    With `early`, only those candidates count up to `middle` bytes."""
    ends, at = [], 0
    while at < size:
        end = None
        if early is not None:
            i = np.searchsorted(early, at + least)
            if i < len(early) and early[i] < at + middle:
                end = int(early[i])
            i = np.searchsorted(candidates, at + max(least, middle))
        else:
            i = np.searchsorted(candidates, at + least)
        if end is None:
            end = int(candidates[i]) if i < len(candidates) and candidates[i] <= at + most else at + most
        at = min(end, size)
        ends.append(at)
    return ends


@dataclass(frozen=True)
class StaticSize:
    """Slices of one length; the last may be shorter."""

    length: int = 65_536

    def slices(self, content: Column) -> Column:
        """array<struct<ordinal, start, length, body>> of a binary column; empty for empty or null input."""
        size = F.octet_length(content)
        starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / self.length).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            i.alias("ordinal"), (i.cast("long") * self.length).alias("start"),
            F.octet_length(F.substr(content, i * self.length + 1, F.lit(self.length))).cast("long").alias("length"),
            F.substr(content, i * self.length + 1, F.lit(self.length)).alias("body"),
        ))

    def cuts(self, raw: bytes) -> list[int]:
        return [min(len(raw), i + self.length) for i in range(0, len(raw), self.length)]


@dataclass(frozen=True)
class BuzHash:
    """Cyclic polynomial hash of a window; the nonce keys its table."""

    nonce: int
    window: int = 4095
    mask_bits: int = 21
    table: np.ndarray | None = field(default=None, compare=False)

    @cached_property
    def words(self) -> np.ndarray:
        return derived_table(self.nonce) if self.table is None else self.table

    @property
    def least(self) -> int:
        return 1 << (self.mask_bits - 2)

    @property
    def most(self) -> int:
        return 1 << (self.mask_bits + 2)

    def hashes(self, raw: bytes) -> np.ndarray:
        """H[i] = rotl(Q[i] ^ Q[i - window], i), where Q[i] is the XOR of rotr(T[b[j]], j) over j <= i."""
        i = np.arange(len(raw), dtype=U64)
        q = np.bitwise_xor.accumulate(rotate_left(self.words[np.frombuffer(raw, np.uint8)], U64(64) - (i & U64(63))))
        q[self.window :] ^= q[: -self.window].copy() if len(raw) > self.window else U64(0)
        return rotate_left(q, i)

    def candidates(self, raw: bytes) -> np.ndarray:
        """Ends (exclusive) at which the hash's low bits are zero."""
        return np.flatnonzero(self.hashes(raw) & U64((1 << self.mask_bits) - 1) == 0) + 1 if raw else np.zeros(0, int)

    def cuts(self, raw: bytes) -> list[int]:
        return choose(len(raw), self.least, self.most, self.candidates(raw))


@dataclass(frozen=True)
class FastCDC:
    """Gear hash with normalised chunking: more bits must be zero before the average length, fewer after it."""

    least: int = 32_768
    average: int = 65_536
    most: int = 131_072

    @cached_property
    def words(self) -> np.ndarray:
        return derived_table(0x5117BED)

    def hashes(self, raw: bytes) -> np.ndarray:
        """h = (h << 1) + G[b], of which 64 bytes matter: six doublings of the window."""
        h = self.words[np.frombuffer(raw, np.uint8)].copy()
        for k in range(6):
            w = 1 << k
            h[w:] += h[:-w].copy() << U64(w) if len(h) > w else U64(0)
        return h

    def cuts(self, raw: bytes) -> list[int]:
        if not raw:
            return []
        h, bits = self.hashes(raw), max(1, self.average.bit_length() - 1)
        strict, loose = (U64(((1 << min(b, 63)) - 1) << (64 - min(b, 63))) for b in (bits + 1, max(1, bits - 1)))
        return choose(len(raw), self.least, self.most, np.flatnonzero(h & loose == 0) + 1, np.flatnonzero(h & strict == 0) + 1, self.average)


def chunk(objects: DataFrame, chunker: StaticSize | BuzHash | FastCDC, content: str = "content") -> DataFrame:
    """objects, without the content, with one row (ordinal int, start, length long, body binary) a slice.

    Narrow: no shuffle. Objects with null or empty content give no rows. All other columns are repeated for each slice.
    """
    others = [c for c in objects.columns if c != content]
    if isinstance(chunker, StaticSize):
        return objects.select(*others, F.inline(chunker.slices(F.col(content))))
    at = objects.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(at)[i].as_py()
                if not raw:
                    continue
                ends = chunker.cuts(raw)
                starts = [0, *ends[:-1]]
                row = batch.slice(i, 1).take(pa.array([0] * len(ends)))
                columns = [row.column(j) for j in range(row.num_columns) if j != at]
                yield pa.RecordBatch.from_arrays([
                    *columns, pa.array(range(len(ends)), pa.int32()), pa.array(starts, pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ], [*others, "ordinal", "start", "length", "body"])

    schema = objects.select(*others, F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("body")).schema
    return objects.mapInArrow(run, schema)
