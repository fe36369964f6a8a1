"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words, all of one length for each search. A table gives, for every block of up to three
words that occurs in a pattern, how far the block's last occurrence is from the pattern's end; a position whose block is
in no pattern is skipped by the whole window less the block. Where the distance is zero, the block leads to the bucket of
the patterns that end in it; a hash of the words before the block (the prefix table) picks those of a large bucket that
may match, and comparing all their words with the text confirms an occurrence. Patterns are places in the benchmark's
list of words, not copies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import free_name

#: UTF-8 bytes of benchmark texts whose patterns are broadcast together, and so the bound of what a worker holds of the
#: benchmark (some 170,000 windows and 60 MB for each megabyte). Of a larger benchmark a worker holds one such block at a
#: time, for each slab of documents in turn; all blocks are searched in one stage.
BLOCK_BYTES = 1 << 20
#: UTF-8 bytes of documents whose words are held at once.
SLAB_BYTES = 1 << 22

#: A-Z are lower-cased, other ASCII than letters and digits parts words, all else belongs to words.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Search for patterns (runs of `length` words) with their items."""

    def __init__(self, length: int):
        self.length, self.block = length, min(3, length)
        self.skip = length - self.block + 1
        self.words: list[bytes] = []  # of all items, one after another
        self.starts, self.items = [], []  # where the words of each item start
        self.shift: dict[tuple, int] = {}
        # by the last block: the place of the only pattern, or places by the hash of what is before the block
        self.bucket: dict[tuple, int | dict[int, list[int]]] = {}
        self.repeats: dict[int, list] = {}  # further items of the pattern at a place

    def _prefix(self, words: list[bytes], at: int) -> int:
        return xxhash.xxh64_intdigest(b" ".join(words[at : at + self.length - self.block]))

    def candidates(self, last: tuple, words: list[bytes], at: int) -> list[int]:
        """Places of the patterns of a bucket that may be words[at : at + length]."""
        found = self.bucket.get(last, {})
        return [found] if isinstance(found, int) else found.get(self._prefix(words, at), []) if found else []

    def add(self, words: list[bytes], item: object, known: dict[bytes, bytes]) -> None:
        """All windows of an item. known: one object for each distinct word."""
        base, all_words, n, block = len(self.words), self.words, self.length, self.block
        all_words += [known.setdefault(w, w) for w in words]
        self.starts.append(base)
        self.items.append(item)
        for at in range(base, len(all_words) - n + 1):
            last = tuple(all_words[at + n - block : at + n])
            same = next((c for c in self.candidates(last, all_words, at) if all_words[c : c + n] == all_words[at : at + n]), None)
            if same is not None:
                self.repeats.setdefault(same, []).append(item)
                continue
            for end in range(block, n + 1):
                b = tuple(all_words[at + end - block : at + end])
                self.shift[b] = min(self.shift.get(b, self.skip), n - end)
            found = self.bucket.setdefault(last, at)
            if found != at:
                if isinstance(found, int):
                    found = self.bucket[last] = {self._prefix(all_words, found): [found]}
                found.setdefault(self._prefix(all_words, at), []).append(at)

    def search(self, words: list[bytes], hit: list[tuple[int, int]], items: set) -> None:
        """Adds the word ranges of occurrences, by start, and the items that occur."""
        n, block, length, skip, shift, patterns = len(words), self.block, self.length, self.skip, self.shift.get, self.words
        i = length  # end of the window
        while i <= n:
            last = tuple(words[i - block : i])
            s = shift(last, skip)
            if s:
                i += s
                continue
            window = words[i - length : i]
            for c in self.candidates(last, words, i - length):
                if patterns[c : c + length] == window:
                    hit.append((i - length, i))
                    items.add(self.items[bisect_right(self.starts, c) - 1])
                    items.update(self.repeats.get(c, ()))
            i += 1


class Matcher:
    def __init__(self, benchmark: list[tuple[object, bytes | None]], window: int):
        self.passes: dict[int, WuManber] = {}
        known: dict[bytes, bytes] = {}
        for item, text in benchmark:
            w = words_of(text)
            n = min(window, len(w))
            if n:
                self.passes.setdefault(n, WuManber(n)).add(w, item, known)

    def collect(self, words: list[bytes], hit: list[tuple[int, int]], items: set) -> None:
        for p in self.passes.values():
            p.search(words, hit, items)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint word ranges that occurrences cover, in order, and the items that occur."""
        hit: list[tuple[int, int]] = []
        items: set = set()
        self.collect(words, hit, items)
        return union(hit), items


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[object, bytes | None]]]:
    rows, size = [], 0
    for i, t in benchmark.select(item, F.col(text).cast("binary")).toLocalIterator():
        rows.append((i, None if t is None else bytes(t)))
        size += len(t or b"")
        if size > limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (long), hit_spans (disjoint ranges of word numbers, end exclusive), items (sorted array
    of strings), n_items (long) and contaminated (boolean: n_hit > 0 and share * n_hit >= n_words).

    Narrow: whole texts pass through one Python stage, however large the benchmark; nothing is shuffled. Null texts
    have no words and are clean. Benchmark rows without words match nothing; items with a null id hit words but are not
    listed; repeated items count once. An empty benchmark leaves all documents clean. Other columns and repeated rows
    pass through; on a clash the new names get underscores in front.
    """
    names = {c: free_name(docs, c) for c in ("n_words", "n_hit", "hit_spans", "items", "n_items", "contaminated")}
    shared = []
    for part in blocks(benchmark, item, item_text, block_bytes):
        shared.append(docs.sparkSession.sparkContext.broadcast(Matcher(part, window)))
        _forget(shared[-1])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, at):
            words = [words_of(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(at)]
            found: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in words]
            for b in shared:
                matcher = b.value
                for w, (hit, items) in zip(words, found, strict=True):
                    matcher.collect(w, hit, items)
                if len(shared) > 1:
                    del matcher
                    _forget(b)
            spans = [[{"start": x, "end": y} for x, y in union(hit)] for hit, _ in found]
            items = [sorted({str(x) for x in items if x is not None}) for _, items in found]
            new = [pa.array(map(len, words), pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, names["n_words"], names["hit_spans"], names["items"]])

    schema = docs.select("*", F.lit(0).cast("long").alias(names["n_words"]), F.array().cast("array<struct<start:long,end:long>>").alias(names["hit_spans"]), F.array().cast("array<string>").alias(names["items"])).schema
    out = docs.mapInArrow(run, schema)
    n_hit = F.aggregate(names["hit_spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.withColumns({names["n_hit"]: n_hit, names["items"]: F.array_sort(names["items"]), names["n_items"]: F.size(names["items"]).cast("long")})
    return out.withColumn(names["contaminated"], (F.col(names["n_hit"]) > 0) & (share * F.col(names["n_hit"]) >= F.col(names["n_words"])))


def _forget(shared: Broadcast) -> None:
    """Lets go of this process's copy of a broadcast value; the next use reads it again from the local file."""
    vars(shared).pop("_value", None)


def slabs(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows, so that the texts of a batch have about SLAB_BYTES, or one text has more."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size.astype(np.int64)) + 256 * np.arange(len(size))) // SLAB_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in pairwise(edges):
            if b > a:
                yield batch.slice(a, b - a)
