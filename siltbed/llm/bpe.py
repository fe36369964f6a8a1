"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves down to leaves, which are encoded by themselves; neighbours are joined by encoding anew a window
around the seam, which grows until what lies outside is proved stable. Two levels use the same scheme:

* text. The window grows on either side to a place where a white-space character follows another character. No match of
  the pre-tokeniser's pattern spans such a place or looks across it, so it bounds a match in any text, and the tokens
  beyond it are those of the whole text.
* one long match. A sequence of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs;
  the window grows until the pairs at both its edges pass that test.

Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import free_name, sliced

#: Characters of a text leaf and bytes of a leaf of one long match: small, so that ordinary documents are joined from many.
TEXT_LEAF, PIECE_LEAF = 256, 64
#: A place that bounds a match is after the first character of this.
SEAM, SEAM_BEFORE = regex.compile(r"[!-~\w][ \n]"), regex.compile(r"(?r)[!-~\w][ \n]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Distinct matches, and distinct pairs of tokens, that a worker remembers; characters whose matches it holds at once.
REMEMBERED, SLAB = 1 << 17, 1 << 20


class Pairs:
    """Which pairs of tokens merge, and to what: merges many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values(), default=-1) + 1
        self.base = self.none + 1
        splits = ((ranks.get(raw[:i]), ranks.get(raw[i:]), to) for raw, to in ranks.items() for i in range(1, len(raw)))
        known = np.array([(a * self.base + b, to) for a, b, to in splits if a is not None and b is not None], np.int64).reshape(-1, 2)
        self.keys, self.to = known[:, 0], np.append(known[:, 1], self.none)
        self.single = np.array([ranks.get(bytes([i]), self.none) for i in range(256)], np.int64)

    @cached_property
    def index(self) -> pd.Index:
        return pd.Index(self.keys)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.to[self.index.get_indexer((a * self.base + b).ravel())].reshape(a.shape)

    def merge(self, raws: list[bytes]) -> list[list[int]]:
        """For each the tokens left when the pair of the least rank, the leftmost of ties, has been merged until there is
        none. All rows of about a length take their steps together."""
        out: list[list[int]] = [[]] * len(raws)
        length = np.array([len(r) for r in raws], np.int64)
        for least, most in pairwise((0, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64, max(65, int(length.max(initial=0))))):
            if len(rows := np.flatnonzero((length > least) & (length <= most))):
                for i, ids in zip(rows.tolist(), self._steps([raws[i] for i in rows], length[rows], most), strict=True):
                    out[i] = ids
        return out

    def _steps(self, raws: list[bytes], length: np.ndarray, width: int) -> list[list[int]]:
        """Parts stay where they begin; each knows the next and the one before, by places in flat arrays."""
        n, wide = len(raws), width + 1  # a row ends with a place that no part has
        ids = self.single[np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raws), np.uint8)]
        column = np.tile(np.arange(wide), n)
        alive = column < np.repeat(length, wide)
        pair = np.append(self.rank(ids[:-1], ids[1:]), self.none)
        pair[column + 1 >= np.repeat(length, wide)] = self.none
        after, before = np.arange(1, n * wide + 1), np.where(column > 0, np.arange(-1, n * wide - 1), -1)
        first = np.arange(n) * wide
        while len(first):
            at = first + pair.reshape(n, wide)[first // wide].argmin(1)
            to = pair[at]
            go = to < self.none
            first, at, to = first[go], at[go], to[go]
            gone = after[at]
            right = after[gone]
            ids[at], pair[gone], alive[gone], after[at], before[right] = to, self.none, False, right, at
            pair[at] = np.where(alive[right], self.rank(to, ids[right]), self.none)
            left = before[at]
            some = left >= 0
            left = left[some]
            pair[left] = self.rank(ids[left], to[some])
        flat, ends = ids[alive].tolist(), np.cumsum(alive.reshape(n, wide).sum(1)).tolist()
        return [flat[a:b] for a, b in pairwise([0, *ends])]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF, pairs: Pairs | None = None):
        """pattern: no match may have white space after another character, as in the public byte-level tokenisers."""
        self.pairs, self.known = pairs or Pairs(ranks), {}
        self.ranks, self.pattern, self.text_leaf, self.piece_leaf = ranks, regex.compile(pattern), text_leaf, piece_leaf
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.stable = lru_cache(REMEMBERED)(self._stable)

    # tokens of one piece

    def merge(self, raw: bytes) -> list[int]:
        """Leaf: merge the pair of the least rank, the leftmost of ties, until none is left."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) > self.piece_leaf:
            return self._merge_long(raw)
        rank, none = ranks.get, len(self.bytes_of)
        at = list(range(len(raw) + 1))  # starts of the parts, and the end
        pairs = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(raw[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = rank(raw[at[i - 1] : at[i + 1]], none)
        return [ranks[raw[i:j]] for i, j in pairwise(at)]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same for the windows of long matches: pairs wait in a heap and parts form a linked list, so that n bytes take
        about n log n steps."""
        ranks, n = self.ranks, len(raw)
        end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, until = heapq.heappop(waiting)
            j = after[i] if end[i] else n  # end 0: the part has been merged into one before it
            if j == n or end[j] != until:
                continue  # this pair is no more
            end[i], end[j], after[i] = until, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := ranks.get(raw[left : end[right]])) is not None:
                    heapq.heappush(waiting, (r, left, end[right]))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        """Whether the tokens a and b are the encoding of their bytes."""
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side in the window
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.merge(b"".join(map(self.bytes_of.__getitem__, [*left[-i:], *right[:j]])))
            fits_left = i == len(left) or self.stable(left[-i - 1], middle[0])
            fits_right = j == len(right) or self.stable(middle[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + middle + right[j:]
            i, j = (i if fits_left else 2 * i), (j if fits_right else 2 * j)

    def encode_piece(self, raw: bytes) -> list[int]:
        if len(raw) <= self.piece_leaf:
            return self.merge(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1  # seams at multiples of powers of two, where runs of one token part too
        return self.join_tokens(self.encode_piece(raw[:half]), self.encode_piece(raw[half:]))

    # a text

    def matches(self, pieces: list[str]) -> list[int]:
        """Ids of matches of the pattern."""
        try:
            return [*chain.from_iterable(map(self.known.__getitem__, pieces))]
        except KeyError:  # a long one
            known = self.known.get
            return [i for p in pieces for i in known(p) or self.encode_piece(p.encode("utf-8", "replace"))]

    def learn(self, plans: list) -> None:
        """Merges the leaves among the matches of plans that are not known yet, all at once."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new, waiting = set(), list(plans)
        while waiting:
            p = waiting.pop()
            if isinstance(p, list):
                new.update(p)
            else:
                waiting += p[:3]
        raws = [(p, raw) for p in new.difference(self.known) if len(raw := p.encode("utf-8", "replace")) <= self.piece_leaf]
        self.known.update({p: [self.ranks[raw]] for p, raw in raws if raw in self.ranks})
        raws = [x for x in raws if x[1] not in self.ranks]
        self.known.update(zip((p for p, _ in raws), self.pairs.merge([raw for _, raw in raws]), strict=True))

    def window(self, text: str, start: int, half: int, end: int) -> tuple[int, int]:
        """The nearest places on both sides of half that bound a match in any text."""
        left, right = SEAM_BEFORE.search(text, start, min(half + 1, end)), SEAM.search(text, max(start, half - 1), end)
        return left.start() + 1 if left else start, right.start() + 1 if right else end

    def tokens_of(self, ids: list[int], size: int, backwards: bool) -> int:
        """How many ids at the start, or at the end, make up size bytes."""
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[-n - 1 if backwards else n]])
            n += 1
        assert size == 0, "the seam does not bound a token"
        return n

    def plan(self, text: str, start: int, end: int):
        """The tree over text[start:end]. A leaf is its matches; a node is its halves, the matches in the window around its
        seam, and the bytes of the window on either side."""
        if end - start <= self.text_leaf:
            return self.pattern.findall(text, start, end)
        half = (start + end) // 2
        left, right = self.window(text, start, half, end)
        size = lambda a, b: len(text[a:b].encode("utf-8", "replace"))
        return self.plan(text, start, half), self.plan(text, half, end), self.pattern.findall(text, left, right), size(left, half), size(half, right)

    def join(self, a: list[int], b: list[int], seam: list[str], before: int, after: int) -> list[int]:
        """The window's tokens take the place of those of the halves that it covers."""
        i, j = self.tokens_of(a, before, True), self.tokens_of(b, after, False)
        return a[: len(a) - i] + self.matches(seam) + b[j:]

    def reduced(self, plan) -> list[int]:
        return self.matches(plan) if isinstance(plan, list) else self.join(self.reduced(plan[0]), self.reduced(plan[1]), *plan[2:])

    def encode(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """Ids of the whole text, or of text[start:end]. Matches of a slab at most are held at once."""
        end = len(text) if end is None else end
        if end - start <= max(SLAB, self.text_leaf):
            plan = self.plan(text, start, end)
            self.learn([plan])
            return self.reduced(plan)
        half = (start + end) // 2
        left, right = self.window(text, start, half, end)
        a, b = self.encode(text, start, half), self.encode(text, half, end)
        return self.join(a, b, self.pattern.findall(text, left, right), len(text[left:half].encode("utf-8", "replace")), len(text[half:right].encode("utf-8", "replace")))

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; new matches of many short texts are merged together."""
        group, held = [], 0
        for at, text in enumerate(texts):
            group.append(text)
            held += len(text)
            if held < SLAB and at + 1 < len(texts):
                continue
            plans = [self.plan(t, 0, len(t)) if len(t) <= SLAB else None for t in group]
            self.learn([p for p in plans if p is not None])
            for t, p in zip(group, plans, strict=True):
                yield self.encode(t) if p is None else self.reduced(p)
            group, held = [], 0

    def decode(self, ids: list[int], leaf: int = 1 << 12) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with `ids`, an array of token ids of the whole text; with digest also `decoded_sha256`, the lowercase hex
    SHA-256 of the bytes that the ids decode to.

    One narrow pass, no shuffle; a worker holds one batch of texts and their ids. A null text counts as
    empty and gets no ids. Other columns, nulls and repeated rows pass through; if docs has a column of a new one's name,
    the new one gets underscores in front. The vocabulary is a fixed table of the tokeniser, broadcast to the executors.
    """
    shared, name, at = docs.sparkSession.sparkContext.broadcast((ranks, Pairs(ranks))), free_name(docs, "ids"), docs.columns.index(text)
    more = [free_name(docs, "decoded_sha256")] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], pattern, pairs=shared.value[1])
        for part in sliced(batches):
            got = list(codec.encode_many([t or "" for t in part.column(at).to_pylist()]))
            flat = np.concatenate([np.array(g, np.int32) for g in got])
            offsets = np.cumsum([0] + [len(g) for g in got]).astype(np.int32)
            decoded = [pa.array([hashlib.sha256(codec.decode(g)).hexdigest() for g in got], pa.string()) for _ in more]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), *decoded], [*part.schema.names, name, *more])

    return docs.mapInArrow(run, docs.select("*", F.array(F.lit(0)).alias(name), *[F.lit("").alias(m) for m in more]).schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes that its column of token ids stands for. A null list decodes to no bytes; an
    id outside the vocabulary raises IndexError. Other columns, nulls and repeated rows pass through."""
    shared, name, at = encoded.sparkSession.sparkContext.broadcast((ranks, Pairs({}))), free_name(encoded, "decoded"), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], pattern, pairs=shared.value[1])
        for part in sliced(batches):
            got = [codec.decode(x.values.to_pylist()) if x.is_valid else b"" for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, name])

    return encoded.mapInArrow(run, encoded.select("*", F.lit(b"").alias(name)).schema)


def ids_digest(ids) -> str:
    """Lowercase hex SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids, and digests both."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, Pairs(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], pattern, pairs=shared.value[1])
        for batch in sliced(batches):
            n, a, b = [], [], []
            for ids in codec.encode_many([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(ids_digest(ids))
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    pairs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = pairs.select("k", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return pairs.mapInArrow(run, schema).withColumnRenamed("k", key)
