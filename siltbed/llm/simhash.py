"""SimHash near-dedup with pivot distance tables.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles. Two fingerprints link if they
differ in few bits. Each distinct fingerprint gets a row of Hamming distances to many reference fingerprints (pivots).
By the triangle inequality a linked pair's rows differ by no more than the radius in every coordinate; pairs with a
larger difference are discarded, and the exact distance of the survivors is checked.

Rows meet in groups that no linked pair can miss: the 64 bits are cut in blocks, and the bits in which a pair differs
lie in at most `radius` of them, so the pair agrees on all other blocks for some choice of those left out. A group's
members differ in the left-out blocks only, so it has a fixed bound (2^16 fingerprints for 8 blocks and radius 2) that
does not grow with the input, and a fingerprint has a fixed number of possible neighbours. Inside a group the first
coordinate of the table orders the members; only those within the radius of each other along it are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut, free_name, sliced

BLOCKS, PIVOTS = 8, 24
#: Reference fingerprints: zero, whose distance is the number of ones, and fixed random words.
REFERENCES = np.r_[np.zeros(1, np.uint64), np.random.default_rng(20).integers(0, 2**64, PIVOTS - 1, np.uint64)]
#: Shingles hashed at a time.
RUN = 1 << 14


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    w = raw.lower().split()  # A-Z, and [\x20\x09-\x0D]: both are ASCII-only for bytes
    if not w:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, RUN):
        part = w[at : at + RUN + words - 1] if n > 1 else w
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(part) >= words else [b" ".join(part)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _fp long) of each row: one narrow pass over whole texts. A null or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["k", "_fp"])

    pairs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return pairs.mapInArrow(run, pairs.select("k", F.lit(0).cast("long").alias("_fp")).schema).withColumnRenamed("k", key)


def group_keys(radius: int, blocks: int = BLOCKS) -> list[int]:
    """For each choice of `radius` blocks to leave out, the mask of the bits that stay."""
    width = 64 // blocks
    part = [((1 << width) - 1) << (width * i) for i in range(blocks)]
    return [(2**64 - 1) & ~sum(part[i] for i in out) for out in combinations(range(blocks), radius)]


def table_of(fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: one row of distances a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :])


def linked(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of the same group. Members are ordered by (group, first coordinate)."""
    table = table_of(fps)
    first = table[:, 0].astype(np.int16)
    at, lag, found = np.arange(len(fps) - 1), 1, []
    while len(at):
        other = at + lag
        near = (group[at] == group[other]) & (first[other] - first[at] <= radius)
        at, other = at[near], other[near]  # beyond the first that is too far, all are
        if len(at):
            keep = np.ones(len(at), bool)
            for c in range(1, PIVOTS, 4):  # discard by the maximum coordinate difference, a few coordinates at a time
                now = np.flatnonzero(keep)
                diff = np.abs(table[at[now], c : c + 4].astype(np.int8) - table[other[now], c : c + 4].astype(np.int8))
                keep[now[diff.max(1) > radius]] = False
            now = np.flatnonzero(keep)
            true = now[np.bitwise_count(fps[at[now]] ^ fps[other[now]]) <= radius]
            found.append((at[true], other[true]))
        lag += 1
        at = at[at + lag < len(fps)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints (column _fp) that differ in at most radius bits; may repeat."""
    masks = np.array(group_keys(radius), np.uint64).view(np.int64).tolist()
    group = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), lambda i: F.struct(i.alias("i"), F.element_at(F.array(*map(F.lit, masks)), i + 1).alias("m"))))
    rows = distinct.select("_fp", group.alias("g")).select(F.xxhash64("g.i", F.col("_fp").bitwiseAND(F.col("g.m"))).alias("g"), F.bit_count("_fp").alias("t"), "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 2), np.int64)
        for batch in batches:
            new = np.stack([batch.column(0).to_numpy(), batch.column(2).to_numpy()], 1)
            rest = np.concatenate([rest, new])
            # the last group may go on in the next batch; so do its members, and no others
            cut_at = int(np.searchsorted(rest[:, 0], rest[-1, 0])) if len(rest) else 0
            if cut_at:
                yield emit(rest[:cut_at])
                rest = rest[cut_at:]
        if len(rest):
            yield emit(rest)

    def emit(part: np.ndarray) -> pa.RecordBatch:
        group, fps = part[:, 0], part[:, 1].copy().view(np.uint64)
        pair = np.flatnonzero(group[1:] == group[:-1])
        member = np.zeros(len(group), bool)
        member[pair] = member[pair + 1] = True
        a, b = linked(group[member], fps[member], radius)
        x, y = fps[member].view(np.int64)[a], fps[member].view(np.int64)[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", "t").mapInArrow(run, "a long, b long").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes of edges (a, b).

    Each round follows every label once more, and the least label found at a node's neighbours goes to the node and to the
    node that its label names (FastSV): whole trees are hooked to smaller ones, so that the rounds grow about as the
    logarithm of the longest path. Labels only fall and stay in their component, so the rounds end; when none changes,
    neighbours have the same label and it is the least. Labels live in the shared checkpoint folder; a node's neighbours are
    few (see above), and the joins on labels have their many rows on the side that adaptive execution splits.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("root")))
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        far = cut(labels.join(up, "root").select("node", "root", "far"))
        near = both.join(far, both.b == far.node).groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        own = F.struct("node", F.col("root").alias("old"), F.least("far", "near").alias("root"))
        hooked = F.struct(F.col("root").alias("node"), F.lit(None).cast(edges.schema["a"].dataType).alias("old"), F.col("near").alias("root"))
        moved = far.join(near, "node").select(F.explode(F.array(own, hooked)).alias("m")).select("m.*")
        moved = cut(moved.groupBy("node").agg(F.max("old").alias("old"), F.min("root").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): 16 hex digits, and the least key that is reachable over links, own included.

    Equal fingerprints meet in one representative before any pair is formed, so large groups of copies cost one count.
    A null or wordless text has fingerprint zero and links like any other. Rows with a null key take part in links but
    name no component: component_id is null if all keys of a component are null. Repeated rows come back each. An empty
    table gives an empty result.
    """
    fps = cut(fingerprints(docs, words, key, text))
    distinct = cut(fps.groupBy("_fp").agg(F.min(key).alias("_least")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct._fp == roots.node, "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of = cut(rooted.join(least, "_root").select("_fp", "component_id"))
    return fps.join(of, "_fp").select(key, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the document with the least key stays. Rows with a null key can't
    be told from each other and stay. Repeated rows of the least key come back each."""
    found = near_duplicates(docs, words, radius, key, text)
    name = free_name(docs, "_gone")
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(name)).distinct()
    return docs.join(cut(gone), docs[key] == F.col(name), "left_anti")
