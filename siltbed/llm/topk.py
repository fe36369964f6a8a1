"""Exact top-k search by inner product with MaxScore.

Query components are terms, and a candidate's components its postings. In a shard (the rows a task reads) each term's
score bound is the most that it can add there. Terms are ordered by bound; those whose bounds together stay under the
current k-th score are non-essential. Essential postings are traversed for all rows of the shard; the others are probed,
a few at a time, only for rows that the bounds of what is left still allow to compete. Shards' lists are merged last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import cut

#: Queries broadcast at a time, and rows scored at a time.
QUERY_BLOCK, SHARD, FIRST, PROBE = 8192, 8192, 512, 8


def valid(vector: Column) -> Column:
    """No null, and no null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, rows of different lengths filled up with zeros."""
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Search:
    """The k best rows so far for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        #: Products of components that were computed, and those that a plain scan would take.
        self.computed = self.plain = 0

    def add(self, rows: np.ndarray, x: np.ndarray) -> None:
        width = max(x.shape[1], self.queries.shape[1])
        x, queries = _wide(x, width), _wide(self.queries, width)
        if len(x) == 0:
            return
        if np.abs(x).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1) >= 2**53:
            whole = np.vectorize(int, otypes=[object])  # beyond what doubles hold exactly
            x, queries = whole(x), whole(queries)
        hi, lo = x.max(0), x.min(0)
        columns = np.ascontiguousarray(x.T)
        for i, q in enumerate(queries):
            self._one(i, q, np.maximum(q * hi, q * lo), rows, columns)

    def _one(self, i: int, q: np.ndarray, bound: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        scores, ids = self.best[i]
        floor = scores[-1] if len(scores) == self.k else None
        order = np.argsort(-bound.astype(float), kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # left[n]: what the terms from n on can add
        if floor is None:
            n = len(order)
        else:  # essential: the fewest terms so that the others together stay under the k-th score
            n = max(int(np.argmax(left < floor)) if (left < floor).any() else len(order), min(PROBE, len(order)))
        at = order[:n]
        score, alive = q[at] @ columns[at], None
        self.computed += n * len(rows)
        self.plain += len(order) * len(rows)
        while True:
            if floor is not None:
                keep = np.flatnonzero(score + left[n] >= floor)
                alive, score = (keep if alive is None else alive[keep]), score[keep]
            if n == len(order) or len(score) == 0:
                break
            at = order[n : n + PROBE]
            score = score + (q[at] @ columns[at] if alive is None else q[at] @ columns[np.ix_(at, alive)])
            n += len(at)
            self.computed += len(at) * len(score)
        found = rows if alive is None else rows[alive]
        other = found != self.ids[i]
        score, found = np.concatenate([scores, score[other]]), np.concatenate([ids, found[other]])
        top = np.lexsort((found, -score.astype(float)))[: self.k] if score.dtype != object else sorted(range(len(score)), key=lambda j: (-score[j], found[j]))[: self.k]
        self.best[i] = score[top], found[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors by integer inner product, ties to the
    smaller id.

    Null vectors, null keys, and vectors with null or non-finite components take no part. Rows with a query's own key
    are not among its results; other repeated rows come back each. Query rows of one key are one query: their results are
    ranked together, and what several of them find comes back for each. Vectors of different lengths count as filled up
    with zeros. An empty table of either kind gives an empty result. Queries are broadcast in blocks of QUERY_BLOCK rows;
    each block takes one pass over the vectors, a task keeps k rows a query, and only those are shuffled. Blocks go one
    after another, so that the driver and the workers hold one block at a time.
    """
    clean = lambda d: d.where(F.col(key).isNotNull() & valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, parts, before = clean(vectors), [], None
    for block in _blocks(clean(queries), scale):
        if before is not None:
            parts.append(cut(_ranked(_pass(rows, *before, k, scale), k)))
        before = block
    last = _pass(rows, *before, k, scale) if before is not None else rows.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    for p in parts:
        last = last.unionByName(p.drop("rank"))
    return _ranked(last, k)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows: list = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            yield _block(rows, scale)
            rows = []
    if rows:
        yield _block(rows, scale)


def _block(rows: list, scale: float) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), scale)


def _pass(rows: DataFrame, ids: np.ndarray, block: np.ndarray, k: int, scale: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(*shared.value, k)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, FIRST if at == 0 else SHARD)
                s.add(part.column(0).to_numpy(), matrix(pa.concat_arrays([part.column(1)]), scale))
                at += part.num_rows
        for q, (scores, found) in zip(s.ids.tolist(), s.best, strict=True):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array([int(x) for x in scores], pa.int64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")
