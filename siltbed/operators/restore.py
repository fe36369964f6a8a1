"""Reassembly: ordered concatenation of slices with exact hole filling, and fetches of byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(locations: DataFrame, by: str = "path") -> DataFrame:
    """locations (start, length) with `gap`: the bytes between the end of the slice before, or 0, and its start."""
    w = Window.partitionBy(by).orderBy("start")
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(0))
    return locations.withColumn("gap", F.col("start") - before)


def reassemble(slices: DataFrame, by: str = "path") -> DataFrame:
    """(by, content) from (by, start, length, body), holes filled with zeros, bytes in the order of start.

    One object is one value: its slices meet in one task, in a single shuffle. Overlapping slices raise an error. Equal
    (start, body) rows count once; a slice is told from the one before it by places and digests, so no body is carried
    along. Bodies are put together as bytes, in one call over the sorted slices.
    """
    w = Window.partitionBy(by).orderBy("start", "length", "_d")
    placed = slices.select(by, "start", "length", "body", F.sha2("body", 256).alias("_d"))
    before = placed.withColumn("_p", F.lag(F.struct("start", "length", "_d")).over(w))
    again = (F.col("_p.start") == F.col("start")) & (F.col("_p._d") == F.col("_d"))
    gap = F.col("start") - F.coalesce(F.col("_p.start") + F.col("_p.length"), F.lit(0))
    filled = F.when(gap < 0, F.raise_error(F.lit("slices overlap")).cast("binary")).when(gap > 0, F.concat(F.repeat(F.lit("\0"), gap.cast("int")).cast("binary"), F.col("body"))).otherwise(F.col("body"))
    parts = before.where(~F.coalesce(again, F.lit(False))).select(by, "start", filled.alias("_b"))
    return parts.groupBy(by).agg(F.expr("listagg(_b) WITHIN GROUP (ORDER BY start)").alias("content"))


def range_fetch(slices: DataFrame, extents: DataFrame, by: str = "path") -> DataFrame:
    """Parts of slices inside [start, end] (inclusive) extents: (by, extent_no, start, length, body).

    A slice may begin before the extent or end after it; the part inside is cut out. Equi join on the object, with the
    range as its condition; extents are the small side."""
    e = extents.select(by, "extent_no", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = slices.join(e, by).where((F.col("start") <= F.col("_b")) & (F.col("start") + F.col("length") > F.col("_a")))
    a, b = F.greatest("start", "_a"), F.least(F.col("start") + F.col("length") - 1, F.col("_b"))
    body = F.substr("body", (a - F.col("start") + 1).cast("int"), (b - a + 1).cast("int"))
    return hit.select(by, "extent_no", a.alias("start"), (b - a + 1).alias("length"), body.alias("body"))


def sparse_sizes(extents: DataFrame, by: str = "path") -> DataFrame:
    """(by, total_length with holes, total_size without)."""
    return extents.groupBy(by).agg((F.max("end") + 1).alias("total_length"), F.sum(F.col("end") - F.col("start") + 1).alias("total_size"))


class ChunkNotFound(LookupError):
    pass


def fetch(locations: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """locations with the chunks' columns. An id without a chunk raises ChunkNotFound at once: an anti join over the two
    id columns, which reads no payload, comes first."""
    lost = locations.select(key).join(chunks.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise ChunkNotFound(f"no chunk {bytes(lost[0][0]).hex()}")
    return locations.join(chunks, key)
