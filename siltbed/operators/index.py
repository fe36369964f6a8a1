"""The chunk index as a view over an append-only transaction log, and the packing of chunks into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("tx_file", "tx_seq"), policy: str = "last") -> DataFrame:
    """One row a key: the last (or the first) record in log order. max_by keeps partial results on the map side, so a
    key with many records costs one row a task."""
    if policy not in ("last", "first"):
        raise ValueError(f"policy is last or first, not {policy!r}")
    pick = F.max_by if policy == "last" else F.min_by
    rest = [c for c in log.columns if c != key]
    got = log.groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(key, "_r.*")


def lookup(index: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return keys.join(index, key, "inner")


class HeaderNotFound(LookupError):
    pass


def with_headers(locations: DataFrame, headers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """locations with the columns of their headers. A location whose header is missing raises HeaderNotFound at once: an anti
    join over the keys comes first."""
    lost = locations.select(key).join(headers.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise HeaderNotFound(f"no header for {lost[0][0]!r}")
    return locations.join(headers, key)


def described(descriptors: DataFrame, lengths: DataFrame, headers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What a flat file says of its chunks: descriptors with their lengths and headers, all by key. A descriptor without a
    length is left out, as after an interrupted write; one without a header raises HeaderNotFound."""
    return with_headers(descriptors.join(lengths, key), headers, key)


def next_id(log: DataFrame, column: str = "segment_id") -> DataFrame:
    """One more than the greatest id, 0 for an empty log."""
    return log.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_id"))


def numeric_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Files whose names are whole numbers."""
    return files.where(F.col(name).rlike("^[0-9]+$"))


def pack_segments(chunks: DataFrame, limit: int, order: str, size: str = "length") -> DataFrame:
    """chunks with segment_id (bytes before the chunk, over the limit) and slot (its place in the segment).

    Running sums over the whole input go in two levels: rows are dealt by approximate quantiles of `order` (a unique
    number), each part is summed by itself, and the parts' totals, one row each, give the offsets. No task gets all rows,
    and a row's part is a function of its value, so tasks that run again agree.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(chunks.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(order))) if bounds else F.lit(0)
    dealt = chunks.withColumn("_p", part)
    within = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_b", F.coalesce(F.sum(size).over(within), F.lit(0)))
    totals = dealt.groupBy("_p").agg(F.sum(size).alias("_t"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    placed = dealt.join(F.broadcast(offsets), "_p").withColumn("segment_id", F.floor((F.col("_b") + F.col("_o")) / limit).cast("long"))
    slot = Window.partitionBy("segment_id").orderBy(order)
    return placed.withColumn("slot", (F.row_number().over(slot) - 1).cast("long")).drop("_p", "_b", "_o")
