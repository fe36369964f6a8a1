"""Content-addressed deduplication: what is new, what is known, and how much is saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(slices: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row a key."""
    return slices.dropDuplicates([key])


def new_chunks(slices: DataFrame, index: DataFrame, key: str = "chunk_id", always: object = None) -> DataFrame:
    """One row for each key that the index does not hold. Known keys go before duplicates are looked for, so that their
    bodies are not shuffled if the index side is small enough to broadcast. Rows with the key `always` (the manifest's id)
    are all new, whether the index holds it or not."""
    if always is None:
        return first_of_each(slices.join(index.select(key), key, "left_anti"), key)
    special = F.col(key).eqNullSafe(F.lit(always))
    return new_chunks(slices.where(~special), index, key).unionByName(slices.where(special))


def already_present(slices: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """slices with `present`: whether the index holds the key."""
    known = index.select(key).distinct().withColumn("_known", F.lit(True))
    return slices.join(known, key, "left").withColumn("present", F.coalesce("_known", F.lit(False))).drop("_known")


def known_chunks(*logs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys of all logs, each once."""
    out = logs[0].select(key)
    for log in logs[1:]:
        out = out.union(log.select(key))
    return out.distinct()


def count_chunks(index: DataFrame, key: str = "chunk_id", approximate: bool = False) -> DataFrame:
    return index.agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("n_chunks"))


def ratio(slices: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """Slices, distinct slices, bytes, and bytes of distinct slices, by group. Sizes follow from the key, so one
    aggregation by (group, key) comes first and bodies are never shuffled."""
    once = slices.groupBy(*by, key).agg(F.count("*").alias("n"), F.first("length").alias("length"))
    return once.groupBy(*by).agg(
        F.sum("n").alias("n_slices"), F.count("*").alias("n_distinct"),
        F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("distinct_bytes"),
    )


def shared(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that both snapshots hold, each once."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def duplicate_objects(objects: DataFrame, key: str = "object_hash") -> DataFrame:
    """Hashes that occur more than once, with the number of objects."""
    return objects.groupBy(key).agg(F.count("*").alias("n_objects")).where("n_objects > 1")
