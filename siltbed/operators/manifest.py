"""The snapshot log as a hash DAG: heads, dangling parents, depth, tags, order and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.hashing import hmac_sha256
from siltbed.operators import chains
from siltbed.plans.shared import cut


def parents(tx: DataFrame) -> DataFrame:
    return tx.select(F.explode("previous_heads").alias("parent"), F.col("tag").alias("child"))


def heads(tx: DataFrame) -> DataFrame:
    """Records that no record names as a parent."""
    return tx.join(parents(tx).select(F.col("parent").alias("tag")), "tag", "left_anti")


def dangling(tx: DataFrame) -> DataFrame:
    """(parent, child) where the parent is not in the log."""
    return parents(tx).join(tx.select(F.col("tag").alias("parent")), "parent", "left_anti")


def depth(tx: DataFrame) -> DataFrame:
    """(tag, depth long) of the records reachable from records without parents: the longest path to one.

    Runs of records with one parent each are followed by pointer doubling to the root or merge that they start from. Only
    merges are left then; their depths rise round by round until they settle, with one row a merge, however many paths
    lead to it. A log without merges takes a logarithmic number of rounds, one with merges a round more for each merge on
    the longest path. Links that lead back to where they come from raise Cycle: through merges, once depths still rise
    after as many rounds as there are merges, or a depth is more than there are records. Null parents count as none; a
    repeated tag counts once.
    """
    up = F.array_distinct(F.coalesce("previous_heads", F.array().cast("array<string>")))
    base = cut(tx.dropDuplicates(["tag"]).select("tag", up.alias("up")))
    runs = cut(chains.ends(base.select(F.col("tag").alias("node"), F.when(F.size("up") == 1, F.get("up", F.lit(0))).alias("up"))))
    known = base.where(F.size("up") == 0).select(F.col("tag").alias("anchor"), F.lit(0).cast("long").alias("depth"))
    merges = base.where(F.size("up") > 1).select("tag", F.explode("up").alias("node"))
    steps = cut(merges.join(runs, "node").select("tag", "anchor", (F.col("distance") + 1).alias("more")))
    if not steps.isEmpty():
        most = base.count()
        rounds = merges.select("tag").distinct().count() + 1
        known, before = cut(known), None
        for _ in range(rounds + 1):
            risen = steps.join(known, "anchor").select(F.col("tag").alias("anchor"), (F.col("depth") + F.col("more")).alias("depth"))
            known = cut(known.union(risen).groupBy("anchor").agg(F.max("depth").alias("depth")))
            now = known.agg(F.count("*"), F.sum("depth"), F.max("depth")).first()  # none ever falls
            if now == before:
                break
            before = now
            if (now[2] or 0) >= most:
                raise chains.Cycle("links lead back to where they come from")
        else:
            raise chains.Cycle("links lead back to where they come from")
    return runs.join(known, "anchor").select(F.col("node").alias("tag"), (F.col("distance") + F.col("depth")).alias("depth"))


def canonical(*columns: str) -> Column:
    """The text that a tag covers: values joined by a bar, nulls as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def tagged(rows: DataFrame, key: bytes, columns: list[str]) -> DataFrame:
    """rows with `tag`: HMAC over the canonical text of columns."""
    return rows.withColumn("tag", hmac_sha256(F.encode(canonical(*columns), "UTF-8"), key))


def verify_tags(rows: DataFrame, key: bytes, columns: list[str]) -> DataFrame:
    """rows with `valid`: whether the stored tag is that of the record. In a DAG every record is reachable from a head,
    so checking all rows by themselves is checking all ancestors of all heads."""
    return rows.withColumn("valid", F.coalesce(hmac_sha256(F.encode(canonical(*columns), "UTF-8"), key) == F.col("tag"), F.lit(False)))


def newest_first(archives: DataFrame, ts: str = "ts", tie: str = "tag", by: list[str] | None = None) -> DataFrame:
    """archives with `position` from 0, newest first, within groups `by`. Without groups the log of snapshots, one small
    row each, is numbered in one task."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return archives.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def select_archive(archives: DataFrame, wanted: int | str, name: str = "name", ts: str = "ts", tie: str = "tag") -> DataFrame:
    """The first archive, newest first, whose position or name is wanted; no row if there is none. Both searches are
    top-k scans, so the log is never sorted as a whole."""
    newest = [F.col(ts).desc(), F.col(tie).desc()]
    found = archives.where(F.col(name) == str(wanted)).orderBy(*newest).limit(1)
    if str(wanted).isdigit():
        k = int(wanted) + 1
        top = archives.orderBy(*newest).limit(k)
        enough = top.agg(F.count("*").alias("_n")).where(F.col("_n") == k)
        at = top.orderBy(F.col(ts), F.col(tie)).limit(1).join(F.broadcast(enough), F.lit(True)).drop("_n")
        found = found.unionByName(at).orderBy(*newest).limit(1)
    return found


def insertion_order(archives: DataFrame, order: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """archives with `position` from 0 in the order in which they were put in, within groups `by`."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return archives.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def last_modification(tx: DataFrame, ts: str = "ts") -> DataFrame:
    """The greatest time over the heads; null for an empty log."""
    return heads(tx).agg(F.max(ts).alias("last_modification"))


def last_inserted(tx: DataFrame, ts: str = "ts", order: tuple[str, ...] = ("tx_seq",)) -> DataFrame:
    return tx.agg(F.max_by(ts, F.struct(*order)).alias("last_modification"))
