"""Listings: the tree of nodes of a snapshot, derived from paths and walked level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.paths import ancestors, parent
from siltbed.operators import chains

EXTENTS = "array<struct<start:bigint,end:bigint>>"


def extents_of(size):
    """One dense extent with an inclusive end; null for an empty object."""
    return F.when(size > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), (size - 1).cast("long").alias("end"))))


def nodes_from_paths(objects: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """(path, parent_path, node_type, total_length, total_size, extents): a File for each object and a Directory for each
    distinct ancestor."""
    n = F.col(size).cast("long")
    files = objects.select(F.col(path).alias("path"), F.lit("File").alias("node_type"), n.alias("total_length"), n.alias("total_size"), extents_of(n).alias("extents"))
    zero = F.lit(0).cast("long")
    dirs = objects.select(F.explode(ancestors(F.col(path))).alias("path")).distinct()
    dirs = dirs.select("path", F.lit("Directory").alias("node_type"), zero.alias("total_length"), zero.alias("total_size"), F.lit(None).cast(EXTENTS).alias("extents"))
    return files.unionByName(dirs).withColumn("parent_path", parent(F.col("path")))


def nodes_of_extents(rows: DataFrame) -> DataFrame:
    """As nodes_from_paths, for rows (path, start, length), of which a path may have many: total_length is with holes,
    total_size without, and extents are in order, the empty ones left out."""
    full = F.when(F.col("length") > 0, F.struct("start", (F.col("start") + F.col("length") - 1).alias("end")))
    one = rows.groupBy("path").agg(F.max(F.col("start") + F.col("length")).alias("total_length"), F.sum("length").alias("total_size"), F.sort_array(F.collect_list(full)).alias("extents"))
    nodes = nodes_from_paths(one.select("path", F.col("total_length").alias("length"))).where("node_type = 'Directory'")
    files = one.select("path", F.lit("File").alias("node_type"), "total_length", "total_size", F.when(F.size("extents") > 0, F.col("extents")).alias("extents"), parent(F.col("path")).alias("parent_path"))
    return nodes.unionByName(files)


def bfs(nodes: DataFrame) -> DataFrame:
    """(path, depth long) of all nodes reachable from the roots (empty parent); each path, which has one parent, once. A
    node whose parent is missing or is not a directory is not reached, nor is what is below it."""
    kept = attached(nodes).groupBy("path").agg(F.min("parent_path").alias("up"))
    found = chains.ends(kept.select(F.col("path").alias("node"), F.nullif("up", F.lit("")).alias("up")))
    return found.select(F.col("node").alias("path"), F.col("distance").alias("depth"))


def level_order(nodes: DataFrame) -> DataFrame:
    """(path, depth, position): the nodes that `bfs` reaches, level by level; position counts from 0 within a level, by
    path, so that the order does not depend on how the rows are dealt. Levels are numbered in two steps: paths are dealt by
    their parents first, so a level with a third of all nodes is not sorted by one task unless one directory holds it."""
    found = bfs(nodes).join(attached(nodes).select("path", "parent_path"), "path").dropDuplicates(["path"])
    own = Window.partitionBy("depth", "parent_path").orderBy("path")
    inside = found.withColumn("_i", F.row_number().over(own) - 1)
    sizes = inside.groupBy("depth", "parent_path").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("depth").orderBy("parent_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("depth", "parent_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return inside.join(offsets, ["depth", "parent_path"]).select("path", "depth", (F.col("_i") + F.col("_o")).alias("position"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes, other than roots, whose parent is missing or is not a directory."""
    dirs = nodes.where("node_type = 'Directory'").select(F.col("path").alias("parent_path"))
    return nodes.where("parent_path <> ''").join(dirs, "parent_path", "left_anti")


def attached(nodes: DataFrame) -> DataFrame:
    """Nodes that a listing keeps: roots, and those whose parent is a directory of it."""
    dirs = nodes.where("node_type = 'Directory'").select(F.col("path").alias("parent_path"))
    return nodes.where("parent_path = ''").unionByName(nodes.where("parent_path <> ''").join(dirs, "parent_path", "left_semi").select(nodes.columns))


def children(nodes: DataFrame) -> DataFrame:
    """(path, children) of each directory that has any, sorted."""
    return nodes.where("parent_path <> ''").groupBy(F.col("parent_path").alias("path")).agg(F.sort_array(F.collect_list(F.col("path"))).alias("children"))
