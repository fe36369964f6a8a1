"""Directory scans and restores."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators.listing import extents_of


def scan_files(spark: SparkSession, root: str, empty: bool = True) -> DataFrame:
    """(path relative to root, length, content, extents) of all regular files below root. Unread columns cost nothing:
    without `content` the scan lists only. Files that vanish during the scan are left out.

    Spark's file scan passes over empty files, so the driver lists those; `empty` False saves that listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root).select("path", "length", "content")
    if empty:
        raw = raw.union(spark.createDataFrame([(p, 0, b"") for p in _empty_files(spark, root)], raw.schema))
    base = urlparse(root).path if "://" in root else os.path.abspath(root)
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    start = F.locate(base.rstrip("/") + "/", path) + len(base.rstrip("/")) + 1
    return raw.select(F.substr(path, start).alias("path"), "length", "content", extents_of(F.col("length")).alias("extents"))


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith((".", "_")):
            out.append(f.getPath().toUri().toString())
    return out


def scan_directories(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all directories below root, in any Hadoop file system, also of empty ones, which a file scan does not show.
    The driver lists them, as Spark's own file scan lists files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    waiting, found = [(p, "")], []
    while waiting:
        at, name = waiting.pop()
        for f in fs.listStatus(at):
            if f.isDirectory():
                below = f"{name}/{f.getPath().getName()}" if name else f.getPath().getName()
                found.append((below,))
                waiting.append((f.getPath(), below))
    return spark.createDataFrame(found, "path string")


def write_files(objects: DataFrame, target: str) -> DataFrame:
    """Writes (path, content) below target, from the executors, and returns (path, n_bytes) lazily: an action does the
    work. target is a folder that all executors share, or a URI of a store that Arrow knows (file, hdfs, s3, gs, abfs).
    Writing is idempotent: each file is written whole, then renamed, so a task that runs again does no harm. A path that
    leads out of target is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), os.path.abspath(target))
        top = top.rstrip("/")
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = posixpath.normpath(posixpath.join(top, path))
                if not to.startswith(top + "/"):
                    raise ValueError(f"{path!r} leads out of {top}")
                store.create_dir(posixpath.dirname(to), recursive=True)
                part = f"{to}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content or b"")
                store.move(part, to)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return objects.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(run, "path string, n_bytes long")
