"""A repository of snapshots in a backend: create, open, store, list, contents, extract, scrub.

Tables below the base path: chunks, object_chunks, nodes, archives (the snapshot log, one small file a snapshot) and the
driver's files key.json and settings.json. A snapshot is committed by its row in archives, written last; a crash before
that leaves chunks without a snapshot, never a snapshot without its chunks.
"""

from __future__ import annotations

import json
import os
import platform
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed import IMPLEMENTATION_UUID, __version__
from siltbed.functions import codecs
from siltbed.functions.hashing import content_id
from siltbed.functions.keys import Key
from siltbed.functions.paths import glob_filter, object_key, trimmed
from siltbed.operators import dedup, listing, manifest, restore
from siltbed.operators.chunkers import FastCDC, chunk
from siltbed.plans.backends import Backend, Folder


class RepositoryError(Exception):
    pass


class AlreadyExists(RepositoryError):
    pass


class Locked(RepositoryError):
    pass


class ArchiveNotFound(RepositoryError):
    pass


@dataclass(frozen=True)
class Settings:
    """One HMAC for the life of a repository, since ids depend on it; compression and encryption may change."""

    compression: str = "zstd"
    level: int = 1
    encryption: str = "aes256ctr"
    hmac: str = "sha256"

    @classmethod
    def lightweight(cls) -> Settings:
        return cls("none", 0, "none", "blake2b")


CHUNKS = "chunk_id binary, compression string, level int, encryption string, iv binary, hmac string, mac binary, data binary"
OBJECT_CHUNKS = "archive string, namespace string, path string, ordinal int, chunk_id binary, start long, length long"
NODES = "archive string, path string, node_type string, total_length long, total_size long, extents array<struct<start:bigint,end:bigint>>, parent_path string"
ARCHIVES = "tag string, previous_heads array<string>, pointer string, name string, ts timestamp, tz_offset_sec int, nonce string"
TAGGED = ["heads", "pointer", "name", "ts_us", "tz_offset_sec", "nonce"]


class Repository:
    def __init__(self, backend: Backend, key: Key, settings: Settings):
        self.backend, self.spark, self.key, self.settings = backend, backend.spark, key, settings

    @classmethod
    def create(cls, spark: SparkSession, base: str | Backend, password: str, settings: Settings | None = None) -> Repository:
        """A new repository with a random key, below a path or in a backend; refuses one that exists."""
        backend = base if isinstance(base, Backend) else Folder(spark, base)
        if backend.get("key.json") is not None or isinstance(backend, Folder) and backend.exists():
            raise AlreadyExists(str(backend))
        settings, key = settings or Settings(), Key.random()
        backend.put("settings.json", json.dumps(asdict(settings)))
        backend.put("version.json", json.dumps({"version": __version__, "implementation": IMPLEMENTATION_UUID}))
        backend.put("key.json", json.dumps(key.wrap(password)))
        return cls(backend, key, settings)

    @classmethod
    def open(cls, spark: SparkSession, base: str | Backend, password: str) -> Repository:
        backend = base if isinstance(base, Backend) else Folder(spark, base)
        wrapped = backend.get("key.json")
        if wrapped is None:
            raise RepositoryError(f"no repository at {backend}")
        return cls(backend, Key.unwrap(json.loads(wrapped), password), Settings(**json.loads(backend.get("settings.json"))))

    def set_settings(self, settings: Settings) -> None:
        if settings.hmac != self.settings.hmac:
            raise RepositoryError("the HMAC of a repository is fixed: ids depend on it")
        self.backend.put("settings.json", json.dumps(asdict(settings)), replace=True)
        self.settings = settings

    def _lock(self) -> None:
        """The lock file is created exclusively: a second writer fails with Locked, which tells who holds it and since when.
        Any other error of the store is passed on."""
        try:
            self.backend.put("lock", json.dumps({"holder": uuid.uuid4().hex, "since": time.time(), "host": platform.node(), "pid": os.getpid()}))
        except FileExistsError as e:
            raise Locked(f"{self.backend}: {self.lock_holder()}") from e

    def lock_holder(self) -> dict | None:
        """Who holds the lock: holder, since (seconds since 1970), host and pid; None if nobody does."""
        held = self.backend.get("lock")
        return None if held is None else json.loads(held)

    def break_lock(self, older_than: float = 3600) -> bool:
        """Takes a lock away that a crashed writer has left, if it is older than so many seconds, and the staging area with
        it; whether there was one. It is for the caller to know that the writer is dead."""
        held = self.lock_holder()
        if held is None or time.time() - held["since"] < older_than:
            return False
        self.backend.delete("staging")
        self.backend.delete("lock")
        return True

    def _unlock(self) -> None:
        self.backend.delete("lock")

    def touch(self) -> None:
        """Nothing to do: a snapshot's record is all that tells when a repository was last changed."""

    @property
    def chunks(self) -> DataFrame:
        return self.backend.table("chunks", CHUNKS)

    @property
    def object_chunks(self) -> DataFrame:
        return self.backend.table("object_chunks", OBJECT_CHUNKS)

    @property
    def nodes(self) -> DataFrame:
        return self.backend.table("nodes", NODES)

    @property
    def archives(self) -> DataFrame:
        return self.backend.table("archives", ARCHIVES)

    # chunks

    def has_chunk(self, ids: DataFrame) -> DataFrame:
        return dedup.already_present(ids, self.chunks)

    def count_chunks(self) -> int:
        return self.chunks.select("chunk_id").distinct().count()

    def read_chunks(self, ids: DataFrame) -> DataFrame:
        """(chunk_id, body) of ids; an unknown id or a damaged chunk raises an error."""
        s = self.settings_in_use()
        found = restore.fetch(ids.select("chunk_id").distinct(), self.chunks)
        return (codecs.unpack(found, self.key, s) if s else found.withColumn("body", F.col("data"))).select("chunk_id", "body")

    def settings_in_use(self) -> list[tuple[str, str, str]]:
        return codecs.settings_of(self.chunks)

    def write_chunks(self, slices: DataFrame) -> None:
        """Hash, anti-join, and pack only what is new. chunk_id and body are read; each id is written once."""
        s = self.settings
        new = dedup.new_chunks(slices.select("chunk_id", "body"), self.chunks)
        self.backend.append("chunks", codecs.pack(new, self.key, s.compression, s.level, s.encryption, s.hmac))

    # snapshots

    def store(self, objects: DataFrame, name: str, chunker=None, namespace: Iterable[str] = (), tz_offset_sec: int = 0) -> str:
        """Stores (path, content) rows as a snapshot and returns its pointer. Null content counts as empty; paths are
        trimmed; a path that is stored twice makes its object ambiguous and is an error.

        Sparse objects: with a column `start` (long), each row is an extent of its path that begins there; holes between
        extents are not stored and come back as zeros. Extents of a path must not overlap or begin at the same place."""
        pointer, ns = uuid.uuid4().hex, list(namespace)
        key = object_key(F.array(*map(F.lit, ns)).cast("array<string>"), F.col("path"))
        self._lock()
        staged = f"staging/{pointer}"
        try:
            origin = F.coalesce(F.col("start"), F.lit(0)) if "start" in objects.columns else F.lit(0)
            sized = objects.select("path", origin.cast("long").alias("origin"), F.coalesce(F.col("content"), F.lit(b"")).alias("content"))
            slices = chunk(sized, chunker or FastCDC()).withColumn("start", F.col("start") + F.col("origin"))
            slices = slices.withColumn("chunk_id", content_id(F.col("body"), self.key.id_key, self.settings.hmac))
            # only places and ids are staged, never a body
            empty = sized.where(F.octet_length("content") == 0).select("path", "origin", F.lit(-1).alias("ordinal"), F.col("origin").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("chunk_id"))
            places = self.backend.stage(staged, slices.select(empty.columns).unionByName(empty))
            firsts = F.count_if(F.col("ordinal") <= 0)
            extents = places.groupBy(F.col("path"), "origin").agg(firsts.alias("n"), F.sum("length").alias("length"))
            twice = extents.groupBy(trimmed(F.col("path")).alias("path"), "origin").agg(F.sum("n").alias("n")).where("n > 1").limit(1).collect()
            if twice:
                raise RepositoryError(f"{twice[0][0]!r} is stored twice")
            self._write_new(slices, places)
            where = places.where("ordinal >= 0").select(F.lit(pointer).alias("archive"), F.lit("".join(f"{n}:" for n in ns) or ":").alias("namespace"), key.alias("path"), "ordinal", "chunk_id", "start", "length")
            self.backend.append("object_chunks", where)
            tree = listing.nodes_of_extents(extents.select("path", F.col("origin").alias("start"), "length"))
            self.backend.append("nodes", tree.select(F.lit(pointer).alias("archive"), "path", "node_type", "total_length", "total_size", "extents", "parent_path"))
            self._commit(pointer, name, tz_offset_sec)
        finally:
            self.backend.delete(staged)
            self._unlock()
        return pointer

    def _write_new(self, slices: DataFrame, places: DataFrame) -> None:
        """Packs the bodies of one place of each staged id that the index lacks. Ids are compared and places chosen without
        bodies; of the slices, made anew, only those at chosen places go on. A source that has changed since it was staged
        no longer has a chosen id at its place: that is an error, and the snapshot is not committed."""
        s, chosen = self.settings, F.min(F.struct("path", "origin", "ordinal")).alias("at")
        lacking = places.where("ordinal >= 0").join(self.chunks.select("chunk_id"), "chunk_id", "left_anti")
        wanted = lacking.groupBy("chunk_id").agg(chosen).select("chunk_id", "at.*")
        new = slices.join(wanted, ["path", "origin", "ordinal", "chunk_id"], "left_semi")
        self.backend.append("chunks", codecs.pack(new.select("chunk_id", "body"), self.key, s.compression, s.level, s.encryption, s.hmac))
        lost = places.where("ordinal >= 0").join(self.chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).collect()
        if lost:
            raise RepositoryError(f"{lost[0]['path']!r} changed while it was stored")

    def _commit(self, pointer: str, name: str, tz_offset_sec: int) -> None:
        """The new record links to all current heads and becomes the only head."""
        heads = sorted(r[0] for r in manifest.heads(self.archives).select("tag").collect())
        row = self.spark.range(1).select(
            F.array(*map(F.lit, heads)).cast("array<string>").alias("previous_heads"), F.lit(pointer).alias("pointer"), F.lit(name).alias("name"),
            F.lit(self.spark.sql("select unix_micros(current_timestamp())").first()[0]).alias("us"), F.lit(tz_offset_sec).alias("tz_offset_sec"), F.lit(uuid.uuid4().hex).alias("nonce"),
        ).withColumn("ts", F.timestamp_micros("us")).drop("us")
        row = manifest.tagged(self._canonical(row), self.key.hmac_key, TAGGED)
        self.backend.append("archives", row.select("tag", "previous_heads", "pointer", "name", "ts", "tz_offset_sec", "nonce").coalesce(1))

    @staticmethod
    def _canonical(rows: DataFrame) -> DataFrame:
        return rows.withColumn("heads", F.array_join("previous_heads", ",")).withColumn("ts_us", F.unix_micros("ts"))

    def verify(self) -> DataFrame:
        """(name, pointer, valid) of each snapshot record, and whether all its parents are there."""
        checked = manifest.verify_tags(self._canonical(self.archives), self.key.hmac_key, TAGGED)
        lost = manifest.dangling(self.archives).select(F.col("child").alias("tag")).distinct().withColumn("lost", F.lit(True))
        return checked.join(lost, "tag", "left").select("name", "pointer", (F.col("valid") & F.col("lost").isNull()).alias("valid"))

    def list(self) -> DataFrame:
        """(position, name, pointer, ts) newest first."""
        return manifest.newest_first(self.archives).select("position", "name", "pointer", "ts", "tz_offset_sec").orderBy("position")

    def last_modification(self) -> DataFrame:
        return manifest.last_modification(self.archives)

    def _pointer(self, archive: int | str) -> str:
        found = manifest.select_archive(self.archives, archive).select("pointer").collect()
        if not found:
            raise ArchiveNotFound(str(archive))
        return found[0][0]

    def contents(self, archive: int | str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
        """Nodes of a snapshot by position or name. Globs are applied before any payload is read."""
        return self.nodes.where((F.col("archive") == self._pointer(archive)) & glob_filter(F.col("path"), include, exclude)).drop("archive")

    def extract(self, archive: int | str, include: Iterable[str] = (), exclude: Iterable[str] = (), namespace: Iterable[str] = ()) -> DataFrame:
        """(path, content) of the files of a snapshot. That all chunks are there is checked at once, over ids only; payloads
        are read by an action. `contents` with the same globs is the preview."""
        pointer, ns = self._pointer(archive), "".join(f"{n}:" for n in namespace) or ":"
        files = self.contents(archive, include, exclude).where("node_type = 'File'").select("path", "total_length")
        where = self.object_chunks.where((F.col("archive") == pointer) & (F.col("namespace") == ns)).withColumn("path", F.expr(f"substring(path, {len(ns) + 1})"))
        wanted = where.join(files.select(trimmed(F.col("path")).alias("path")), "path", "left_semi")
        parts = codecs.unpack(restore.fetch(wanted.select("path", "start", "length", "chunk_id"), self.chunks), self.key, self.settings_in_use())
        whole = restore.reassemble(parts)
        return files.join(whole.withColumnRenamed("path", "_p"), trimmed(files.path) == F.col("_p"), "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))

    def read_ranges(self, archive: int | str, extents: DataFrame, namespace: Iterable[str] = ()) -> DataFrame:
        """(path, extent_no, start, length, body): the stored bytes inside (path, extent_no, start, end) extents, ends
        inclusive. Only slices that meet an extent are fetched and unpacked."""
        pointer, ns = self._pointer(archive), "".join(f"{n}:" for n in namespace) or ":"
        where = self.object_chunks.where((F.col("archive") == pointer) & (F.col("namespace") == ns)).withColumn("path", F.expr(f"substring(path, {len(ns) + 1})"))
        e = extents.select("path", F.col("start").alias("_a"), F.col("end").alias("_b"))
        near = where.join(e, "path").where((F.col("start") <= F.col("_b")) & (F.col("start") + F.col("length") > F.col("_a")))
        parts = restore.fetch(near.select("path", "start", "length", "chunk_id").distinct(), self.chunks)
        return restore.range_fetch(codecs.unpack(parts, self.key, self.settings_in_use()), extents)

    def scrub(self) -> DataFrame:
        """chunk_id of each stored chunk that is damaged: its MAC does not fit, or its plain body has another id."""
        bad = codecs.scrub(self.chunks, self.key)
        plain = codecs.unpack(self.chunks, self.key, fail=False).where("body is not null")
        wrong = plain.where(content_id(F.col("body"), self.key.id_key, self.settings.hmac) != F.col("chunk_id")).select("chunk_id")
        return bad.union(wrong).distinct()


