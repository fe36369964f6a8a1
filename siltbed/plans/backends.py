"""Where a repository lies: a few small texts and a few tables that only grow.

`Backend` is all that a repository asks of a store. `Folder` keeps Parquet below a path of any Hadoop file system;
`Memory` keeps a repository for the life of a session, its tables in the shared checkpoint folder.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from siltbed.plans.shared import cut


class Backend(ABC):
    spark: SparkSession

    @abstractmethod
    def put(self, name: str, text: str, replace: bool = False) -> None:
        """A small text. Without replace it is created exclusively: FileExistsError if it is there."""

    @abstractmethod
    def get(self, name: str) -> str | None:
        """The text of a name, None if there is none."""

    @abstractmethod
    def delete(self, name: str) -> None:
        """Takes a text or what has been staged away, if it is there."""

    @abstractmethod
    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows to a table, all or none."""

    @abstractmethod
    def table(self, table: str, schema: str) -> DataFrame:
        """The rows of a table, none if nothing has been added."""

    @abstractmethod
    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, computed once and kept until they are deleted."""


class Folder(Backend):
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def __str__(self) -> str:
        return self.base

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str = "") -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def put(self, name: str, text: str, replace: bool = False) -> None:
        fs, p = self._at(name)
        try:
            out = fs.create(p, replace)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.toString() or "already exists" in e.java_exception.toString():
                raise FileExistsError(f"{self.base}/{name}") from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, name: str) -> str | None:
        return self.spark.read.text(f"{self.base}/{name}", wholetext=True).first()[0] if self.exists(name) else None

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.base}/{table}")

    def table(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{table}") if self.exists(table) else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")


class Memory(Backend):
    def __init__(self, spark: SparkSession):
        self.spark, self.texts, self.parts = spark, {}, {}

    def __str__(self) -> str:
        return "a repository in memory"

    def put(self, name: str, text: str, replace: bool = False) -> None:
        if not replace and name in self.texts:
            raise FileExistsError(name)
        self.texts[name] = text

    def get(self, name: str) -> str | None:
        return self.texts.get(name)

    def delete(self, name: str) -> None:
        self.texts.pop(name, None)

    def append(self, table: str, rows: DataFrame) -> None:
        self.parts.setdefault(table, []).append(cut(rows))

    def table(self, table: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for rows in self.parts.get(table, []):
            out = out.unionByName(rows.select(out.columns))
        return out

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        return cut(rows)
