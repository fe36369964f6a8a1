"""Streaming ingest, an extension: slices of arriving objects are stored if their content is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.functions.hashing import content_id
from siltbed.operators.chunkers import StaticSize, chunk
from siltbed.plans.repository import Repository


def ingest(stream: DataFrame, repository: Repository, checkpoint: str, chunker=None) -> StreamingQuery:
    """Each micro-batch of (path, content) appends the chunks that the repository lacks. A batch that runs again after a
    failure finds its chunks and writes nothing, so every chunk is stored once."""

    def batch(objects: DataFrame, _: int) -> None:
        slices = chunk(objects.select("path", "content"), chunker or StaticSize())
        repository.write_chunks(slices.withColumn("chunk_id", content_id(F.col("body"), repository.key.id_key, repository.settings.hmac)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, ts: str = "ts", key: str = "chunk_id", delay: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
