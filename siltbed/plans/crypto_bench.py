"""MiB/s of each pair of cipher and MAC, without compression, in one thread."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltbed.functions import codecs, hashing
from siltbed.functions.keys import Key

MIB = 1 << 20


def bench_crypto(spark: SparkSession, rounds: int = 100) -> Iterator[tuple[str, str, float]]:
    """(cipher, MAC, MiB/s) over `rounds` blocks of a MiB of zeros."""
    key = Key.random()
    blocks = spark.range(0, rounds, 1, 1).select(F.lit(bytes(MIB)).alias("body"))
    for cipher in codecs.ENCRYPTIONS[1:]:
        for algorithm in hashing.ALGORITHMS:
            began = time.perf_counter()
            codecs.pack(blocks, key, "none", 0, cipher, algorithm).write.format("noop").mode("overwrite").save()
            yield cipher, algorithm, rounds / (time.perf_counter() - began)
