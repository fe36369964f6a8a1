"""Keyed hashes, content ids and their checks.

HMAC-SHA256 is a column expression and stays in whole-stage code; the other algorithms run in Arrow UDFs, BLAKE2bp and
BLAKE3 with a batch of values at once.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.functions import batches, blake

ID_SIZE = 32
MANIFEST_ID = bytes(ID_SIZE)
ALGORITHMS = ("sha256", "blake2b", "blake2bp", "blake3", "sha3")


class UnsupportedAlgorithm(ValueError):
    pass


def mac_function(algorithm: str, key: bytes) -> Callable[[Sequence[bytes]], list[bytes]]:
    """A keyed hash of each of many values: 32 bytes for sha256, sha3 and blake3 (whose key is cut or filled up with zero
    bytes to 32), 64 for blake2b and blake2bp (whose key is cut at 64 bytes)."""
    if algorithm == "sha256":
        return lambda values: [hmac.digest(key, x, "sha256") for x in values]
    if algorithm == "sha3":
        return lambda values: [hmac.digest(key, x, "sha3_256") for x in values]
    if algorithm == "blake2b":
        return lambda values: [hashlib.blake2b(x, key=key[:64], digest_size=64).digest() for x in values]
    if algorithm == "blake2bp":
        return lambda values: blake.blake2bp(values, key)
    if algorithm == "blake3":
        return lambda values: blake.blake3(values, key)
    raise UnsupportedAlgorithm(f"no {algorithm} here; use one of {', '.join(ALGORITHMS)}")


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Lowercase hex HMAC-SHA256 of a binary column; null for null."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda c: F.lit(bytes(k ^ c for k in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), value), 256))), 256)


def mac(value: Column, key: bytes, algorithm: str = "sha256") -> Column:
    """Binary keyed hash of a binary column by any supported algorithm; null for null."""
    if algorithm == "sha256":
        return F.unhex(hmac_sha256(value, key))
    mac_function(algorithm, key)  # fails early

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = mac_function(algorithm, key)
        for values in parts:
            yield from batches.each(f, values)

    return run(value)


def chunk_id(raw: Column) -> Column:
    """The first 32 bytes of raw, filled up with zero bytes on the right."""
    return F.substring(F.concat(raw, F.lit(bytes(ID_SIZE))), 1, ID_SIZE)


def random_id() -> bytes:
    """A new id that no content has, for what is not content-addressed."""
    return os.urandom(ID_SIZE)


def verify_id(raw: Column, identity: Column) -> Column:
    """False where raw has under 32 bytes; else whether its first 32 are the id."""
    return (F.octet_length(raw) >= ID_SIZE) & (F.substring(raw, 1, ID_SIZE) == identity)


def content_id(value: Column, key: bytes, algorithm: str = "sha256") -> Column:
    return chunk_id(mac(value, key, algorithm))
