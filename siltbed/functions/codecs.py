"""Compression, encryption, and their composition to packed slices: compress, encrypt, then authenticate."""

from __future__ import annotations

import lzma
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions import batches
from siltbed.functions.hashing import UnsupportedAlgorithm, chunk_id, mac
from siltbed.functions.keys import Key

COMPRESSIONS, ENCRYPTIONS = ("none", "zstd", "lz4", "xz"), ("none", "aes256ctr", "chacha20")
IV_SIZE = {"none": 0, "aes256ctr": 16, "chacha20": 12}
KEY_SIZE = {"none": 16, "aes256ctr": 32, "chacha20": 32}
#: Bytes of key stream made together.
TOGETHER = 1 << 20
#: The end of the initialisation vectors that `pack` makes: GCM numbers the blocks of a 12-byte nonce from 2, so the JVM's GCM
#: gives the bytes of CTR.
FIRST_BLOCK = b"\0\0\0\2"


class IntegrityError(Exception):
    pass


def compress(raw: bytes, kind: str, level: int = 1) -> bytes:
    if kind == "none":
        return raw
    if kind == "zstd":
        return zstandard.ZstdCompressor(level=level).compress(raw)
    if kind == "lz4":
        out = pa.BufferOutputStream()
        with pa.CompressedOutputStream(out, "lz4") as f:
            f.write(raw)
        return out.getvalue().to_pybytes()
    if kind == "xz":
        return lzma.compress(raw, preset=level)
    raise UnsupportedAlgorithm(f"no compression {kind}; use one of {', '.join(COMPRESSIONS)}")


def decompress(raw: bytes, kind: str) -> bytes:
    if kind == "none":
        return raw
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind == "lz4":
        return pa.CompressedInputStream(pa.BufferReader(raw), "lz4").read()
    if kind == "xz":
        return lzma.decompress(raw)
    raise UnsupportedAlgorithm(f"no compression {kind}; use one of {', '.join(COMPRESSIONS)}")


def chacha20_streams(key: bytes, ivs: Sequence[bytes], sizes: Sequence[int], counter: int = 0) -> list[bytes]:
    """Key streams of ChaCha20 with 32-bit counter and 96-bit nonce (RFC 8439), all blocks of all streams at once."""
    blocks = np.array([-(-n // 64) for n in sizes], np.int64)
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(blocks)), blocks)
    state = np.empty((16, len(owner)), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = counter + np.arange(len(owner)) - first[owner]
    state[13:] = np.frombuffer(b"".join(ivs), "<u4").reshape(-1, 3)[owner].T
    x, spare = state.copy(), np.empty(len(owner), np.uint32)

    def turn(v: np.ndarray, n: int) -> None:
        np.left_shift(v, np.uint32(n), out=spare)
        np.right_shift(v, np.uint32(32 - n), out=v)
        np.bitwise_or(v, spare, out=v)

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for i, j, k, r in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[i] += x[j]
            x[k] ^= x[i]
            turn(x[k], r)

    for _ in range(10):
        for s in range(4):
            quarter(s, 4 + s, 8 + s, 12 + s)
        for s in range(4):
            quarter(s, 4 + (s + 1) % 4, 8 + (s + 2) % 4, 12 + (s + 3) % 4)
    out = (x + state).astype("<u4").T.tobytes()
    return [out[64 * at : 64 * at + n] for at, n in zip(first.tolist(), sizes, strict=True)]


def chacha20_stream(key: bytes, iv: bytes, size: int, counter: int = 0) -> bytes:
    return chacha20_streams(key, [iv], [size], counter)[0]


def chacha20(key: bytes, values: Sequence[bytes], ivs: Sequence[bytes]) -> list[bytes]:
    """Each value XORed with its key stream, some megabytes at a time."""
    out, at = [], 0
    while at < len(values):
        end, held = at, 0
        while end < len(values) and (held == 0 or held + len(values[end]) <= TOGETHER):
            held += len(values[end]) + 1
            end += 1
        streams = chacha20_streams(key, ivs[at:end], [len(x) for x in values[at:end]])
        out += map(xor, values[at:end], streams)
        at = end
    return out


def counter_blocks(iv: bytes, size: int) -> bytes:
    """The 128-bit big-endian counters from iv on that cover size bytes."""
    n, start = -(-size // 16), int.from_bytes(iv, "big")
    high, low = divmod(start, 1 << 64)
    out = np.empty((n, 2), ">u8")
    if low + n <= 1 << 64:
        out[:, 0], out[:, 1] = high, np.uint64(low) + np.arange(n, dtype=np.uint64)
        return out.tobytes()
    return b"".join(((start + i) % (1 << 128)).to_bytes(16, "big") for i in range(n))


def xor(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)[: len(a)]).tobytes()


def _each(f: Callable[[list[bytes], list[bytes]], Iterable[bytes]], value: Column, other: Column) -> Column:
    """f over the values that are not null, with those of another column, a piece of a batch at a time; null for null."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, o in parts:
            yield from batches.each(f, v, o)

    return run(value, other)


def compressed(value: Column, kind: str, level: int = 1) -> Column:
    return value if kind == "none" else _each(lambda xs, _: (compress(x, kind, level) for x in xs), value, F.lit(b""))


def decompressed(value: Column, kind: str) -> Column:
    return value if kind == "none" else _each(lambda xs, _: (decompress(x, kind) for x in xs), value, F.lit(b""))


def ivs(kind: str, n: int) -> list[bytes]:
    """n random initialisation vectors."""
    if kind == "aes256ctr":
        return [os.urandom(12) + FIRST_BLOCK for _ in range(n)]
    return [os.urandom(IV_SIZE[kind]) for _ in range(n)]


def fresh_iv(kind: str) -> Column:
    """A random initialisation vector a row. Not deterministic: write the rows before using them twice."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(ivs(kind, len(rows)), pa.binary())

    return run.asNondeterministic()(F.lit(0)) if IV_SIZE[kind] else F.lit(b"")


def ciphered(value: Column, kind: str, key: bytes, iv: Column, then: Callable[[bytes], bytes] | None = None) -> Column:
    """Encrypts or decrypts (both ciphers XOR a key stream). AES is the JVM's: no byte goes through Python where the vector
    ends as those of `pack` do; elsewhere the stream is made from counter blocks and XORed in Python. `then` is applied to
    each result in the same Python stage, of which there is one at most."""
    finish = (lambda xs: map(then, xs)) if then else (lambda xs: xs)
    if kind == "none":
        return _each(lambda xs, _: finish(xs), value, F.lit(b"")) if then else value
    key = cipher_key(kind, key)
    if kind == "chacha20":
        return _each(lambda xs, ns: finish(chacha20(key, xs, ns)), value, iv)
    ours = F.substring(iv, 13, 4) == F.lit(FIRST_BLOCK)
    native, stream = F.when(ours, _gcm(value, key, iv)), F.when(~ours, _stream(_counters(iv, F.octet_length(value)), key))
    if then is None:
        return F.coalesce(native, _each(lambda xs, ss: map(xor, xs, ss), F.when(~ours, value), stream))
    return _each(lambda xs, ss: finish(xor(x, s) if s else x for x, s in zip(xs, ss, strict=True)), F.coalesce(native, value), F.coalesce(stream, F.lit(b"")))


def cipher_key(kind: str, key: bytes) -> bytes:
    if kind not in ENCRYPTIONS:
        raise UnsupportedAlgorithm(f"no encryption {kind}; use one of {', '.join(ENCRYPTIONS)}")
    return key[: KEY_SIZE[kind]].ljust(KEY_SIZE[kind], b"\0")


def _stream(blocks: Column, key: bytes) -> Column:
    return F.aes_encrypt(blocks, F.lit(key), F.lit("ECB"), F.lit("PKCS"))


def _gcm(value: Column, key: bytes, iv: Column) -> Column:
    """AES-CTR of values whose vector ends in FIRST_BLOCK: what GCM gives between its nonce and its tag."""
    sealed = F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.substring(iv, 1, 12))
    return F.substr(sealed, F.lit(13), F.octet_length(value))


def _counters(iv: Column, size: Column) -> Column:
    """`counter_blocks` in built-in expressions: at least as many as cover size bytes, from four words with carries."""
    words = [F.conv(F.hex(F.substring(iv, 4 * k + 1, 4)), 16, 10).cast("long") for k in range(4)]

    def block(i: Column) -> Column:
        out, carry = [], i
        for w in reversed(words):
            total = w + carry
            out.append(F.lpad(F.hex(total.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
            carry = F.shiftright(total, 32)
        return F.concat(*reversed(out))

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(size / 16)), block), ""))


def _sealed(rows: DataFrame, compression: str, level: int, encryption: str, key: bytes) -> DataFrame:
    """(chunk_id, body) or (chunk_id, pressed) to (chunk_id, data, iv): compressed, unless it is, and encrypted. One Python
    stage at most, and none for bytes that are only encrypted by the JVM's AES."""
    key, raw = cipher_key(encryption, key), "pressed" not in rows.columns
    value, kind = (F.col("body"), compression) if raw else (F.col("pressed"), "none")
    if encryption == "none":
        return rows.select("chunk_id", compressed(value, kind, level).alias("data"), F.lit(b"").alias("iv"))
    if encryption == "aes256ctr" and kind == "none":
        rows = rows.select("chunk_id", value.alias("data"), fresh_iv(encryption).alias("iv"))
        return rows.select("chunk_id", _gcm(F.col("data"), key, F.col("iv")).alias("data"), "iv")

    def sealed(xs: list[bytes], ns: list[bytes]) -> Iterable[bytes]:
        out = (compress(x, kind, level) for x in xs)
        return chacha20(key, list(out), ns) if encryption == "chacha20" else out

    @F.arrow_udf("data binary, iv binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in parts:
            fresh, at = pa.array(ivs(encryption, len(v)), pa.binary()), 0
            for data in batches.each(sealed, v, fresh):
                yield pa.StructArray.from_arrays([data, fresh.slice(at, len(data))], ["data", "iv"])
                at += len(data)

    rows = rows.select("chunk_id", run.asNondeterministic()(value).alias("p"))
    data = F.col("p.data") if encryption == "chacha20" else _gcm(F.col("p.data"), key, F.col("p.iv"))
    return rows.select("chunk_id", data.alias("data"), F.col("p.iv").alias("iv"))


def _known(slices: DataFrame, key: Key, algorithm: str) -> DataFrame:
    """slices with their chunk_id: their own, or that of the plain body."""
    return slices if "chunk_id" in slices.columns else slices.withColumn("chunk_id", chunk_id(mac(F.col("body"), key.id_key, algorithm)))


def pressed(slices: DataFrame, key: Key, compression: str, level: int = 1, algorithm: str = "sha256") -> DataFrame:
    """(chunk_id, pressed) for `pack`, where one compression is packed with several encryptions: the rows are dealt anew, and
    Spark computes and keeps what it deals once, however many packs read it. Without compression the slices are as they were."""
    if compression == "none":
        return slices
    rows = _known(slices, key, algorithm).select("chunk_id", compressed(F.col("body"), compression, level).alias("pressed"))
    return rows.repartition("chunk_id", "pressed")


def pack(slices: DataFrame, key: Key, compression: str = "zstd", level: int = 1, encryption: str = "aes256ctr", algorithm: str = "sha256") -> DataFrame:
    """(chunk_id, body, ...) to packed rows (chunk_id, compression, level, encryption, iv, hmac, mac, data).

    A chunk_id column is kept; without one it is computed from the plain body. Null bodies give null data. Rows of `pressed`,
    made with the same compression and level, are not compressed again.
    """
    rows = _known(slices, key, algorithm)
    rows = _sealed(rows.select("chunk_id", "pressed" if "pressed" in rows.columns else "body"), compression, level, encryption, key.key)
    return rows.select(
        "chunk_id", F.lit(compression).alias("compression"), F.lit(level).alias("level"), F.lit(encryption).alias("encryption"), "iv",
        F.lit(algorithm).alias("hmac"), mac(F.col("data"), key.hmac_key, algorithm).alias("mac"), "data",
    )


def split(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, bodies) of packed rows: everything but the data, and the data; both by chunk_id."""
    return packed.drop("data"), packed.select("chunk_id", "data")


def unsplit(headers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Packed rows from headers and bodies of distinct ids; a header without a body is left out."""
    return headers.join(bodies, "chunk_id")


def settings_of(packed: DataFrame) -> list[tuple[str, str, str]]:
    """The (compression, encryption, hmac) triples in use: a handful, whatever the number of rows."""
    return sorted(tuple(r) for r in packed.select("compression", "encryption", "hmac").distinct().collect())


def unpack(packed: DataFrame, key: Key, settings: list[tuple[str, str, str]] | None = None, fail: bool = True) -> DataFrame:
    """packed with `body`; rows whose MAC does not fit raise IntegrityError's message, or get null if not fail.

    settings: the triples that occur (else they are looked up, which takes a pass over three small columns).
    """
    body = F.lit(None).cast("binary")
    for compression, encryption, algorithm in settings_of(packed) if settings is None else settings:
        here = (F.col("compression") == compression) & (F.col("encryption") == encryption) & (F.col("hmac") == algorithm)
        good = mac(F.col("data"), key.hmac_key, algorithm) == F.col("mac")
        bad = F.raise_error(F.lit("a packed slice does not fit its MAC")).cast("binary") if fail else F.lit(None).cast("binary")
        part = packed.where(here).withColumn("_good", good)
        part = part.withColumn("_data", F.when(F.col("_good"), F.col("data")).when(F.col("data").isNotNull(), bad))
        then = None if compression == "none" else partial(decompress, kind=compression)
        part = part.withColumn("body", ciphered(F.col("_data"), encryption, key.key, F.col("iv"), then)).drop("_good", "_data")
        body = part if isinstance(body, Column) else body.unionByName(part)
    return packed.withColumn("body", F.lit(None).cast("binary")).limit(0) if isinstance(body, Column) else body


def scrub(packed: DataFrame, key: Key) -> DataFrame:
    """chunk_id of each packed row whose MAC does not fit its data."""
    out = packed.select("chunk_id").limit(0)
    for _, _, algorithm in {(0, 0, s[2]) for s in settings_of(packed)}:
        rows = packed.where(F.col("hmac") == algorithm)
        out = out.union(rows.where(F.coalesce(mac(F.col("data"), key.hmac_key, algorithm) != F.col("mac"), F.lit(True))).select("chunk_id"))
    return out
