import hashlib
import hmac

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltbed.functions import batches, blake, codecs, hashing, paths
from siltbed.functions.keys import Key, KeyError_

KEY = Key(bytes(range(32)), bytes(range(32, 64)), bytes(range(64, 96)), 7)
TEXT = b"An ASCII paragraph, repeated so that compression has something to do. " * 20


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v binary").select(column.alias("x")).first()[0]


@pytest.mark.parametrize("key", [b"Jefe", b"k" * 64, b"k" * 100])
def test_hmac_sha256(spark, key):
    want = hmac.new(key, b"what do ya want for nothing?", "sha256").hexdigest()
    assert one(spark, b"what do ya want for nothing?", hashing.hmac_sha256(F.col("v"), key)) == want
    assert one(spark, None, hashing.hmac_sha256(F.col("v"), key)) is None


def test_mac_algorithms(spark):
    assert bytes(one(spark, b"x", hashing.mac(F.col("v"), b"k", "sha3"))) == hmac.digest(b"k", b"x", "sha3_256")
    assert bytes(one(spark, b"x", hashing.mac(F.col("v"), b"k", "blake2b"))) == hashlib.blake2b(b"x", key=b"k").digest()
    with pytest.raises(hashing.UnsupportedAlgorithm):
        hashing.mac(F.col("v"), b"k", "md5")


@pytest.mark.parametrize("raw", [b"", b"\x01", b"\x01" * 32, b"\x02" * 64])
def test_chunk_id(spark, raw):
    assert bytes(one(spark, raw, hashing.chunk_id(F.col("v")))) == raw[:32].ljust(32, b"\0")
    assert one(spark, raw, hashing.verify_id(F.col("v"), hashing.chunk_id(F.col("v")))) == (len(raw) >= 32)
    assert one(spark, raw, hashing.verify_id(F.col("v"), F.lit(bytes(32)))) is False


def test_key_dealing_and_wrapping():
    k = Key.from_bytes(bytes([1, 2, 3] * 3), 4)
    assert (k.key, k.hmac_key, k.id_key, k.chunker_nonce) == (b"\1" * 3, b"\2" * 3, b"\3" * 3, 4)
    wrapped = k.wrap("secret", n=1 << 10)
    assert Key.unwrap(wrapped, "secret") == k
    with pytest.raises(KeyError_):
        Key.unwrap(wrapped, "other")


def test_chacha20_vector():
    """RFC 8439, 2.4.2."""
    key, iv = bytes(range(32)), bytes.fromhex("000000000000004a00000000")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    assert codecs.xor(text, codecs.chacha20_stream(key, iv, len(text), 1)).hex().startswith("6e2e359a2568f98041ba0728dd0d6981e97e7aec1d4360c20a27afccfd9fae0b")


def test_aes_ctr_vector(spark):
    """SP 800-38A, F.5.5."""
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    iv = F.lit(bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"))
    got = one(spark, plain, codecs.ciphered(F.col("v"), "aes256ctr", key, iv))
    assert bytes(got).hex() == "601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c5"


@pytest.mark.parametrize("compression", codecs.COMPRESSIONS)
@pytest.mark.parametrize("encryption", codecs.ENCRYPTIONS)
def test_pack_matrix(spark, tmp_path, compression, encryption):
    df = spark.createDataFrame([(TEXT,), (b"",), (b"x",)], "body binary")
    parts = [codecs.pack(df, KEY, compression, 1, encryption, a) for a in hashing.ALGORITHMS]
    parts[0].union(parts[1]).union(parts[2]).write.parquet(str(tmp_path / "p"))  # vectors are random: write, then use
    packed = spark.read.parquet(str(tmp_path / "p"))
    got = codecs.unpack(packed, KEY)
    assert sorted(bytes(r.body) for r in got.collect()) == sorted([TEXT, b"", b"x"] * 3)
    if encryption != "none" or compression != "none":
        assert all(bytes(r.data) != TEXT for r in packed.collect())
    assert codecs.scrub(packed, KEY).count() == 0


def test_tampering_is_found(spark, tmp_path):
    codecs.pack(spark.createDataFrame([(TEXT,), (b"other",)], "body binary"), KEY).write.parquet(str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p"))
    bad = packed.withColumn("data", F.when(F.octet_length("data") > 20, F.concat(F.substring("data", 1, 5), F.lit(b"!"), F.expr("substring(data, 7)"))).otherwise(F.col("data")))
    assert codecs.scrub(bad, KEY).count() == 1
    assert codecs.unpack(bad, KEY, fail=False).where("body is null").count() == 1
    with pytest.raises(Exception, match="does not fit its MAC"):
        codecs.unpack(bad, KEY).collect()
    wrong = Key(KEY.key, b"?" * 32, KEY.id_key, 7)
    assert codecs.scrub(packed, wrong).count() == 2
    with pytest.raises(hashing.UnsupportedAlgorithm):
        codecs.compress(b"", "brotli")


GLOBS = [
    ("*.txt", ["a.txt", "a/b.txt"], ["a.txt.gz"]), ("a?c", ["abc", "a/c"], ["ac", "abbc"]), ("[!a]*", ["b"], ["a"]), ("[a-c]x", ["bx"], ["dx"]),
    ("{a,b*}.c", ["a.c", "bz.c"], ["c.c"]), ("**/x", ["a/b/x"], ["x"]), (r"\*", ["*"], ["a"]), ("a+(b)", ["a+(b)"], ["aab"]), ("", [""], ["a"]), ("[]]", ["]"], ["["]),
]


@pytest.mark.parametrize("glob, yes, no", GLOBS)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in [*yes, *no]], "p string")
    assert sorted(r.p for r in df.where(paths.glob_filter(F.col("p"), [glob])).collect()) == sorted(yes)
    assert sorted(r.p for r in df.where(paths.glob_filter(F.col("p"), [], [glob])).collect()) == sorted(no)
    assert df.where(paths.glob_filter(F.col("p"))).count() == len(yes) + len(no)
    assert df.where(paths.glob_filter(F.col("p"), [glob], ["*"])).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([(" \ta/b/c \n",)], "p string")
    r = df.select(paths.trimmed(F.col("p")).alias("t"), paths.parent(paths.trimmed(F.col("p"))).alias("u"), paths.ancestors(paths.trimmed(F.col("p"))).alias("a"), paths.namespace(F.array(F.lit("x"), F.lit("y"))).alias("n"), paths.namespace(F.array().cast("array<string>")).alias("root")).first()
    assert tuple(r) == ("a/b/c", "a/b", ["a", "a/b"], "x:y:", ":")
    t = spark.sql("select timestamp'2020-05-31 12:00:00' t").select(paths.rfc2822(F.col("t")).alias("a"), paths.rfc2822(F.col("t"), F.lit(-5400)).alias("b")).first()
    assert tuple(t) == ("Sun, 31 May 2020 12:00:00 +0000", "Sun, 31 May 2020 10:30:00 -0130")


def counting(n):
    return bytes(i % 251 for i in range(n))


@pytest.mark.parametrize(
    "n, digest",
    [
        (0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
        (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
        (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
        (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
        (2048, "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"),
        (31744, "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"),
        (102400, "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"),
    ],
)
def test_blake3_published_vectors(n, digest):
    assert blake.blake3([b"x", counting(n), b"y" * 5000])[1].hex() == digest


def test_keyed_published_vectors():
    key = b"whats the Elvish word for friend"
    assert blake.blake3([b"", counting(1)], key)[0].hex() == "92b2b75604ed3c761f9d6f62392c8a9227ad0ea3f09573e783f1498a4ed60d26"
    assert blake.blake3([counting(1)], key)[0].hex() == "6d7878dfff2f485635d39013278ae14f1454b8c0a3a2d34bc1ab38228a80c95b"
    want = "9d9461073e4eb640a255357b839f394b838c6ff57c9b686a3f76107c1066728f3c9956bd785cbc3bf79dc2ab578c5a0c063b9d9c405848de1dbe821cd05c940a"
    assert blake.blake2bp([b""], bytes(range(64)))[0].hex() == want


def test_blake2bp_root_without_key():
    """Without a key hashlib can compute the root too."""
    for n in (0, 1, 127, 128, 129, 512, 513, 1000, 5000):
        root = hashlib.blake2b(blake._leaves(counting(n), b""), digest_size=64, fanout=4, depth=2, inner_size=64, node_depth=1, last_node=True)
        assert blake.blake2bp([counting(n)])[0] == root.digest()


@pytest.mark.parametrize("algorithm", hashing.ALGORITHMS)
def test_mac_keeps_rows_and_nulls(spark, algorithm):
    values = [b"a", None, b"", b"z" * 3000, b"a"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary").select("i", hashing.mac(F.col("v"), b"k", algorithm).alias("m")).orderBy("i").collect()
    f = hashing.mac_function(algorithm, b"k")
    assert [None if r.m is None else bytes(r.m) for r in rows] == [None if v is None else f([v])[0] for v in values]


def test_key_streams_together():
    key, sizes = bytes(range(32)), [0, 1, 64, 65, 1000]
    ivs = [bytes([i] * 12) for i in range(len(sizes))]
    assert codecs.chacha20_streams(key, ivs, sizes) == [codecs.chacha20_stream(key, n, s) for n, s in zip(ivs, sizes, strict=True)]
    values = [b"x" * s for s in sizes]
    assert codecs.chacha20(key, codecs.chacha20(key, values, ivs), ivs) == values and codecs.chacha20(key, [], []) == []


@pytest.mark.parametrize("start", [0, 5, 2**64 - 2, 2**127 + 2**64 - 1, 2**128 - 1])
def test_counter_blocks_carry(start):
    want = b"".join(((start + i) % 2**128).to_bytes(16, "big") for i in range(3))
    assert codecs.counter_blocks(start.to_bytes(16, "big"), 40) == want and codecs.counter_blocks(start.to_bytes(16, "big"), 0) == b""


def python_stages(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ")


def test_values_are_worked_on_in_pieces():
    """A worker makes lists, results and output for a megabyte of a batch at a time, or for one longer value."""
    seen, values = [], [b"x" * 300_000, None, b"", b"y" * 3_000_000, *[b"z" * 1000] * 3000]
    grown = lambda xs: (seen.append(sum(map(len, xs))), [x * 2 for x in xs])[1]
    out = list(batches.each(grown, pa.array(values, pa.binary())))
    assert [x for part in out for x in part.to_pylist()] == [None if v is None else v * 2 for v in values]
    assert len(seen) > 4 and sorted(seen)[-2:] <= [batches.PIECE, 3_000_000]
    assert sorted(part.nbytes for part in out)[-2] < 2 * batches.PIECE
    assert list(batches.each(grown, pa.array([], pa.binary()))) == []


def test_aes_needs_one_python_stage(spark, tmp_path):
    """AES is the JVM's: of packing and unpacking, only compression is Python's, and nothing where there is none."""
    rows = spark.createDataFrame([(b"id", TEXT)], "chunk_id binary, body binary")
    assert python_stages(codecs.pack(rows, KEY)) == 1
    codecs.pack(rows, KEY).write.parquet(str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p"))
    assert python_stages(codecs.unpack(packed, KEY, [("zstd", "aes256ctr", "sha256")])) == 1
    iv = bytes(packed.first().iv)
    raw = codecs.compress(TEXT, "zstd")
    stream = bytes(one(spark, codecs.counter_blocks(iv, len(raw)), codecs._stream(F.col("v"), KEY.key)))
    assert len(iv) == 16 and bytes(packed.first().data) == codecs.xor(raw, stream)


@pytest.mark.parametrize("compression", ["none", "zstd"])
def test_unpacks_aes_of_any_vector(spark, compression):
    """Rows packed with vectors of sixteen random bytes are read as well, among new ones, whatever carries there are."""
    old = []
    for start in (0, 5, 2**32 - 1, 2**64 - 2, 2**96 - 1, 2**127 + 2**64 - 1, 2**128 - 1):
        for body in (b"", TEXT, bytes([start % 251]) * 33):
            iv, raw = start.to_bytes(16, "big"), codecs.compress(body, compression)
            stream = bytes(one(spark, codecs.counter_blocks(iv, len(raw)), codecs._stream(F.col("v"), KEY.key)))
            data = codecs.xor(raw, stream) if raw else b""
            old.append((str(len(old)).encode(), compression, 1, "aes256ctr", iv, "sha256", hmac.digest(KEY.hmac_key, data, "sha256"), data, body))
    schema = "chunk_id binary, compression string, level int, encryption string, iv binary, hmac string, mac binary, data binary, was binary"
    before = spark.createDataFrame(old, schema)
    new = codecs.pack(before.select("chunk_id", F.col("was").alias("body")), KEY, compression)
    got = codecs.unpack(before.drop("was").unionByName(new), KEY).select("chunk_id", "body").collect()
    assert sorted((bytes(r.chunk_id), bytes(r.body)) for r in got) == sorted([(r[0], r[-1]) for r in old] * 2)
