import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.operators.chunkers import BuzHash, FastCDC, StaticSize, chunk, derived_table

CHUNKERS = [(StaticSize(100), 100, 100), (BuzHash(5, 31, 6), 16, 256), (FastCDC(32, 128, 512), 32, 512)]


def parts(chunker, raw):
    ends = chunker.cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@pytest.mark.parametrize("chunker, least, most", CHUNKERS)
@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 2**32), size=st.integers(0, 5000), letters=st.sampled_from([1, 2, 16, 256]))
def test_five_properties(chunker, least, most, seed, size, letters):
    raw = np.random.default_rng(seed).integers(0, letters, size, np.uint8).tobytes()
    got = parts(chunker, raw)
    assert b"".join(got) == raw and got == parts(chunker, raw)
    assert bool(got) == bool(raw)
    assert all(0 < len(p) <= most for p in got)
    assert all(len(p) >= least for p in got[:-1])


def rotl(x, n):
    n %= 64
    return ((x << n) | (x >> (64 - n))) & (2**64 - 1)


def test_buzhash_is_a_rolling_hash():
    """The closed form against the byte-by-byte recurrence, and the cuts against the sequential rule."""
    c, raw = BuzHash(9, 31, 6), np.random.default_rng(1).integers(0, 256, 3000, np.uint8).tobytes()
    table, h, want, cut, start = [int(x) for x in derived_table(9)], 0, [], [], 0
    for i, b in enumerate(raw):
        h = rotl(h, 1) ^ table[b]
        if i >= 31:
            h ^= rotl(table[raw[i - 31]], 31)
        want.append(h)
        n = i + 1 - start
        if (n >= c.least and h & 63 == 0) or n == c.most or i + 1 == len(raw):
            cut.append(i + 1)
            start = i + 1
    assert c.hashes(raw).tolist() == want
    assert c.cuts(raw) == cut


def test_gear_is_a_sum_of_64_bytes():
    c, raw = FastCDC(), np.random.default_rng(2).integers(0, 256, 500, np.uint8).tobytes()
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(c.words[b])) % 2**64
        want.append(h)
    assert c.hashes(raw).tolist() == want


def test_shifted_copies_share_slices():
    c, raw = FastCDC(32, 128, 512), np.random.default_rng(3).integers(0, 256, 20_000, np.uint8).tobytes()
    a, b = set(parts(c, raw)), set(parts(c, b"shift" + raw))
    assert len(a & b) > 0.9 * len(a)


@pytest.mark.parametrize("chunker, least, most", CHUNKERS)
def test_frame(spark, chunker, least, most):
    contents = [b"", None, b"x", bytes(range(256)) * 3, b"a" * 1000, "ünïcödé ".encode() * 100, b"y" * 200, b"z" * 101]
    df = spark.createDataFrame([(str(i), c, i) for i, c in enumerate(contents)], "path string, content binary, start_no int")
    got = chunk(df, chunker).collect()
    for i, raw in enumerate(contents):
        mine = sorted((r.ordinal, r.start, r.length, bytes(r.body)) for r in got if r.path == str(i))
        assert b"".join(m[3] for m in mine) == (raw or b"")
        assert [m[3] for m in mine] == parts(chunker, raw or b"")
        assert [m[1] for m in mine] == [sum(x[2] for x in mine[:k]) for k in range(len(mine))]
    assert chunk(df.limit(0), chunker).count() == 0


def test_static_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", b"x" * 500)], "path string, content binary")
    plan = chunk(df, StaticSize(256)).select(F.sha2("body", 256))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
