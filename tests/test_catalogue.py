"""Every registered query against its SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from siltbed import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        assert rows(got.toPandas()) == rows(con.sql(catalogue.ORACLES[name]).df())
    else:
        assert got.count() > 0


def test_names_are_registered_once():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_both_snapshots_hold_the_whole_table(spark, sf, monkeypatch):
    stored, real = [], catalogue.Repository.store
    monkeypatch.setattr(catalogue.Repository, "store", lambda self, files, *more: stored.append(files.count()) or real(self, files, *more))
    catalogue.QUERIES["repository_contents"](spark, sf)
    assert stored == [spark.read.parquet(f"{sf}/documents.parquet").count()] * 2


def test_every_setting_packs_every_object(spark, sf, tmp_path, monkeypatch):
    """All twelve pairs meet all rows; rows without an id, without a text, and repeated ones come back each."""
    data = [(1, "one"), (2, ""), (3, None), (None, "lost"), (None, "lost"), (4, "four")]
    spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    packed, real = [], catalogue.codecs.pack
    monkeypatch.setattr(catalogue.codecs, "pack", lambda o, key, c, n, e, *more: packed.append((c, e, o.count())) or real(o, key, c, n, e, *more))
    got = catalogue.QUERIES["pack_unpack_roundtrip"](spark, str(tmp_path)).toPandas()
    assert sorted(packed) == sorted((c, e, len(data)) for c in ("none", "zstd", "lz4", "xz") for e in ("none", "aes256ctr", "chacha20"))
    want = duckdb.sql(catalogue.ORACLES["pack_unpack_roundtrip"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).df()
    assert rows(got) == rows(want) and len(got) == len(data)


def test_each_compression_is_computed_once(spark, sf):
    """Three encryptions of a compression read one exchange of what it gave: two reuse it, for zstd, lz4 and xz."""
    got = catalogue.QUERIES["pack_unpack_roundtrip"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 6
