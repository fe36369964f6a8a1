"""All registered queries of the engine's own operators, with their SQL.

Objects are the documents: path source/lang/doc_id, content the UTF-8 bytes of the text. Binary values leave a query as
lowercase hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions import codecs, hashing, paths
from siltbed.functions.keys import Key
from siltbed.operators import dedup, index, listing, manifest, restore
from siltbed.operators.chunkers import BuzHash, FastCDC, StaticSize, chunk
from siltbed.plans.repository import Repository, Settings
from siltbed.plans.shared import shared_path
from siltbed.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ID_KEY, MAC_KEY = b"id-key", b"mac-key"
SLICE = StaticSize(256)
KEY = Key(bytes(range(32)), bytes(range(32, 64)), bytes(range(64, 96)), 7)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def objects(spark: SparkSession, d: str, *more: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), *more)


def slices(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return chunk(objects(spark, d, *more), SLICE).withColumn("chunk_id", F.sha2("body", 256))


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


O = "o AS (SELECT *, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, encode(text) AS b FROM documents)"
S = O + """, c AS (SELECT *, i AS ordinal, i * 256 AS start, b[i * 256 + 1 : i * 256 + 256] AS body
             FROM (SELECT *, unnest(range(0, (octet_length(b) + 255) // 256)) AS i FROM o)),
     s AS (SELECT *, octet_length(body) AS length, sha256(body) AS chunk_id FROM c)"""


def hmac_sql(key: bytes, value: str) -> str:
    pad = lambda c: bytes(k ^ c for k in key.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || {value})))"


# chunking


@query(f"WITH {S} SELECT count(*) AS n_slices, count(DISTINCT chunk_id) AS n_distinct, CAST(sum(length) AS BIGINT) AS bytes FROM s")
def static_chunk_stats(spark, d):
    once = slices(spark, d).groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    return once.agg(F.sum("n").alias("n_slices"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.col("length")).alias("bytes"))


@query(f"WITH {S} SELECT path, ordinal, start, length, chunk_id FROM s")
def static_chunk_rows(spark, d):
    return slices(spark, d).select("path", long("ordinal").alias("ordinal"), "start", "length", "chunk_id")


@query(f"""WITH {S} SELECT path, count(*) AS n_slices, max(length) AS longest, count(*) FILTER (length < 256) AS n_short,
           CAST(sum(length) AS BIGINT) AS bytes, bool_and(length = 256 OR start + length = octet_length(b)) AS short_only_last FROM s GROUP BY path""")
def static_chunk_properties(spark, d):
    s = chunk(objects(spark, d).withColumn("size", F.octet_length("content")), SLICE)
    return s.groupBy("path").agg(
        F.count("*").alias("n_slices"), F.max("length").alias("longest"), F.count_if(F.col("length") < 256).alias("n_short"),
        F.sum("length").alias("bytes"), F.bool_and((F.col("length") == 256) | (F.col("start") + F.col("length") == F.col("size"))).alias("short_only_last"),
    )


def _words(size: int = 256) -> np.ndarray:
    return np.array([int(hashlib.sha256(str(i).encode()).hexdigest()[:16], 16) for i in range(size)], np.uint64)


BUZ = BuzHash(0, window=48, mask_bits=6, table=_words())
GEAR = FastCDC(64, 256, 1024)


P = "p AS (SELECT path, i AS pos, i % 64 AS k, CAST(('0x' || hex(b[i + 1 : i + 1])) AS INTEGER) AS byte FROM (SELECT path, b, unnest(range(octet_length(b))) AS i FROM o))"
H = f"""t AS MATERIALIZED (SELECT i AS byte, CAST('0x' || substr(sha256(CAST(i AS VARCHAR)), 1, 16) AS UBIGINT) AS w FROM range(256) r(i)), {O}, {P},
     r AS (SELECT path, pos, k, CASE WHEN k = 0 THEN w ELSE (w >> k) | ((w & ((1::UBIGINT << k) - 1)) << (64 - k)) END AS x FROM p JOIN t USING (byte)),
     q AS (SELECT path, pos, k, bit_xor(x) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS q FROM r),
     z AS (SELECT path, pos, k, xor(q, coalesce(lag(q, 48) OVER (PARTITION BY path ORDER BY pos), 0::UBIGINT)) AS z FROM q),
     h AS (SELECT path, pos, CASE WHEN k = 0 THEN z ELSE ((z & ((1::UBIGINT << (64 - k)) - 1)) << k) | (z >> (64 - k)) END AS h FROM z)"""


@query(f"WITH {H} SELECT path, count(*) AS n_candidates, CAST(sum(pos) AS BIGINT) AS sum_pos FROM h WHERE h & 63 = 0 GROUP BY path")
def buzhash_candidates(spark, d):
    def run(batches):
        for batch in batches:
            found = [BUZ.candidates(x or b"") - 1 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([int(x.sum()) for x in found], pa.int64())], ["path", "n_candidates", "sum_pos"])

    return objects(spark, d).select("path", "content").mapInArrow(run, "path string, n_candidates long, sum_pos long").where("n_candidates > 0")


def _rolling(spark, d, chunker):
    return chunk(objects(spark, d), chunker).select("path", long("ordinal").alias("ordinal"), "start", "length", F.sha2("body", 256).alias("chunk_id"))


#: Cuts chosen one after another among the candidates (ends, exclusive) of each object.
CHUNKS = """cut(path, ordinal, start, stop) AS (SELECT path, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
        UNION ALL SELECT c.path, ordinal + 1, stop, least(size, {end}) FROM cut c JOIN found f ON f.path = c.path WHERE stop < size)
     SELECT path, ordinal, start, stop - start AS length, sha256(b[start + 1 : stop]) AS chunk_id FROM cut JOIN o USING (path) WHERE ordinal >= 0"""
AHEAD = "list_min(list_filter({list}, lambda x: x >= stop + {least}))"


@query(f"""WITH RECURSIVE {H}, c AS (SELECT path, list(pos + 1) AS ends FROM h WHERE h & 63 = 0 GROUP BY path),
     found AS MATERIALIZED (SELECT o.path, octet_length(b) AS size, coalesce(ends, []) AS ends FROM o LEFT JOIN c USING (path)),
     {CHUNKS.format(end=f"least(coalesce({AHEAD.format(list='ends', least=BUZ.least)}, stop + {BUZ.most}), stop + {BUZ.most})")}""")
def buzhash_chunks(spark, d):
    return _rolling(spark, d, BUZ)


def _doubled(w: int) -> str:
    """The Gear hash over 2w bytes from that over w."""
    lag = f"coalesce(lag(h, {w}) OVER (PARTITION BY path ORDER BY pos), 0::UBIGINT)"
    return f"SELECT path, pos, CAST((h::UHUGEINT + (({lag} & ((1::UBIGINT << {64 - w}) - 1)) << {w})::UHUGEINT) & 18446744073709551615::UHUGEINT AS UBIGINT) AS h"


_gear = "SELECT path, pos, w AS h FROM p JOIN t USING (byte)"
for _k in range(6):
    _gear = f"{_doubled(1 << _k)} FROM ({_gear})"


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT i AS byte, CAST('0x' || substr({hmac_sql((0x5117BED).to_bytes(8, "little"), "unhex(printf('%02x', i))")}, 1, 16) AS UBIGINT) AS w FROM range(256) r(i)), {O}, {P},
     h AS ({_gear}), c AS (SELECT path, list(pos + 1) AS loose, list(pos + 1) FILTER (h >> 55 = 0) AS strict FROM h WHERE h >> 57 = 0 GROUP BY path),
     found AS MATERIALIZED (SELECT o.path, octet_length(b) AS size, coalesce(loose, []) AS loose, coalesce(strict, []) AS strict FROM o LEFT JOIN c USING (path)),
     {CHUNKS.format(end=f"coalesce(list_min(list_filter(strict, lambda x: x >= stop + {GEAR.least} AND x < stop + {GEAR.average})), least(coalesce({AHEAD.format(list='loose', least=GEAR.average)}, stop + {GEAR.most}), stop + {GEAR.most}))")}""")
def gear_chunks(spark, d):
    return _rolling(spark, d, GEAR)


@query(f"WITH {O} SELECT path, octet_length(b) AS bytes, true AS kept FROM o WHERE octet_length(b) > 0")
def gear_chunks_properties(spark, d):
    """Total size of the slices, and whether the five properties hold for the object."""
    s = chunk(objects(spark, d).withColumn("size", F.octet_length("content").cast("long")), GEAR)
    g = s.groupBy("path").agg(F.sum("length").alias("bytes"), F.max("length").alias("longest"), F.max(F.when(F.col("length") < GEAR.least, F.col("start") + F.col("length"))).alias("short_end"), F.count_if(F.col("length") < GEAR.least).alias("n_short"), F.first("size").alias("size"))
    return g.select("path", "bytes", ((F.col("longest") <= GEAR.most) & (F.col("n_short") <= 1) & (F.coalesce("short_end", "size") == F.col("size")) & (F.col("bytes") == F.col("size"))).alias("kept"))


# ids and keys


@query(f"WITH {O} SELECT path, {hmac_sql(ID_KEY, 'b')} AS chunk_id FROM o")
def hmac_ids(spark, d):
    return objects(spark, d).select("path", hashing.hmac_sha256(F.col("content"), ID_KEY).alias("chunk_id"))


@query(f"""WITH {O}, i AS (SELECT path, b, b[1:32] || unhex(repeat('00', greatest(0, 32 - octet_length(b)))) AS id FROM o)
     SELECT path, lower(hex(id)) AS chunk_id, octet_length(b) >= 32 AND b[1:32] = id AS verified FROM i""")
def chunkid_pad_verify(spark, d):
    o = objects(spark, d).withColumn("id", hashing.chunk_id(F.col("content")))
    return o.select("path", F.lower(F.hex("id")).alias("chunk_id"), hashing.verify_id(F.col("content"), F.col("id")).alias("verified"))


@query("""WITH b AS (SELECT r_regionkey, r_name, unnest(range(length(r_name))) AS i FROM region)
     SELECT r_regionkey AS region_key, i % 3 AS key_no, string_agg(r_name[i + 1], '' ORDER BY i) AS dealt FROM b GROUP BY ALL""")
def key_deal_roundrobin(spark, d):
    """The names' characters dealt to three keys by the function that makes keys from bytes; they come to the driver, as key
    material does."""
    rows = []
    for r in table(spark, d, "region").select("r_regionkey", "r_name").collect():
        k = Key.from_bytes(r.r_name.encode(), 0)
        rows += [(r.r_regionkey, i, x.decode()) for i, x in enumerate((k.key, k.hmac_key, k.id_key)) if x]
    return spark.createDataFrame(rows, "region_key int, key_no long, dealt string")


@query()
def mac_algorithms(spark, d):
    """Keyed hashes of all objects by each algorithm."""
    o = objects(spark, d)
    return o.select("path", *[F.lower(F.hex(hashing.mac(F.col("content"), MAC_KEY, a))).alias(a) for a in hashing.ALGORITHMS])


# deduplication: documents with even ids are the snapshot that exists, odd ones arrive


def _parity(spark, d):
    s = slices(spark, d, "doc_id")
    return s.where("doc_id % 2 = 1"), s.where("doc_id % 2 = 0").select("chunk_id")


@query(f"WITH {S} SELECT chunk_id, any_value(length) AS length FROM s WHERE doc_id % 2 = 1 AND chunk_id NOT IN (SELECT chunk_id FROM s WHERE doc_id % 2 = 0) GROUP BY chunk_id")
def dedup_new_chunks(spark, d):
    new, known = _parity(spark, d)
    return dedup.new_chunks(new.select("chunk_id", "length"), known)


@query(f"WITH {S} SELECT path, ordinal, chunk_id IN (SELECT chunk_id FROM s WHERE doc_id % 2 = 0) AS present FROM s WHERE doc_id % 2 = 1")
def dedup_already_present(spark, d):
    new, known = _parity(spark, d)
    return dedup.already_present(new.select("path", long("ordinal").alias("ordinal"), "chunk_id"), known).drop("chunk_id")


@query(f"""WITH {S}, g AS (SELECT lang, chunk_id, count(*) AS n, any_value(length) AS length FROM s GROUP BY ALL)
     SELECT lang, CAST(sum(n) AS BIGINT) AS n_slices, count(*) AS n_distinct, CAST(sum(n * length) AS BIGINT) AS bytes, CAST(sum(length) AS BIGINT) AS distinct_bytes FROM g GROUP BY lang""")
def dedup_ratio_by_lang(spark, d):
    return dedup.ratio(slices(spark, d, "lang"), ["lang"])


@query(f"WITH {S} SELECT DISTINCT chunk_id FROM s WHERE doc_id % 2 = 1 AND chunk_id IN (SELECT chunk_id FROM s WHERE doc_id % 2 = 0)")
def cross_snapshot_shared(spark, d):
    return dedup.shared(*_parity(spark, d))


@query(f"WITH {O} SELECT sha256(b) AS object_hash, count(*) AS n_objects FROM o GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_objects(spark, d):
    return dedup.duplicate_objects(objects(spark, d).select(F.sha2("content", 256).alias("object_hash")))


@query("SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type <> 'click')")
def known_chunks_union(spark, d):
    e = table(spark, d, "events")
    return dedup.known_chunks(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), key="user_id")


@query("SELECT count(DISTINCT user_id) AS n_chunks FROM events")
def count_chunks(spark, d):
    return dedup.count_chunks(table(spark, d, "events"), "user_id")


@query("""SELECT user_id, event_id FROM events WHERE user_id = 0
     UNION ALL SELECT user_id, min(event_id) FROM events WHERE user_id <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL) GROUP BY user_id""")
def dedup_special_id(spark, d):
    """Customers' keys are known; rows with the special key are written whether they are known or not."""
    e = table(spark, d, "events").groupBy("user_id", F.when(F.col("user_id") == 0, F.col("event_id")).alias("_own")).agg(F.min("event_id").alias("event_id"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return dedup.new_chunks(e.select("user_id", "event_id"), known, "user_id", always=0)


# index log


def _replay(policy):
    def run(spark, d):
        e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
        return index.replay(e, "user_id", ("ts", "event_id"), policy).select("user_id", "event_id", "event_type", "value")

    return run


for _policy, _pick in (("last", "arg_max"), ("first", "arg_min")):
    QUERIES[f"index_replay_{_policy}"] = _replay(_policy)
    ORACLES[f"index_replay_{_policy}"] = f"SELECT user_id, {_pick}(event_id, (ts, event_id)) AS event_id, {_pick}(event_type, (ts, event_id)) AS event_type, {_pick}(value, (ts, event_id)) AS value FROM events GROUP BY user_id"


@query("""WITH r AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id), k AS (SELECT DISTINCT c_custkey AS user_id FROM customer)
     SELECT user_id, event_id FROM k JOIN r USING (user_id)""")
def index_lookup(spark, d):
    e = index.replay(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ("ts", "event_id"))
    return index.lookup(e, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).distinct(), "user_id").select("user_id", "event_id")


@query(f"""WITH {O}, r AS (SELECT doc_id, octet_length(b) AS length, coalesce(sum(octet_length(b)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
     g AS (SELECT doc_id, length, CAST(before // 65536 AS BIGINT) AS segment_id FROM r)
     SELECT doc_id, length, segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY doc_id) - 1 AS slot FROM g""")
def segment_packing(spark, d):
    o = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return index.pack_segments(o, 65_536, "doc_id").select("doc_id", "length", "segment_id", "slot")


@query("SELECT coalesce(max(event_id), -1) + 1 AS next_id FROM events")
def next_segment_id(spark, d):
    return index.next_id(table(spark, d, "events"), "event_id")


@query("SELECT DISTINCT p AS name FROM (SELECT regexp_extract(url, '[^/]*$') AS p FROM pages) WHERE regexp_full_match(p, '[0-9]+')")
def numeric_file_names(spark, d):
    return index.numeric_names(table(spark, d, "pages").select(F.regexp_extract("url", "[^/]*$", 0).alias("name"))).distinct()


@query("""SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def flatfile_headers(spark, d):
    """Locations (lines) with their headers (orders); a line without an order would be an error."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber")
    headers = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_custkey", "o_orderstatus")
    return index.with_headers(lines, headers).withColumnRenamed("chunk_id", "l_orderkey")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY l_orderkey)
     SELECT o_orderkey, o_orderdate, length, c_name FROM orders JOIN n ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""")
def flatfile_descriptors(spark, d):
    """Descriptors (orders) with lengths (their lines) by order, then with headers (customers)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("header"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("length"))
    headers = table(spark, d, "customer").select(F.col("c_custkey").alias("header"), "c_name")
    return index.with_headers(index.described(o, n, o.select("o_orderkey"), "o_orderkey"), headers, "header").select("o_orderkey", "o_orderdate", "length", "c_name")


# listings


@query(f"""WITH {O}, f AS (SELECT path, 'File' AS node_type, octet_length(b) AS total_length FROM o),
     g AS (SELECT DISTINCT source AS path, 'Directory' AS node_type, 0 AS total_length FROM o UNION SELECT DISTINCT source || '/' || lang, 'Directory', 0 FROM o),
     n AS (SELECT * FROM f UNION ALL SELECT * FROM g)
     SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent_path, node_type, CAST(total_length AS BIGINT) AS total_length FROM n""")
def listing_nodes(spark, d):
    return listing.nodes_from_paths(objects(spark, d).select("path", F.octet_length("content").alias("length"))).select("path", "parent_path", "node_type", "total_length")


def _tree(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey"), F.col("r_name").alias("path"), F.lit("").alias("parent_path"), F.lit("Directory").alias("node_type"))
    n = table(spark, d, "nation").join(r.select("r_regionkey", F.col("path").alias("up")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select("n_nationkey", F.concat_ws("/", "up", "n_name").alias("path"), F.col("up").alias("parent_path"), F.lit("Directory").alias("node_type"))
    c = table(spark, d, "customer").join(n.select("n_nationkey", F.col("path").alias("up")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.concat_ws("/", "up", "c_name").alias("path"), F.col("up").alias("parent_path"), F.lit("File").alias("node_type"))
    return r.drop("r_regionkey").unionByName(n.drop("n_nationkey")).unionByName(c)


T = """t AS (SELECT r_name AS path, '' AS parent_path, 'Directory' AS node_type FROM region
     UNION ALL SELECT r_name || '/' || n_name, r_name, 'Directory' FROM nation JOIN region ON n_regionkey = r_regionkey
     UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, r_name || '/' || n_name, 'File' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH RECURSIVE {T}, w(path, depth) AS (SELECT path, 0 FROM t WHERE parent_path = '' UNION ALL SELECT t.path, w.depth + 1 FROM w JOIN t ON t.parent_path = w.path)
     SELECT path, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY path""")
def listing_bfs(spark, d):
    return listing.bfs(_tree(spark, d)).select("path", long("depth").alias("depth"))


@query(f"""WITH RECURSIVE {T}, w(path, depth) AS (SELECT path, 0 FROM t WHERE parent_path = '' UNION ALL SELECT t.path, w.depth + 1 FROM w JOIN t ON t.parent_path = w.path)
     SELECT path, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY depth ORDER BY regexp_replace(path, '/?[^/]*$', ''), path) - 1 AS position FROM w""")
def listing_level_order(spark, d):
    return listing.level_order(_tree(spark, d)).select("path", long("depth").alias("depth"), long("position").alias("position"))


@query(f"WITH {T}, k AS (SELECT * FROM t WHERE path NOT LIKE 'A%' OR parent_path <> '') SELECT path FROM k WHERE parent_path <> '' AND parent_path NOT IN (SELECT path FROM k WHERE node_type = 'Directory')")
def listing_orphans(spark, d):
    """Nodes left without a parent once the top directories whose names begin with A are taken away."""
    return listing.orphans(_tree(spark, d).where("path NOT LIKE 'A%' OR parent_path <> ''")).select("path")


@query(f"WITH {T}, k AS (SELECT * FROM t WHERE path NOT LIKE 'A%' OR parent_path <> '') SELECT path FROM k WHERE parent_path = '' OR parent_path IN (SELECT path FROM k WHERE node_type = 'Directory')")
def listing_attached(spark, d):
    return listing.attached(_tree(spark, d).where("path NOT LIKE 'A%' OR parent_path <> ''")).select("path")


@query(f"WITH {T} SELECT parent_path AS path, string_agg(path, ',' ORDER BY path) AS children FROM t WHERE parent_path <> '' GROUP BY parent_path")
def listing_children(spark, d):
    return listing.children(_tree(spark, d)).select("path", F.array_join("children", ",").alias("children"))


# filters and selection

for _name, _in, _out, _test in (
    ("glob_include", ["*/fr/*", "*/de/*"], [], "(url GLOB '*/fr/*' OR url GLOB '*/de/*')"),
    ("glob_exclude", [], ["*page=[0-9]*"], "NOT url GLOB '*page=[0-9]*'"),
    ("glob_both", ["*/fr/*"], ["*page=[0-9]*"], "url GLOB '*/fr/*' AND NOT url GLOB '*page=[0-9]*'"),
):
    QUERIES[_name] = lambda spark, d, i=_in, o=_out: table(spark, d, "pages").select("page_id", "url").where(paths.glob_filter(F.col("url"), i, o))
    ORACLES[_name] = f"SELECT page_id, url FROM pages WHERE {_test}"


def _archives(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("tag"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("a"), (F.col("o_orderkey") % 7).cast("string")).alias("name"))


A = "a AS (SELECT o_orderkey AS tag, o_custkey AS repo, o_orderdate AS ts, 'a' || CAST(o_orderkey % 7 AS VARCHAR) AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS position FROM orders)"


@query(f"WITH {A} SELECT repo, position, tag, name FROM a")
def archives_newest_first(spark, d):
    return manifest.newest_first(_archives(spark, d), by=["repo"]).select("repo", "position", "tag", "name")


@query("SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey AS tag FROM orders")
def archives_in_insertion_order(spark, d):
    return manifest.insertion_order(_archives(spark, d), ("tag",), by=["repo"]).select("repo", "position", "tag")


@query("SELECT o_orderkey AS tag FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 3")
def archive_select_by_index(spark, d):
    return manifest.select_archive(_archives(spark, d), 3).select("tag")


@query("SELECT o_orderkey AS tag FROM orders WHERE o_orderkey % 7 = 5 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def archive_select_by_name(spark, d):
    return manifest.select_archive(_archives(spark, d), "a5").select("tag")


@query("SELECT o_orderkey AS tag, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS shown, strftime(o_orderdate + INTERVAL 2 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0200' AS shown_there FROM orders")
def rfc2822_times(spark, d):
    ts = F.to_timestamp("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("tag"), paths.rfc2822(ts).alias("shown"), paths.rfc2822(ts, F.lit(7200)).alias("shown_there"))


# the manifest: an order's parent is the customer's order before it


def _log(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("tag"), F.array_compact(F.array(F.lag("o_orderkey").over(w))).alias("previous_heads"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority"), "o_totalprice")


X = "x AS (SELECT o_orderkey AS tag, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, o_custkey AS repo, o_orderdate AS ts, o_orderpriority AS priority FROM orders)"


@query(f"WITH {X} SELECT tag, repo FROM x WHERE tag NOT IN (SELECT prev FROM x WHERE prev IS NOT NULL)")
def manifest_heads(spark, d):
    return manifest.heads(_log(spark, d)).select("tag", "repo")


@query(f"WITH {X}, k AS (SELECT * FROM x WHERE priority <> '1-URGENT') SELECT prev AS parent, tag AS child FROM k WHERE prev IS NOT NULL AND prev NOT IN (SELECT tag FROM k)")
def manifest_dangling(spark, d):
    """Records whose parent is gone once urgent orders are taken away."""
    return manifest.dangling(_log(spark, d).where("priority <> '1-URGENT'"))


@query(f"WITH RECURSIVE {X}, w(tag, depth) AS (SELECT tag, 0 FROM x WHERE prev IS NULL UNION ALL SELECT x.tag, w.depth + 1 FROM w JOIN x ON x.prev = w.tag) SELECT tag, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY tag")
def manifest_depth(spark, d):
    return manifest.depth(_log(spark, d)).select("tag", long("depth").alias("depth"))


@query(f"""SELECT o_orderkey, {hmac_sql(MAC_KEY, "encode(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus))")} AS tag, o_orderkey % 10 <> 0 AS valid FROM orders""")
def manifest_tags_verify(spark, d):
    """Every tenth record is altered after it got its tag."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    rows = manifest.tagged(table(spark, d, "orders").select(*cols), MAC_KEY, cols)
    rows = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")))
    return manifest.verify_tags(rows, MAC_KEY, cols).select("o_orderkey", "tag", "valid")


M = """n AS (SELECT o_orderkey AS tag, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
     e AS (SELECT b.tag, a.tag AS up FROM n b JOIN n a ON a.c = b.c AND a.i = b.i - 1
           UNION ALL SELECT b.tag, a.tag FROM n b JOIN n a ON b.i % 7 = 0 AND b.c % 5 <> 0 AND a.c = b.c - 1 AND a.i = b.i + 1)"""


@query(f"""WITH RECURSIVE {M}, w(tag, depth) AS (SELECT tag, 0 FROM n WHERE tag NOT IN (SELECT tag FROM e) UNION SELECT e.tag, depth + 1 FROM w JOIN e ON e.up = w.tag)
     SELECT tag, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY tag""")
def manifest_depth_merges(spark, d):
    """Every seventh order of a customer also follows the one before's order with the next number, so that logs merge."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("i"))
    up = o.select(F.col("o_orderkey").alias("up"), "c", "i")
    more = up.select(F.col("up").alias("merged"), (F.col("c") + 1).alias("c"), (F.col("i") - 1).alias("i")).where((F.col("i") % 7 == 0) & (F.col("c") % 5 != 0))
    log = o.join(up.select("up", "c", (F.col("i") + 1).alias("i")), ["c", "i"], "left").join(more, ["c", "i"], "left")
    return manifest.depth(log.select(F.col("o_orderkey").alias("tag"), F.array_compact(F.array("up", "merged")).alias("previous_heads"))).select("tag", "depth")


@query(f"WITH {X} SELECT max(ts) AS last_modification FROM x WHERE tag NOT IN (SELECT prev FROM x WHERE prev IS NOT NULL)")
def last_modification(spark, d):
    return manifest.last_modification(_log(spark, d))


@query("SELECT arg_max(o_orderdate, o_orderkey) AS last_modification FROM orders")
def last_inserted(spark, d):
    return manifest.last_inserted(_log(spark, d), order=("tag",))


@query("SELECT count(*) AS n_archives FROM orders")
def archive_count(spark, d):
    return _archives(spark, d).agg(F.count("*").alias("n_archives"))


# extents, holes, reassembly


@query(f"WITH {O} SELECT path, CASE WHEN octet_length(b) > 0 THEN CAST(0 AS BIGINT) END AS first_byte, CASE WHEN octet_length(b) > 0 THEN octet_length(b) - 1 END AS last_byte FROM o")
def extents_of_objects(spark, d):
    e = objects(spark, d).select("path", listing.extents_of(F.octet_length("content")).alias("e"))
    return e.select("path", F.col("e")[0]["start"].alias("first_byte"), F.col("e")[0]["end"].alias("last_byte"))


@query(f"""WITH {O}, e AS (SELECT *, octet_length(b) // 4 AS lo, octet_length(b) // 2 AS hi FROM o WHERE octet_length(b) > 0)
     SELECT path, CAST(hi - lo + 1 AS BIGINT) AS bytes, sha256(b[lo + 1 : hi + 1]) AS part_hash FROM e""")
def extent_range_fetch(spark, d):
    """The bytes of each object from a quarter to the half, out of its slices."""
    s = slices(spark, d)
    e = objects(spark, d).where(F.octet_length("content") > 0).select("path", F.lit(0).alias("extent_no"), long(F.floor(F.octet_length("content") / 4)).alias("start"), long(F.floor(F.octet_length("content") / 2)).alias("end"))
    parts = restore.range_fetch(s, e)
    g = parts.groupBy("path").agg(F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.struct("start", F.hex("body").alias("h")))).alias("p"))
    return g.select("path", "bytes", F.sha2(F.unhex(F.array_join("p.h", "")), 256).alias("part_hash"))


def _sparse(spark, d):
    """Lines of an order are extents: as long as their quantity, with holes of three times the line number before."""
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = table(spark, d, "lineitem").select("l_orderkey", *tie, F.col("l_quantity").cast("long").alias("length"))
    w = Window.partitionBy("l_orderkey").orderBy(*tie, "length").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("length") + 3 * F.col("l_linenumber")).over(w)
    return li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), (end - F.col("length")).alias("start"), "length")


L = "l AS (SELECT l_orderkey AS path, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS length, CAST(sum(CAST(l_quantity AS BIGINT) + 3 * l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) - CAST(l_quantity AS BIGINT) AS start FROM lineitem)"


@query(f"WITH {L} SELECT path, line, CAST(start - coalesce(lag(start + length) OVER (PARTITION BY path ORDER BY start), 0) AS BIGINT) AS gap FROM l")
def hole_gaps(spark, d):
    return restore.gaps(_sparse(spark, d)).select("path", "line", "gap")


@query(f"WITH {L} SELECT path, max(start + length) AS total_length, CAST(sum(length) AS BIGINT) AS total_size FROM l GROUP BY path")
def sparse_sizes(spark, d):
    return restore.sparse_sizes(_sparse(spark, d).select("path", "start", (F.col("start") + F.col("length") - 1).alias("end")))


@query(f"""WITH {L}, p AS (SELECT path, start, repeat('00', CAST(start - coalesce(lag(start + length) OVER (PARTITION BY path ORDER BY start), 0) AS BIGINT)) || repeat(hex(encode(chr(CAST(64 + line AS INTEGER)))), length) AS h FROM l)
     SELECT path, sha256(unhex(string_agg(h, '' ORDER BY start))) AS content_hash FROM p GROUP BY path""")
def sparse_reassembly(spark, d):
    s = _sparse(spark, d).withColumn("body", F.encode(F.repeat(F.char(F.col("line") + 64), F.col("length").cast("int")), "UTF-8"))
    return restore.reassemble(s).select("path", F.sha2("content", 256).alias("content_hash"))


@query(f"WITH {O} SELECT path, sha256(b) AS content_hash FROM o WHERE octet_length(b) > 0")
def reassemble_roundtrip(spark, d):
    return restore.reassemble(slices(spark, d)).select("path", F.sha2("content", 256).alias("content_hash"))


@query("SELECT conv_id, turn, role || ':' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS object_key FROM conversations")
def namespace_keys(spark, d):
    c = table(spark, d, "conversations")
    ns = F.array_append(F.array("role"), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", paths.object_key(ns, F.concat(F.lit(" \t"), F.col("turn").cast("string"), F.lit("\n "))).alias("object_key"))


# packing

#: Every pair of compression and encryption.
SETTINGS = [(c, e) for c in codecs.COMPRESSIONS for e in codecs.ENCRYPTIONS]


@query("SELECT CAST(doc_id AS VARCHAR) AS object, sha256(encode(text)) AS plain_hash FROM documents")
def pack_unpack_roundtrip(spark, d):
    """All objects are packed and unpacked with each setting; a compression is computed once for its encryptions. An object comes back as often as it is there if all settings
    give the same bytes; else the query fails."""
    o = objects(spark, d, "doc_id").select(F.col("doc_id").cast("string").cast("binary").alias("chunk_id"), F.col("content").alias("body"))
    parts = []
    ready = {c: codecs.pressed(o, KEY, c) for c in codecs.COMPRESSIONS}
    for i, (c, e) in enumerate(SETTINGS):
        back = codecs.unpack(codecs.pack(ready[c], KEY, c, 1, e), KEY, [(c, e, "sha256")])
        parts.append(back.select(F.col("chunk_id").cast("string").alias("object"), F.sha2("body", 256).alias("plain_hash"), F.lit(i).alias("setting")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = [F.count(F.when(F.col("setting") == i, 1)) for i in range(len(SETTINGS))]
    found = out.groupBy("object", "plain_hash").agg(F.array(*n).alias("n"))
    wrong = F.raise_error(F.lit("settings give different bytes")).cast("array<bigint>")
    times = F.when(F.array_min("n") == F.array_max("n"), F.array_repeat(F.element_at("n", 1), F.element_at("n", 1).cast("int"))).otherwise(wrong)
    return found.select("object", "plain_hash", F.explode(times)).select("object", "plain_hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS object, sha256(encode(text)) AS plain_hash FROM documents")
def split_unsplit(spark, d):
    """Packed objects, parted into headers and bodies, put together again and unpacked."""
    o = objects(spark, d, "doc_id").select(F.col("doc_id").cast("string").cast("binary").alias("chunk_id"), F.col("content").alias("body"))
    packed = codecs.pack(o, KEY, "zstd", 1, "none")
    back = codecs.unpack(codecs.unsplit(*codecs.split(packed)), KEY, [("zstd", "none", "sha256")])
    return back.select(F.col("chunk_id").cast("string").alias("object"), F.sha2("body", 256).alias("plain_hash"))


@query("SELECT CAST(doc_id AS VARCHAR) AS damaged FROM documents WHERE doc_id % 9 = 0 AND octet_length(encode(text)) > 0")
def scrub_tampered(spark, d):
    """One byte of the data of every ninth object is altered."""
    p = objects(spark, d, "doc_id").select(F.col("doc_id").cast("string").cast("binary").alias("chunk_id"), F.col("content").alias("body"))
    p = codecs.pack(p, KEY, "none", 0, "none")
    flipped = F.unhex(F.concat(F.when(F.substr(F.hex("data"), F.lit(1), F.lit(1)) == "0", "1").otherwise("0"), F.substr(F.hex("data"), F.lit(2))))
    bad = (F.col("chunk_id").cast("string").cast("long") % 9 == 0) & (F.octet_length("data") > 0)
    return codecs.scrub(p.withColumn("data", F.when(bad, flipped).otherwise(F.col("data"))), KEY).select(F.col("chunk_id").cast("string").alias("damaged"))


@query()
def compression_ratio(spark, d):
    """Bytes of all objects before and after each compression."""
    o = objects(spark, d).select("content")
    sizes = o.select(F.octet_length("content").alias("none"), *[F.octet_length(codecs.compressed(F.col("content"), k, 1)).alias(k) for k in codecs.COMPRESSIONS[1:]])
    return sizes.agg(*[F.sum(k).alias(f"bytes_{k}") for k in codecs.COMPRESSIONS])


# composed


@query("SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path FROM documents WHERE concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) GLOB 'src1*/en/*' AND NOT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) GLOB '*[05]'")
def contents_query(spark, d):
    nodes = listing.nodes_from_paths(objects(spark, d).select("path", F.octet_length("content").alias("length")))
    return nodes.where(F.col("node_type") == "File").where(paths.glob_filter(F.col("path"), ["src1*/en/*"], ["*[05]"])).select("path")


@query(f"WITH {A} SELECT repo, count(*) AS n_archives, max(ts) AS last_modification, arg_min(tag, position) AS newest FROM a GROUP BY repo")
def list_query(spark, d):
    a = manifest.newest_first(_archives(spark, d), by=["repo"])
    return a.groupBy("repo").agg(F.count("*").alias("n_archives"), F.max("ts").alias("last_modification"), F.min_by("tag", "position").alias("newest"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'third'), (1, 'second'), (2, 'first')) t(position, name)")
def repository_list(spark, d):
    """Three snapshots of the regions, listed by the repository."""
    repo = Repository.create(spark, shared_path(spark, "repository"), "password", Settings.lightweight())
    regions = table(spark, d, "region").select(F.col("r_name").alias("path"), F.encode("r_name", "UTF-8").alias("content"))
    for name in ("first", "second", "third"):
        repo.store(regions, name, SLICE)
    return repo.list().select("position", "name")


@query(f"WITH {O} SELECT path, sha256(b) AS content_hash FROM o")
def repository_roundtrip(spark, d):
    """All objects through a repository: create, store, open again, extract."""
    base = shared_path(spark, "repository")
    Repository.create(spark, base, "password").store(objects(spark, d), "all", FastCDC(256, 1024, 4096))
    return Repository.open(spark, base, "password").extract("all").select("path", F.sha2("content", 256).alias("content_hash"))


@query(f"WITH {O}, k AS (SELECT path, octet_length(b) AS n FROM o WHERE path GLOB 'src1*' AND NOT path GLOB '*/de/*') SELECT path, n AS total_length FROM k")
def repository_contents(spark, d):
    """Two snapshots that share their slices; the older one is chosen by position and filtered by globs."""
    base = shared_path(spark, "repository")
    repo = Repository.create(spark, base, "password", Settings.lightweight())
    repo.store(objects(spark, d), "first", SLICE)
    repo.store(objects(spark, d), "second", SLICE)
    return repo.contents(1, ["src1*"], ["*/de/*"]).where("node_type = 'File'").select("path", "total_length")


@query(f"WITH {S}, u AS (SELECT chunk_id, any_value(length) AS length FROM s GROUP BY chunk_id) SELECT count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS bytes FROM u")
def streaming_ingest(spark, d):
    """Objects that arrive as a stream leave each distinct slice once."""
    base = shared_path(spark, "repository")
    repo = Repository.create(spark, base, "password", Settings("none", 0, "none"))
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")  # a glob, so that one file will do
    stream = stream.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    ingest(stream, repo, f"{base}/stream", SLICE).awaitTermination()
    return repo.chunks.agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("data").cast("long")).alias("bytes"))
