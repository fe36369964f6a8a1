"""Each operator against brute force, and the defined results of odd input."""

import hashlib

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from siltbed.llm import bpe, chat_format, decontamination, language_id, line_dedup, quality, queries, secret_scan, simhash, topk, toxicity

RANKS = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LONG = ("a very long text, with many words 0123456789abcdef\n" * 6000) + "x" * 20_000
ODD = [(1, None), (2, ""), (3, LONG), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "  \t\n"), (6, "ünï ÇÖDÉ 中文 🎉\x00"), (7, "One\nONE \n one"), (8, "12 34 !!")]
CLASH = "doc_id long, text string, score string, ids string, n_lines string, _k string, _gone string, _h string, lang_pred string, items string, Predicted string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, *["mine"] * 9) for d, t in ODD], CLASH)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by doc_id").fetchall()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def kept_columns(df, out):
    """Columns that clash keep their names and values."""
    assert out.columns[: len(df.columns)] == df.columns
    assert all(set(r) == {"mine"} for r in out.select("ids", "_k", "_gone", "_h").collect())
    return out.collect()


# 1


def test_toxicity(spark, sf, odd):
    got = queries.op1_toxicity(spark, sf).toPandas()
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    assert all(0 <= s <= 1 for s in got.score) and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))
    known = got[got.doc_id.isin(labels)]
    y = known.doc_id.map(labels)
    assert (known.score[y == 1].mean() - known.score[y == 0].mean()) > 0.2
    docs = spark.createDataFrame([(i, f"you are {'an idiot moron' if i % 4 == 0 else 'a kind person'} number {i % 37} of the day") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")))
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in toxicity.score(docs, model).collect())
    out = kept_columns(odd, toxicity.score(odd, model))
    assert len(out) == len(ODD) and out[0]["_score"] == out[1]["_score"] and out[0]["_predicted"] == 0
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_keeps_the_odds_of_all_labels(spark, monkeypatch):
    """One in three documents with the word is toxic; a sample with other odds than all labels does not change that."""
    kind = lambda i: "an idiot" if i % 10 == 0 or i % 10 in (3, 7) else "a friend"
    docs = spark.createDataFrame([(i, f"you are {kind(i)} number {i % 37} of the day") for i in range(1200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    unclear = docs.where("text like '%idiot%'")
    mean = lambda: toxicity.score(unclear, toxicity.fit(docs, labels)).agg(F.avg("score"), F.avg("predicted")).first()
    whole = mean()
    assert abs(whole[0] - 1 / 3) < 0.05
    for toxic, ordinary in ((120, 120), (60, 120), (30, 400)):
        monkeypatch.setattr(toxicity, "TOXIC_DOCS", toxic)
        monkeypatch.setattr(toxicity, "ORDINARY_DOCS", ordinary)
        capped = mean()
        assert abs(capped[0] - whole[0]) < 0.12 and capped[1] < 0.1
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert one.prior > 0.99 and not one.trained


def test_kneser_ney_probabilities():
    """Every stored ratio against interpolated Kneser-Ney written out, whose probabilities sum to one."""
    texts = [[b"the cat sat on the mat, the end 42", b"a cat"], [b"the rat bit the idiot!", b"", b"idiot \xc3\xa9"]]
    kn = toxicity.KneserNey(*texts)
    size, order, d, table = toxicity.SIZE, toxicity.ORDER, toxicity.DISCOUNT, toxicity.symbol_table()
    streams = [tuple(table[np.frombuffer(b"    " + b"    ".join(ts) + b"    ", np.uint8)].tolist()) for ts in texts]
    runs = lambda s, n: [s[i : i + n] for i in range(len(s) - n + 1)]

    def counts(c, k):
        """Of runs of k + 1 symbols: how often they occur, or for short ones after how many symbols; the shortest shared."""
        if k == order:
            return Counter(runs(streams[c], k + 1))
        classes = (0, 1) if k < toxicity.SHARED_BELOW else (c,)
        return Counter(x[1:] for x in {x for i in classes for x in runs(streams[i], k + 2)})

    every = [[counts(c, k) for k in range(order + 1)] for c in (0, 1)]

    def p(c, context, s):
        if context is None:
            return 1 / size
        n = {x[-1]: v for x, v in every[c][len(context)].items() if x[:-1] == context}
        below = p(c, context[1:] if context else None, s)
        total = sum(n.values())
        return max(n.get(s, 0) - d, 0) / total + d * len(n) / total * below if total else below

    ratio, seen = kn.tables.values.reshape(-1, size), set()
    for context in {x[:order] for s in streams for x in runs(s, order + 1)} | {(1, 2, 3, 4), (0, 0, 20, 8)}:
        both = np.array([[p(c, context, s) for s in range(size)] for c in (0, 1)])
        assert np.allclose(both.sum(1), 1)
        at = int(kn.tables.index[sum(x * size ** (order - 1 - i) for i, x in enumerate(context))])
        seen.add(at)
        assert np.allclose(ratio[at], np.log(both[1] / both[0]), atol=1e-4)
    assert len(seen) > 50


# 2


def test_bpe(spark, sf, docs, odd):
    got = {r.doc_id: r for r in queries.op2_bpe(spark, sf).collect()}
    for d, text, _ in docs:
        ids = ENC.encode_ordinary(text)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), bpe.ids_digest(ids), hashlib.sha256(text.encode()).hexdigest())
    out = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN, "_ids")
    for r, (_, text) in zip(kept_columns(odd, out), ODD, strict=True):
        assert list(r["_ids"]) == ENC.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    assert bpe.digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text_leaf, piece_leaf", [(1, 1), (2, 3), (5, 8), (40, 16)])
def test_bpe_tree_joins(docs, text_leaf, piece_leaf):
    """Leaves far smaller than tokens: every result is made by joins."""
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN, text_leaf, piece_leaf), random.Random(text_leaf)
    parts = ["'", "'r", "e", "l", "ll", " ", "  ", "\n", "\t", "the", "é", "1", "23", "!", "...", "中", "🎉", "\x1c", "\x00", "ab" * 20, "%%%", " \n ", "　", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)]
    texts += [re.sub(r"\W", "", docs[i][1])[:400] for i in range(60)] + ["a" * 999, "ab" * 500]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ENC.encode_ordinary(t)
        assert codec.decode(ids, 3) == t.encode()


# 3


def brute_ids(text):
    """Byte-level BPE without the library: the pair of the least rank, the leftmost of ties, until none is left."""
    ids = []
    for piece in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids += [RANKS[p] for p in parts]
    return ids


def test_bpe_joins_ordinary_documents(docs, monkeypatch):
    """With the leaves of the query nearly all documents are made by joins, and the ids are those of plain merging."""
    joined, real = set(), bpe.Codec.window
    monkeypatch.setattr(bpe.Codec, "window", lambda self, text, *at: joined.add(text) or real(self, text, *at))
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = [t for _, t, _ in docs if t]
    for t in texts[:150]:
        assert codec.encode(t) == (brute_ids(t) if len(t) < 5000 else ENC.encode_ordinary(t))
    assert len(joined) > 0.85 * len(set(texts[:150]))


def brute_lines(texts, least=10, keep_one=False):
    """keep_one: texts are in the order of their keys, the first that holds a line keeps it."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n, first = Counter(), {}
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            n[k] += 1
            first.setdefault(k, i)
    stays = lambda i, k: n[k] < least or (keep_one and first[k] == i)
    return [("\n".join(x for x in (t or "").split("\n") if stays(i, key(x))), len((t or "").split("\n"))) for i, t in enumerate(texts)]


def test_line_dedup(spark, odd):
    rng = random.Random(1)
    texts = ["\n".join(rng.choices(["", " Common ", "common", f"line {i % 25}", f"own {i}", "É", "é", "tail\r"], k=rng.randint(1, 9))) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_frequent_lines(df).collect()}
    for i, (text, n) in enumerate(brute_lines(texts)):
        assert got[i] == (text, n, n - len(text.split("\n")) if text or got[i][2] < n else n)
    kept = {r.doc_id: r.text for r in line_dedup.drop_frequent_lines(df.repartition(3), keep_one=True).collect()}
    assert kept == {i: t for i, (t, _) in enumerate(brute_lines(texts, keep_one=True))} != {i: t for i, (t, *_) in got.items()}
    once = {(r.doc_id, r.text) for r in line_dedup.drop_frequent_lines(odd, min_docs=2, keep_one=True).collect()}
    assert {(4, "one"), (None, ""), (7, "")} <= once  # of 4, 7 and a null key the least keeps the line, in both its rows
    nulls = spark.createDataFrame([(None, "a\nb"), (None, "a\nc"), (None, None)], "doc_id long, text string")
    assert {r.text for r in line_dedup.drop_frequent_lines(nulls, min_docs=2, keep_one=True).collect()} == {"a\nb", "a\nc", ""}
    out = kept_columns(odd, line_dedup.drop_frequent_lines(odd, min_docs=2))
    by = {(r.doc_id, r.text): r for r in out}
    assert len(out) == len(ODD) and by[(4, "")].n_dropped == 1  # `one` is in documents 4, 7 and one without a key
    assert by[(1, "")]["_n_lines"] == 1 and by[(7, "")]["_n_lines"] == 3 and by[(8, "12 34 !!")].n_dropped == 0
    once = line_dedup.drop_frequent_lines(odd.where("doc_id = 4"), min_docs=2).collect()
    assert [r.text for r in once] == ["one", "one"]  # a repeated row is one document
    assert line_dedup.drop_frequent_lines(odd.limit(0)).count() == 0


def test_line_dedup_stays_in_the_jvm(spark, odd):
    plan = line_dedup.drop_frequent_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4


def brute_top(vectors, k):
    v = {i: np.floor(64 * np.array(x, float)).astype(int) for i, x in vectors if x is not None and i is not None and all(c is not None and np.isfinite(c) for c in x)}
    dot = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b, strict=False)))
    return {q: sorted(((-dot(v[q], x), i) for i, x in v.items() if i != q))[:k] for q in v if q % 20 == 0}


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)] + [(i, [0.5] * 16) for i in range(300, 330)]
    vectors += [(340, None), (360, [1.0, None] + [0.0] * 14), (380, [float("nan")] * 16), (400, [float("inf")] * 16), (420, []), (440, [3.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 20 = 0"), 7).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    want = brute_top(vectors, 7)
    assert {q: [(a, b) for _, a, b in sorted(x)] for q, x in got.items()} == want
    assert all([r for r, _, _ in sorted(x)] == list(range(1, 8)) for x in got.values())
    few = df.where("vec_id in (0, 1, 20)")
    assert topk.search(few, few.where("vec_id % 20 = 0"), 7).count() == 4
    assert topk.search(df, df.limit(0)).count() == 0 and topk.search(df.limit(0), df.where("vec_id = 0")).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.search(df, df, 5).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 70)
    assert sorted(map(tuple, topk.search(df, df, 5).collect())) == want
    # repeated query ids, with equal and with other vectors, lie in different blocks and are ranked together
    base = [(i, rng.integers(-5, 5, 8).astype(float).tolist()) for i in range(30)]
    twice = spark.createDataFrame([*base[:10], (0, base[0][1]), (4, base[20][1]), *base[:3]], df.schema).coalesce(1)
    rows_ = spark.createDataFrame([*base, base[5]], df.schema)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    con = duckdb.connect()
    con.sql("create table q as select * from (values " + ", ".join(f"({i}, {v})" for i, v in map(tuple, twice.collect())) + ") t(id, v)")
    con.sql("create table c as select * from (values " + ", ".join(f"({i}, {v})" for i, v in map(tuple, rows_.collect())) + ") t(id, v)")
    sql = """with s as (select q.id a, c.id b, list_inner_product(q.v, c.v)::bigint s from q join c on q.id <> c.id)
             select a, r, b, s from (select *, row_number() over (partition by a order by s desc, b) r from s) where r <= 5"""
    assert sorted(map(tuple, topk.search(rows_, twice, 5, 1.0).collect())) == sorted(con.sql(sql).fetchall())


def test_topk_prunes():
    """Vectors with a few large components: bounds leave most products out, and the result is that of a plain scan."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 64)) * np.where(np.arange(64) < 8, 60, 2))
    s = topk.Search(np.arange(20), x[:20], 10)
    for at in range(0, 3000, 500):
        s.add(np.arange(at, at + 500), x[at : at + 500])
    for i in range(20):
        score = x @ x[i]
        assert s.best[i][1].tolist() == sorted((j for j in range(3000) if j != i), key=lambda j: (-score[j], j))[:10]
    assert s.computed < 0.7 * s.plain


def test_topk_beyond_doubles():
    s = topk.Search(np.array([0]), np.array([[2.0**30, 1.0]]), 2)
    s.add(np.array([1, 2, 3]), np.array([[2.0**31, 1.0], [2.0**31, 2.0], [0.0, 0.0]]))
    assert [int(x) for x in s.best[0][0]] == [2**61 + 2, 2**61 + 1]


# 5


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    ids, root = list(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op5_simhash(spark, sf).collect()}
    fps = {d: brute_fingerprint(t) for d, t, _ in docs}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(fps)


def test_simhash_links_every_pair(spark):
    """Chains and dense clouds of fingerprints, against all pairs."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for start in list(fps)[:40]:
        for _ in range(12):
            start ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(start)
    cloud = rng.getrandbits(64)
    fps |= {cloud ^ sum(1 << b for b in range(10) if rng.random() < 0.5) for _ in range(400)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "_fp long").repartition(3)
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    comp = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components({f: f & (2**64 - 1) for f in signed})
    assert comp == {f: want[f] for f in signed if f in comp} and {f for p in got for f in p} == set(comp)


def test_components_of_long_chains(spark, monkeypatch):
    """Paths of any order settle in few rounds: the worst order for spreading labels, random orders, and a cycle."""
    rng, n = random.Random(3), 400
    orders = [[0, *range(n - 1, 0, -1)], rng.sample(range(n), n), [*range(n)], [5, 3, 4, 5]]
    edges = [(x + k * n - n, y + k * n - n) for k, order in enumerate(orders) for x, y in zip(order, order[1:], strict=False)]
    calls, real = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: calls.append(1) or real(df))
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {v + k * n - n: min(order) + k * n - n for k, order in enumerate(orders) for v in order}
    assert got == want and len(calls) <= 2 + 2 * 15
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_input(spark, odd):
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert out[(1, "0" * 16)] == out[(2, "0" * 16)] == out[(5, "0" * 16)] == out[(None, "0" * 16)] == 1
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 2, None: 2, 6: 1, 7: 1, 8: 1})


# 6


def test_chat_layouts(spark):
    layouts = {
        '{"prompt": "p", "completion": "c"}': [("user", "p"), ("assistant", "c")],
        '{"completion": "c", "prompt": null}': [("user", ""), ("assistant", "c")],
        '{"instruction": "i", "input": "x", "output": "o"}': [("user", "i\nx"), ("assistant", "o")],
        '{"question": "q", "answer": 4.5}': [("user", "q"), ("assistant", "4.5")],
        '{"messages": [{"role": "system", "content": "s"}, {"content": "u", "role": "user"}, {"role": "assistant", "content": "a"}]}': [("system", "s"), ("user", "u"), ("assistant", "a")],
        '{"system": "s", "messages": [{"role": "user", "content": "u"}]}': [("system", "s"), ("user", "u")],
        '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}': [("user", "u"), ("assistant", "a")],
        '{"something": "else"}': None,
        "[1, 2]": None,
    }
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(layouts)], "conv_id long, turn long, x string").withColumn("record", F.parse_json("x"))
    out = chat_format.format_chats(df)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {i: want for i, want in enumerate(layouts.values()) if want}
    with_null = df.union(spark.createDataFrame([(99, 0, None)], "conv_id long, turn long, x string").withColumn("record", F.parse_json("x")))
    lost = {r.conv_id: r["_layout"] for r in chat_format.rejected(with_null.withColumn("layout", F.lit("mine"))).collect()}
    assert lost[7] == "OBJECT<something>" and lost.keys() == {7, 8}
    assert lost.keys() | got.keys() == set(range(len(layouts))) and not lost.keys() & got.keys()
    assert chat_format.format_chats(with_null.where("conv_id in (0, 99)"), unknown="raise").count() == 1
    with pytest.raises(Exception, match="no mapping for the layout OBJECT<something>"):
        chat_format.format_chats(with_null, unknown="raise").collect()


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "<\\/s>", "[ANS] x [/ANS]</s>", "[ROLE:41] ", "<s>", "", "a] b", "[\\INST]", "中\n🎉", "\ufeffmark", "<", "[", "x" * 5000 + "</s>\\"]


def test_chat_escapes(spark):
    turns = [(1, i, role, t) for i, (t, role) in enumerate((t, r) for t in NASTY for r in ("user", "assistant", "] </s>", ""))]
    turns += [(2, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", "y")] + [(3, i, "assistant", f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("record", F.to_variant_object(F.struct("role", "text"))).withColumn("formatted", F.lit("mine")).repartition(7)
    out = chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = defaultdict(list)
    for c, _, role, text in turns:
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss == "".join(t for role, t in want[c] if role == "assistant")
        unescaped = lambda x: re.sub(rf"([<\[])\\({chat_format.CONTROL})", r"\1\2", x).replace("\\\\", "\\")
        assert [unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans] == [t for role, t in want[c] if role == "assistant"]
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end")))
    wrong = {r.conv_id: r.loss for r in out.withColumn("loss", chat_format.loss_text(F.col("formatted"), moved)).collect()}
    assert all(wrong[c] != r.loss for c, r in got.items() if r.loss)  # the text is read at the mask
    assert chat_format.format_chats(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7


def test_wu_manber_against_all_positions():
    rng = random.Random(4)
    for window in (1, 2, 3, 5, 13):
        for _ in range(60):
            vocabulary = [b"a", b"b", b"c", "é".encode()][: rng.randint(1, 4)]
            text = rng.choices(vocabulary, k=rng.randint(0, 60))
            bench = [(i, b" ".join(rng.choices(vocabulary, k=rng.randint(0, 16)))) for i in range(4)]
            hit, items = decontamination.Matcher(bench, window).search(text)
            want, found = set(), set()
            for i, b in bench:
                w = b.split()
                n = min(window, len(w))
                for at in range(len(w) - n + 1 if n else 0):
                    for p in range(len(text) - n + 1):
                        if text[p : p + n] == w[at : at + n]:
                            want |= set(range(p, p + n))
                            found.add(i)
            assert {p for a, b in hit for p in range(a, b)} == want and items == found


def test_wu_manber_buckets():
    """Ten thousand patterns of one bucket, and repeated ones, are found by comparing a few."""
    bench = [(i, f"question {i} of which of the following words is the one that holds".encode()) for i in range(10_000)] + [(-1, b"Question 7 of which of the following words is the one that holds!")]
    m = decontamination.Matcher(bench, 13)
    (p,) = m.passes.values()
    assert len(p.bucket) == 1 and max(map(len, next(iter(p.bucket.values())).values())) == 1
    text = decontamination.words_of(b"question 7 of which of the following words is the one that holds question 77777 of which of the following words is the one that holds")
    assert m.search(text) == ([(0, 13)], {7, -1})


def test_slabs_hold_all_rows(monkeypatch):
    monkeypatch.setattr(decontamination, "SLAB_BYTES", 1000)
    texts = [None, "x" * 5000, "", *["y" * 300] * 20, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(decontamination.slabs(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts))) and len(parts) > 5


def test_decontamination_blocks_and_odd_input(spark, sf, odd):
    bench = spark.createDataFrame([(1, "ONE"), (2, None), (None, "12, 34"), (1, "one"), (10, "very long text"), (9, "ÇÖDÉ ..")], "item_id long, text string")
    out = {(r.doc_id, r.text): r for r in kept_columns(odd, decontamination.find(odd, bench))}
    assert out[(4, "one")]["_items"] == ["1"] and out[(4, "one")].contaminated and out[(4, "one")].n_hit == 1
    assert out[(8, "12 34 !!")].n_items == 0 and out[(8, "12 34 !!")].n_hit == 2 and out[(1, None)].n_words == 0
    assert out[(6, ODD[8][1])]["_items"] == ["9"] and out[(3, LONG)]["_items"] == ["10"] and out[(7, ODD[9][1])].n_hit == 3
    docs, real = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    split = decontamination.find(docs, real, block_bytes=1500).collect()
    assert sorted(split) == sorted(decontamination.find(docs, real).collect()) and any(r.n_hit for r in split)
    tiny = decontamination.find(docs, real, block_bytes=200)
    assert tiny._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and sorted(tiny.collect()) == sorted(split)
    assert not any(r.contaminated for r in decontamination.find(odd, bench.limit(0)).collect())
    assert decontamination.find(odd.limit(0), bench).count() == 0


# 8


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(s)


def secrets(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.scan(df).collect()}


def test_secret_base_spans(spark, sf, docs):
    rng = random.Random(7)
    parts = ["token", "TOKEN=", "api_key: ", 'secret"  = "', "apikey", "=", " ", "abc", "x1y2z3w4", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "ſecret=aaaaaaaaa", "\n", ".", "PASSWD:'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + [None, "", ("secret=abcdefgh12 " * 700) + "é" + "0123456789abcdef" * 4, "token=secret: abcdefgh12"]
    got = secrets(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == brute_spans(t), t
    whole = {r.doc_id: r for r in queries.op8_secret_scan(spark, sf).collect()}
    for d, t, _ in docs:
        spans = brute_spans(t)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert whole[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (whole[d].n_assign, whole[d].n_access, whole[d].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


def test_secret_randomness(spark):
    """Random base-64 keys are found; words, repeats, runs and counting are not."""
    rng = random.Random(8)
    keys = ["".join(rng.choices(secret_scan.SYMBOLS, k=64)) for _ in range(60)]
    plain = ["thequickbrownfoxjumpsoverthelazydogandrunsawayintothedarkforestagain", "abcabcabc" * 8, secret_scan.SYMBOLS, "a" * 80, "under_score_names_are_long_but_not_secret_at_all_in_any_way"]
    got = secrets(spark, [f"key {k} end" for k in keys] + [f"word {p} end" for p in plain * 40])
    assert sum(got[i] == [(4, 3, 68)] for i in range(60)) >= 55
    assert not any(s[1] == 3 for i in range(60, 260) for s in got[i])


def brute_battery(token):
    """(stratum, bin, random) with numpy."""
    s = token.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        s, alphabet = s.lower(), secret_scan.HEXDIGITS
    else:
        alphabet = secret_scan.BASE32 if re.fullmatch("[A-Z2-7]+", s) else secret_scan.SYMBOLS
    k, n, v = len(alphabet), len(s), np.array([alphabet.index(c) + 1 for c in s], float)
    chi, spread = k / n * sum(c * c for c in Counter(s).values()) - n, np.sqrt(2 * (k - 1) * (n - 1) / n)
    h = v > k / 2
    mean = 2 * h.sum() * (n - h.sum()) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = (1 + (h[1:] != h[:-1]).sum() - mean) / np.sqrt(var) if var > 0 else 99
    d = v - v.mean()
    serial = ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / (n - 1)) * np.sqrt(n) if (d * d).sum() > 1e-6 else 99
    t = max(0, (chi - (k - 1)) / spread) ** 2 + runs**2 + serial**2
    more = (n - 1) * (k * secret_scan.COINCIDENCE[k] - 1)
    z = (more - np.sqrt(t) * spread) / np.sqrt(2 * (k - 1) + 4 * more)
    p = z * z / 2 / np.log(10) + np.log10(z) + 0.39909 if z > 1 else 0
    return int(np.log2(n)), min(int(10 * p), secret_scan.BINS - 1), bool(t <= secret_scan.ACCEPT)


def test_battery(spark):
    """The tests' statistics against numpy: encodings, paddings, constant and short tokens, and some beyond a segment."""
    rng = random.Random(9)
    alphabets = (secret_scan.SYMBOLS, secret_scan.SYMBOLS[:-2] + "-_", secret_scan.HEXDIGITS, secret_scan.HEXDIGITS.upper(), secret_scan.BASE32, "abcdefg", "ab", "a")
    tokens = ["".join(rng.choices(a, k=n)) + pad for a in alphabets for n in (16, 17, 33, 64, 4095, 4096, 4097, 4098, 9000) for pad in ("", "==")]
    tokens += ["q8Zr+X0pLw3/VbNs71TgYhKcMdEoAiUj", "thequickbrownfoxjumpsoverthelazydog", "ab" * 40]
    got = spark.createDataFrame(list(enumerate(tokens)), "i long, t string").repartition(4).select("i", secret_scan.battery(F.col("t")).alias("b")).collect()
    assert {tokens[r.i]: (r.b.stratum, r.b.bin, r.b.random) for r in got} == {t: brute_battery(t) for t in tokens}


def test_secret_spans_against_brute_force(spark, docs):
    """All spans, those of the method included, of the documents and of some with keys of several lengths."""
    rng = random.Random(11)
    texts = [t for _, t, _ in docs] + [f"é {''.join(rng.choices(secret_scan.SYMBOLS, k=n))} and {t[:200]}" for n, (_, t, _) in zip([16, 20, 24, 32, 48, 64, 100] * 9, docs, strict=False)]
    found = [[(m.start(), m.end(), *brute_battery(m[0])) for m in re.finditer(secret_scan.CANDIDATE, t or "", re.A)] for t in texts]
    counts = Counter((stratum, b) for ms in found for *_, stratum, b, _ in ms)
    least = secret_scan.thresholds([(*k, n) for k, n in counts.items()])
    got, more = secrets(spark, texts), 0
    for i, t in enumerate(texts):
        spans = [(a, 3, e) for a, e, stratum, b, random_ in found[i] if random_ and stratum in least and b >= least[stratum]]
        more += len(spans)
        assert got[i] == sorted(brute_spans(t) + spans)
    assert more > 20


def test_secret_long_runs(spark):
    """A megabyte of random symbols in one run, a megabyte of one symbol, and a hundred thousand candidates in a text."""
    rng = random.Random(10)
    run = "".join(rng.choices(secret_scan.SYMBOLS, k=1_000_000))
    many = " ".join("".join(rng.choices("abcdefgh", k=16)) for _ in range(20_000)) + " token=abcdefgh12"
    begun = time.time()
    got = secrets(spark, [f"a {run} b", "x" * 1_000_000, many])
    assert got[0] == [(2, 3, 1_000_002)] and got[1] == [] and [s for s in got[2] if s[1] < 3] == [(len(many) - 16, 0, len(many))]
    assert time.time() - begun < 60


def test_prefix_sums(spark):
    for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 5000):
        sizes = [(7 * i) % 11 for i in range(n)]
        got = spark.createDataFrame([(sizes,)], "a array<long>").select(secret_scan.prefix_sums(F.col("a")).alias("p")).first().p
        assert got == [sum(sizes[:i]) for i in range(n)] if n < 1100 else got[-1] == sum(sizes[:-1])


def test_false_discovery_steps():
    assert secret_scan.thresholds([(4, 50, 10), (4, 0, 90), (5, 1, 100), (6, 25, 1), (6, 0, 9)]) == {4: 50}
    assert secret_scan.thresholds([]) == {}


def test_secret_odd_input(spark, odd):
    assert secret_scan.scan(odd).count() == len(ODD) and secret_scan.scan(odd.limit(0)).count() == 0
    plan = secret_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 9


def test_quality(spark, sf, odd):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = got[got.held_out & got.doc_id.isin(labels)]
    right = (held.predicted == held.doc_id.map(labels)).mean()
    assert right > 0.9 and got.score.between(0, 1).all() and len(got) == 1000
    docs = odd.select("doc_id", "text", F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, none).count() == len(ODD) and quality.classify(docs.limit(0), none).count() == 0


def brute_features(text):
    t = text or ""
    n, marks = max(len(t), 1), Counter(t)
    count = lambda chars: sum(marks[c] for c in chars)
    words, lines = [w for w in re.split("[ \t\n\r]", t.lower()) if w], t.split("\n")
    upper, digits = "".join(map(chr, range(65, 91))), "0123456789"
    return [
        (len(t) - count(" \t\n\r")) / max(len(words), 1), count("%*$&#|@!{}<>^~=_\\") / n, len(set(words)) / max(len(words), 1),
        count(upper) / n, count(digits) / n, count(".,;:?") / n, len(set(lines)) / len(lines),
    ]


def test_quality_against_brute_force(spark):
    """Features, bins, evidence, the strength of either level, and both shrunk posteriors, written out."""
    docs = duckdb.sql("select doc_id, text, source, lang from '/root/testdata/sf0.01/documents.parquet' order by doc_id limit 400").fetchall()
    docs += [(10_001, None, None, None), (10_002, "", "src1", "en"), (10_002, "", "src1", "en"), (None, "Some words, 12.", "only", None), (10_003, "A very long line. " * 20_000, "src1", "en")]
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall() + [(None, 1), (3, None)]
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, source string, lang string, score double, values string").repartition(3)
    rows_ = quality.featured(df)
    model = quality.learn(rows_, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(model.edges) == 7 and all(len(r) == len(e) + 1 <= quality.BINS for e, r in zip(model.edges, model.ratios, strict=True))
    known, values = {d: q for d, q in labels if d is not None and q is not None}, [brute_features(t) for _, t, _, _ in docs]
    place = lambda v: [sum(x > e for e in ends) for x, ends in zip(v, model.edges, strict=True)]
    marked = [(place(v), known[d[0]]) for d, v in zip(docs, values, strict=True) if d[0] in known]
    total = Counter(y for _, y in marked)
    for f, r in enumerate(model.ratios):
        n = Counter((b[f], y) for b, y in marked)
        want = [np.log((n[i, 1] + 0.5) / (total[1] + 0.5 * len(r)) / ((n[i, 0] + 0.5) / (total[0] + 0.5 * len(r)))) for i in range(len(r))]
        assert np.allclose(r, want)
    assert model.prior == (total[1] + 1) / (total[0] + total[1] + 2)
    base = np.log(model.prior / (1 - model.prior))
    e = np.array([model.slope * sum(r[b] for r, b in zip(model.ratios, place(v), strict=True)) + model.intercept for v in values])
    p = 1 / (1 + np.exp(-(e + base)))
    hosts, sites = [d[2] or "" for d in docs], [(d[2] or "", d[3] or "") for d in docs]

    def shrink(groups, up):
        """(strength, sums, sizes) of groups whose level above has the posteriors `up`."""
        s, q, n = Counter(), Counter(), Counter(groups)
        for g, x in zip(groups, p, strict=True):
            s[g] += x
            q[g] += x * x
        many = [g for g in n if n[g] > 1]
        within = max(sum(q[g] - s[g] ** 2 / n[g] for g in many) / sum(n[g] - 1 for g in many), 1e-9)
        between = (sum(n[g] * (s[g] / n[g] - up(g)) ** 2 for g in many) - len(many) * within) / sum(n[g] for g in many)
        return (1000.0 if between <= 0 else min(1000.0, max(1.0, within / between))), s, n

    kh, hs, hn = shrink(hosts, lambda g: model.prior)
    kp, ps, pn = shrink(sites, lambda g: (hs[g[0]] + kh * model.prior) / (hn[g[0]] + kh))
    want = []
    for d, h, g, x, own in zip(docs, hosts, sites, e, p, strict=True):
        host = min(0.999, max(0.001, (hs[h] - own + kh * model.prior) / (hn[h] - 1 + kh)))
        path = min(0.999, max(0.001, (ps[g] - own + kp * host) / (pn[g] - 1 + kp)))
        want.append((-1 if d[0] is None else d[0], x, host, path, 1 / (1 + np.exp(-(x + np.log(path / (1 - path)))))))
    got = [(-1 if r.doc_id is None else r.doc_id, r.evidence, r.host_posterior, r.path_posterior, r.score) for r in quality.score(df, model).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-6) and len(got) == len(docs)


def test_sites_of_urls(spark):
    urls = ["https://Example.org:8080/a/b?c=d#e", "http://example.org", "http://example.org/page.html", "not a url", None, "http://h//x/y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = quality.site_of(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("example.org", "a"), ("example.org", None), ("example.org", None), (None, None), (None, None), ("h", "x")]


def test_quality_shrinks_sparse_sites(spark):
    """A site of one document leans on the prior; a large bad one on its own documents."""
    rows = [(i, "Good words make a calm text, with order. " * 5, f"good{i % 20}", "a") for i in range(400)] + [(i, "BAD!! %%% " * 30, "bad", "a") for i in range(400, 500)]
    rows += [(500, "Good words make a calm text, with order. " * 5, "bad", "a"), (501, "Good words make a calm text, with order. " * 5, "new", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", (~F.col("text").startswith("BAD")).cast("int").alias("quality"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[500].path_posterior < got[501].path_posterior <= got[0].path_posterior + 0.05
    assert got[0].predicted == 1 and got[450].predicted == 0 and got[501].predicted == 1


# 10


def test_ppm_code_lengths():
    """Frozen tables against a direct evaluation of the escape chain."""
    samples = {"a": [b"abracadabra abracadabra", b"banana"], "b": [b"xyzzy plugh xyzzy", b"abba"]}
    ppm = language_id.PPM(samples, order=2, min_count=1)
    letters = sorted({b for t in sum(samples.values(), []) for b in t} | {32})

    def prob(texts, context, b):
        counts = Counter()
        for t in texts:
            s = b"  " + t
            counts.update(s[i] for i in range(len(context), len(s)) if s[i - len(context) : i] == context)
        return counts

    def chain(lang, context, b, seen):
        if context is None:
            left = [x for x in letters if x not in seen]
            other = (256 - len(letters)) / 256
            return (1 / 256) / (len(left) / 256 + other)
        c = stats[lang].get(context, Counter())
        total, distinct = sum(c.values()), len(c)
        shorter = context[1:] if context else None
        if not total:
            return chain(lang, shorter, b, seen)
        if b in c:
            return c[b] / (total + distinct)
        return distinct / (total + distinct) * chain_excluded(lang, shorter, b, set(c))

    def full(lang, context):
        return {b: chain(lang, context, b, set()) for b in letters}

    def chain_excluded(lang, context, b, seen):
        if context is None:
            return chain(lang, None, b, seen)
        p = full(lang, context)
        rest = 1 - sum(p[x] for x in seen)
        return p[b] / rest

    stats = {}
    for lang, texts in samples.items():
        s = b"  " + b"  ".join(texts) + b"  "
        stats[lang] = defaultdict(Counter)
        for k in range(3):
            for i in range(k, len(s)):
                stats[lang][s[i - k : i]][s[i]] += 1
    text = b"abra xyz"
    padded = b"  " + text
    for j, lang in enumerate(ppm.languages):
        want = sum(-np.log2(chain(lang, padded[i : i + 2], padded[i + 2], set())) for i in range(len(text)))
        assert abs(ppm.code_lengths([text])[0, j] - want) < 0.02 * want


def test_ppm_tables_are_bounded(monkeypatch, docs):
    samples = {x: [t.encode() for _, t, lang in docs if lang == x and t][:30] for x in ("en", "fr")}
    monkeypatch.setattr(language_id, "TABLE_BYTES", 200_000)
    small = language_id.PPM(samples)
    assert 0 < small.tables.values.nbytes <= 200_000
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1)
    assert language_id.PPM(samples).code_lengths([b"one of the"]).shape == (1, 2)


def test_language_id(spark, sf, docs, odd):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    langs = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == langs[d] for d in held]) > 0.95
    model = language_id.PPM({"en": [b"one two three the of and"], "fr": ["où est la bibliothèque".encode()]})
    out = kept_columns(odd, language_id.identify(odd, model))
    by = {(r.doc_id, r.text): (r["_lang_pred"], r["_score"]) for r in out}
    assert by[(1, None)] == by[(2, "")] == by[(8, "12 34 !!")] == by[(5, "  \t\n")] == ("und", 0.0)
    assert by[(4, "one")][0] == "en" and 0 < by[(4, "one")][1] <= 1 and len(out) == len(ODD)
    none = language_id.fit(language_id.training_sample(spark.createDataFrame([(1, "x", None), (2, None, "en")], "doc_id long, text string, lang string")))
    assert {r["_lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_scores_do_not_depend_on_blocks(monkeypatch, docs):
    ppm = language_id.PPM({"en": [b"one two three"], "fr": [b"un deux trois"]})
    texts = [t.encode() for _, t, _ in docs[:30]] + [b"", b"x"]
    want = ppm.code_lengths(texts)
    from siltbed.llm import _grams

    monkeypatch.setattr(_grams, "BLOCK", 97)
    assert np.allclose(ppm.code_lengths(texts), want)


# pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    bench = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    kept = [(d, t) for d, t, _ in docs if t and language_id.LETTER.search(t)]
    whole = dict(kept)
    kept = [(d, t) for (d, _), (t, _) in zip(kept, brute_lines([t for _, t in kept], keep_one=True), strict=True)]
    comp = brute_components({d: brute_fingerprint(t) for d, t in kept})
    kept = [(d, t) for d, t in kept if comp[d] == d]
    matcher = decontamination.Matcher([(i, t.encode()) for i, t in bench], 13)
    clean = []
    for d, t in kept:
        w = decontamination.words_of(t.encode())
        hit = matcher.search(w)[0]
        n = sum(b - a for a, b in hit)
        if not (n and 20 * n >= len(w) or any(b - a >= 13 for a, b in hit)):
            clean.append((d, ENC.encode_ordinary(t)))
    got = corpus_pipeline.run(spark, sf)
    got = sorted((r.doc_id, list(r.ids)) for r in got.select("doc_id", "ids").collect())
    assert got == sorted(clean) and any(ENC.decode(ids) == whole[d] for d, ids in got)
    for d, ids in got:  # no document that is kept holds a passage of the benchmark
        assert not any(b - a >= 13 for a, b in matcher.search(decontamination.words_of(ENC.decode(ids).encode()))[0])


def test_pipeline_keeps_one_of_many_copies(spark, sf):
    """Forty copies, exact and near, of one text leave one whole copy; a passage of the benchmark in a long text goes."""
    import corpus_pipeline

    bench = duckdb.sql(f"select text from '{sf}/benchmark.parquet' limit 1").fetchall()[0][0]
    words = random.Random(2)
    prose = lambda n: " ".join("".join(words.choices("etaoinshrdlu", k=5)) for _ in range(n))
    copied = "\n".join(prose(12) for _ in range(9))
    texts = [copied] * 30 + [copied + "\nand one more"] * 10 + [prose(2000) + " " + bench + " " + prose(2000), prose(300)]
    docs = spark.createDataFrame([(i + 5, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf).checkpoint()
        if name == "simhash_near_dedup":
            assert {r.doc_id: r.text for r in docs.collect() if len(r.text) > 20}.keys() == {5, 45, 46}
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[5] == copied and left[46] == texts[-1] and 45 not in left


def test_pipeline_decodes_what_it_encodes(spark, sf):
    import corpus_pipeline

    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = corpus_pipeline.STAGES[-1][1](spark, odd, sf).select("doc_id", "n_tokens", "decoded_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(key, got)) == sorted(key((d, len(ENC.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest())) for d, t in ODD)
    wrong = bpe.encode(odd.where("doc_id = 4"), RANKS, public_tokenizers.PATTERN, digest=True).withColumn("text", F.lit("other"))
    for column in ("ids", "decoded_sha256"):
        with pytest.raises(Exception, match="ids do not decode to the text of document 4"):
            corpus_pipeline.same_text(wrong).select(column).collect()


def test_stages_keep_the_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], docs.schema)
    for data in (docs, odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            data = stage(spark, data, sf)
            assert data.columns == docs.columns and [t for _, t in data.dtypes] == [t for _, t in docs.dtypes]
        assert corpus_pipeline.STAGES[-1][1](spark, data, sf).count() >= 0


def test_counts_do_not_depend_on_blocks(monkeypatch):
    from siltbed.llm import _grams

    symbols, texts = toxicity.symbol_table(), [b"the cat", b"", b"a", b"sat on the mat" * 9, b"x" * 50]
    stream = symbols[np.frombuffer(b"    " + b"    ".join(texts) + b"    ", np.uint8)].tolist()
    for block in (1, 3, 7, 1 << 22):
        monkeypatch.setattr(_grams, "COUNTED", block)
        for k, (keys, n) in enumerate(_grams.grams(texts, symbols, 32, 4)):
            want = Counter(sum(x * 32 ** (k - i) for i, x in enumerate(stream[at : at + k + 1])) for at in range(len(stream) - k))
            assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want


def test_fits_are_bounded_in_bytes():
    from siltbed.llm import _grams

    assert _grams.within([(1, b"abc"), (0, b"x" * 9), (1, b"abcd"), (1, b"de")], 5) == {1: [b"abc", b"de"]}


def test_lines_of_a_document_count_once(spark):
    """A line that one document repeats is one document's; fifty thousand distinct lines take no quadratic time."""
    long = "\n".join(f"line {i}" for i in range(50_000))
    df = spark.createDataFrame([(1, "same\n" * 20 + long), (2, "same\nother"), (3, "line 7\nLINE 7 ")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(df, min_docs=2).collect()}
    assert (got[1].n_dropped, got[2].text, got[3].text) == (21, "other", "") and got[1].text == long.replace("line 7\n", "", 1)
