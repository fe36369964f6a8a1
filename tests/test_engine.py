import os

import pytest
from pyspark.sql import functions as F

from siltbed.functions import hashing
from siltbed.operators import chains, dedup, index, listing, manifest, restore
from siltbed.operators.chunkers import BuzHash, StaticSize
from siltbed.plans.backends import Memory
from siltbed.plans.repository import AlreadyExists, ArchiveNotFound, Locked, Repository, RepositoryError, Settings
from siltbed.sources.files import scan_directories, scan_files, write_files
from siltbed.streaming.ingest import first_seen, ingest


def test_replay_and_segments(spark):
    log = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 0, 2), ("b", 0, 1, 3), ("a", 0, 5, 9)], "chunk_id string, tx_file int, tx_seq int, segment_id int")
    last = {r.chunk_id: r.segment_id for r in index.replay(log).collect()}
    first = {r.chunk_id: r.segment_id for r in index.replay(log, policy="first").collect()}
    assert last == {"a": 2, "b": 3} and first == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        index.replay(log, policy="newest")
    assert index.next_id(log).first()[0] == 10 and index.next_id(log.limit(0)).first()[0] == 0
    sizes = [7, 100, 1, 50, 3, 3, 3, 90, 20]
    got = index.pack_segments(spark.createDataFrame(list(enumerate(sizes)), "o int, length long"), 60, "o").orderBy("o").collect()
    want = [sum(sizes[:i]) // 60 for i in range(len(sizes))]
    assert [r.segment_id for r in got] == want
    assert [r.slot for r in got] == [want[:i].count(s) for i, s in enumerate(want)]


def test_dedup_writes_each_chunk_once(spark):
    s = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "chunk_id string, length int")
    known = spark.createDataFrame([("b",)], "chunk_id string")
    assert sorted(r.chunk_id for r in dedup.new_chunks(s, known).collect()) == ["a", "c"]
    assert {r.chunk_id: r.present for r in dedup.already_present(s, known).collect()} == {"a": False, "b": True, "c": False}
    assert dedup.count_chunks(s).first()[0] == 3


def test_listing(spark):
    nodes = listing.nodes_from_paths(spark.createDataFrame([("A/4", 0), ("B/C/6", 5), ("1", 3)], "path string, length long"))
    got = {r.path: r for r in nodes.collect()}
    assert set(got) == {"A", "A/4", "B", "B/C", "B/C/6", "1"}
    assert got["A/4"].extents is None and got["1"].extents[0]["end"] == 2 and got["B/C/6"].parent_path == "B/C"
    assert {r.path: r.depth for r in listing.bfs(nodes).collect()} == {"A": 0, "B": 0, "1": 0, "A/4": 1, "B/C": 1, "B/C/6": 2}
    lost = nodes.where("path <> 'B'")
    assert [r.path for r in listing.orphans(lost).collect()] == ["B/C"]
    assert "B/C/6" not in {r.path for r in listing.bfs(lost).collect()}
    assert {r.path for r in listing.attached(lost).collect()} == {"A", "A/4", "1", "B/C/6"}


def test_manifest(spark):
    tx = spark.createDataFrame([("a", [], 1), ("b", ["a"], 5), ("c", ["a"], 3), ("d", ["b", "gone"], 4)], "tag string, previous_heads array<string>, ts int")
    assert sorted(r.tag for r in manifest.heads(tx).collect()) == ["c", "d"]
    assert [tuple(r) for r in manifest.dangling(tx).collect()] == [("gone", "d")]
    assert {r.tag: r.depth for r in manifest.depth(tx).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert manifest.last_modification(tx).first()[0] == 4 and manifest.last_modification(tx.limit(0)).first()[0] is None
    names = tx.select("tag", "ts", F.lit("x").alias("name"))
    assert [r.tag for r in manifest.newest_first(names).orderBy("position").collect()] == ["b", "d", "c", "a"]
    assert manifest.select_archive(names, 2).first().tag == "c" and manifest.select_archive(names, "x").first().tag == "b"
    assert manifest.select_archive(names, "nothing").count() == 0


def test_sparse_objects(spark):
    rows = [("p", 3, 2, b"ab"), ("p", 5, 1, b"c"), ("p", 10, 1, b"d"), ("p", 10, 1, b"d"), ("q", 0, 1, b"z")]
    s = spark.createDataFrame(rows, "path string, start long, length long, body binary")
    got = {r.path: bytes(r.content) for r in restore.reassemble(s).collect()}
    assert got == {"p": b"\0\0\0abc\0\0\0\0d", "q": b"z"}
    e = spark.createDataFrame([("p", 0, 4, 5), ("p", 1, 6, 9)], "path string, extent_no int, start long, end long")
    assert sorted((r.extent_no, r.start, bytes(r.body)) for r in restore.range_fetch(s, e).collect()) == [(0, 4, b"b"), (0, 5, b"c")]
    with pytest.raises(Exception, match="overlap"):
        restore.reassemble(s.union(spark.createDataFrame([("p", 4, 1, b"x")], s.schema))).collect()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in put"
    for name, content in {"1": b"", "A/4": b"four" * 999, "B/C/6+x y": os.urandom(5000), "B/5": b"four" * 999, "ü.txt": "é".encode() * 700}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "empty").mkdir()
    return root


@pytest.mark.parametrize("settings", [Settings(), Settings.lightweight(), Settings("lz4", 1, "chacha20", "sha3")])
def test_backup_and_restore(spark, tmp_path, tree, settings):
    base = str(tmp_path / "repo")
    repo = Repository.create(spark, base, "pw", settings)
    files = scan_files(spark, str(tree))
    want = {str(p.relative_to(tree)): p.read_bytes() for p in tree.rglob("*") if p.is_file()}
    assert {r.path: bytes(r.content) for r in files.collect()} == want
    repo.store(files, "first", BuzHash(1, 48, 8))
    n = repo.count_chunks()
    repo.store(files, "second", BuzHash(1, 48, 8), namespace=["x", "y"])
    assert repo.count_chunks() == n == repo.chunks.count()
    repo = Repository.open(spark, base, "pw")
    assert [r.name for r in repo.list().collect()] == ["second", "first"]
    assert all(r.valid for r in repo.verify().collect()) and manifest.heads(repo.archives).count() == 1
    assert {r.path: bytes(r.content) for r in repo.extract("first").collect()} == want
    assert {r.path: bytes(r.content) for r in repo.extract(0, namespace=["x", "y"]).collect()} == want
    assert {r.path for r in repo.extract(1, ["B/*"], ["*6*"]).collect()} == {"B/5"}
    assert {r.path for r in repo.contents("first", exclude=["B*"]).collect()} == {"1", "A", "A/4", "ü.txt"}
    assert write_files(repo.extract("first"), str(tmp_path / "out")).agg(F.sum("n_bytes")).first()[0] == sum(map(len, want.values()))
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == want
    assert repo.scrub().count() == 0
    with pytest.raises(ArchiveNotFound):
        repo.extract("third")


def test_repository_refuses(spark, tmp_path):
    base = str(tmp_path / "repo")
    repo = Repository.create(spark, base, "pw")
    with pytest.raises(AlreadyExists):
        Repository.create(spark, base, "pw")
    with pytest.raises(RepositoryError):
        Repository.open(spark, str(tmp_path / "none"), "pw")
    with pytest.raises(RepositoryError):
        repo.set_settings(Settings(hmac="sha3"))
    repo.set_settings(Settings("none", 0, "none"))
    assert Repository.open(spark, base, "pw").settings.compression == "none"
    assert repo.list().count() == 0 and repo.last_modification().first()[0] is None
    one = spark.createDataFrame([("a", b"x"), (" a ", b"y")], "path string, content binary")
    with pytest.raises(RepositoryError, match="twice"):
        repo.store(one, "bad")
    repo._lock()
    with pytest.raises(Locked):
        repo.store(one.limit(1), "locked")
    repo._unlock()
    ids = spark.createDataFrame([(b"\1" * 32,)], "chunk_id binary")
    assert repo.has_chunk(ids).first().present is False
    with pytest.raises(Exception, match="no chunk"):
        repo.read_chunks(ids).collect()


def test_locks_and_staging(spark, tmp_path, monkeypatch):
    """A crashed writer's lock can be broken, other errors are not taken for locks, and nothing plain is ever staged."""
    base = str(tmp_path / "repo")
    repo = Repository.create(spark, base, "pw", Settings("none", 0, "aes256ctr"))
    rows = spark.createDataFrame([("a", b"plain text of a secret" * 40), ("b", b"")], "path string, content binary")
    seen, real = [], Repository._write_new

    def looked(self, slices, places):
        real(self, slices, places)
        seen.extend(p.read_bytes() for p in (tmp_path / "repo").rglob("*") if p.is_file())

    monkeypatch.setattr(Repository, "_write_new", looked)
    repo.store(rows, "one", StaticSize(64))
    assert seen and not any(b"plain text" in x for x in seen) and not list((tmp_path / "repo").glob("staging/*"))
    monkeypatch.setattr(Repository, "_write_new", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        repo.store(rows, "two")
    assert repo.lock_holder() is None and not list((tmp_path / "repo").glob("staging/*")) and repo.list().count() == 1
    repo._lock()
    assert repo.lock_holder()["pid"] == os.getpid() and not repo.break_lock() and repo.break_lock(0) and not repo.break_lock(0)
    with pytest.raises(Exception, match="No FileSystem|Unsupported|unknown"):
        Repository.create(spark, "nosuch://x/y", "pw")


def test_a_source_that_changes_is_not_committed(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    moving = spark.range(20).select(F.col("id").cast("string").alias("path"), F.encode(F.expr("uuid()"), "UTF-8").alias("content"))
    moving = moving.select("path", F.encode(F.udf(lambda _: os.urandom(8).hex()).asNondeterministic()("path"), "UTF-8").alias("content"))
    with pytest.raises(RepositoryError, match="changed"):
        repo.store(moving, "x")
    assert repo.list().count() == 0


def test_repository_in_memory(spark):
    store = Memory(spark)
    repo = Repository.create(spark, store, "pw")
    rows = spark.createDataFrame([("d/a", b"x" * 300), ("b", b"")], "path string, content binary")
    repo.store(rows, "one", StaticSize(100))
    repo.store(rows, "two", StaticSize(100))
    again = Repository.open(spark, store, "pw")
    assert [r.name for r in again.list().collect()] == ["two", "one"] and again.count_chunks() == again.chunks.count() == 1
    assert {r.path: bytes(r.content) for r in again.extract("one").collect()} == {"d/a": b"x" * 300, "b": b""}
    with pytest.raises(AlreadyExists):
        Repository.create(spark, store, "pw")
    with pytest.raises(RepositoryError):
        Repository.open(spark, Memory(spark), "pw")
    again._lock()
    with pytest.raises(Locked):
        repo.store(rows, "three")
    assert again.break_lock(0) and repo.touch() is None


def test_cycles_through_merges(spark):
    rows = [("a", []), ("b", ["a", "d"]), ("c", ["b"]), ("d", ["c"]), *((f"l{i}", [f"l{i - 1}"] if i else []) for i in range(50))]
    with pytest.raises(chains.Cycle):
        manifest.depth(spark.createDataFrame(rows, "tag string, previous_heads array<string>"))


def test_missing_headers(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "chunk_id int"), spark.createDataFrame([(1, "x")], "chunk_id int, h string")
    with pytest.raises(index.HeaderNotFound):
        index.with_headers(a, b)
    assert index.with_headers(a.where("chunk_id = 1"), b).first().h == "x"
    assert index.described(a, a.where("chunk_id = 1"), b).count() == 1
    assert len(hashing.random_id()) == 32 and hashing.random_id() != hashing.random_id()


def test_restore_by_uri(spark, tmp_path, tree):
    rows = spark.createDataFrame([("d/a b", b"x"), ("ü", b"")], "path string, content binary")
    assert write_files(rows, (tmp_path / "o").as_uri()).count() == 2
    assert (tmp_path / "o/d/a b").read_bytes() == b"x" and (tmp_path / "o/ü").read_bytes() == b"" and not list((tmp_path / "o").rglob("*.part"))
    assert {r.path for r in scan_directories(spark, tree.as_uri().replace("%20", " ")).collect()} == {"A", "B", "B/C", "empty"}


def test_directories_and_unsafe_paths(spark, tmp_path, tree):
    assert {r.path for r in scan_directories(spark, str(tree)).collect()} == {"A", "B", "B/C", "empty"}
    with pytest.raises(Exception, match="leads out"):
        write_files(spark.createDataFrame([("../x", b"")], "path string, content binary"), str(tmp_path / "o")).collect()


def test_streaming_ingest_stores_each_chunk_once(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    df = spark.createDataFrame([("a", b"x" * 300), ("b", b"x" * 300), ("c", b"y" * 10)], "path string, content binary")
    for i in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest(stream, repo, str(tmp_path / f"cp{i}"), StaticSize(256)).awaitTermination()
    assert repo.chunks.count() == 3


def test_first_seen(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 'a' chunk_id union all select timestamp'2024-01-01 00:01:00', 'a' union all select timestamp'2024-01-01 00:02:00', 'b'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.chunk_id for r in spark.table("seen").collect()) == ["a", "b"]


def test_sparse_snapshots(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw", Settings("none", 0, "chacha20"))
    rows = [("d/s", 3, b"abc"), ("d/s", 10, b"0123456789" * 9), (" e ", 0, b""), ("f", 0, None)]
    repo.store(spark.createDataFrame(rows, "path string, start long, content binary"), "x", StaticSize(4))
    want = b"\0\0\0abc\0\0\0\0" + b"0123456789" * 9
    assert {r.path: bytes(r.content) for r in repo.extract("x").collect()} == {"d/s": want, " e ": b"", "f": b""}
    node = repo.contents("x", ["d/s"]).first()
    assert (node.total_length, node.total_size, [tuple(e) for e in node.extents]) == (100, 93, [(3, 5), (10, 99)])
    asked = spark.createDataFrame([("d/s", 0, 4, 12), ("d/s", 1, 98, 200), ("f", 2, 0, 5)], "path string, extent_no int, start long, end long")
    got = {}
    for r in sorted(repo.read_ranges(0, asked).collect(), key=lambda r: (r.extent_no, r.start)):
        got.setdefault(r.extent_no, []).append((r.start, bytes(r.body)))
    assert got == {0: [(4, b"bc"), (10, b"012")], 1: [(98, b"89")]}


def test_command_line(spark, tmp_path, tree, capsys):
    from siltbed.__main__ import main

    repo, out = str(tmp_path / "repo"), tmp_path / "out"
    assert main(["--password", "p", "new", repo, "--compression", "lz4"]) == 0
    main(["--password", "p", "store", repo, str(tree), "one"])
    main(["--password", "p", "list", repo])
    main(["--password", "p", "extract", repo, "0", str(out), "--include", "B/*", "--preview"])
    assert main(["--password", "p", "verify", repo]) == 0 and main(["--password", "p", "scrub", repo]) == 0
    shown = capsys.readouterr().out
    assert "1 archives" in shown and "\tone\t" in shown and "B/C/6+x y" in shown and not out.exists()
    main(["--password", "p", "extract", repo, "one", str(out), "--exclude", "A*"])
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["1", "B/5", "B/C/6+x y", "ü.txt"]
    main(["bench-crypto", "--rounds", "1"])
    assert capsys.readouterr().out.count("MiB/s") == 10


def test_depth_of_long_and_merged_logs(spark):
    """Beyond a hundred levels, and merges one after another, which double the number of paths each time."""
    long = [(f"l{i}", [f"l{i - 1}"] if i else []) for i in range(300)]
    merged = [("m0", [])] + [x for i in range(1, 13) for x in ((f"a{i}", [f"m{i - 1}"]), (f"b{i}", [f"a{i}", f"a{i}"]), (f"m{i}", [f"a{i}", f"b{i}"]))]
    odd = [("none", None), ("lost", ["gone"]), ("below", ["lost"]), ("half", ["gone", "l3"]), ("l5", ["l4"])]
    got = {r.tag: r.depth for r in manifest.depth(spark.createDataFrame(long + merged + odd, "tag string, previous_heads array<string>").repartition(4)).collect()}
    want = {f"l{i}": i for i in range(300)} | {"m0": 0, "none": 0, "half": 4}
    want |= {f"{k}{i}": 3 * i - 2 + "abm".index(k) for i in range(1, 13) for k in "abm"}
    assert got == want
    assert manifest.depth(spark.createDataFrame([], "tag string, previous_heads array<string>")).count() == 0


def test_chains_of_links(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y")], "node string, up string")
    assert {tuple(r) for r in chains.ends(rows).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2)}
