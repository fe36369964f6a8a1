"""Command line: new, store, list, contents, extract, verify, scrub, break-lock, bench-crypto."""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltbed.functions.paths import rfc2822
from siltbed.plans.crypto_bench import bench_crypto
from siltbed.plans.repository import Repository, Settings
from siltbed.sources.files import scan_files, write_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltbed")
    p.add_argument("--password", default=os.environ.get("SILTBED_PASSWORD", ""))
    sub = p.add_subparsers(dest="command", required=True)
    new = sub.add_parser("new")
    new.add_argument("repo")
    for name, default in (("--compression", "zstd"), ("--encryption", "aes256ctr"), ("--hmac", "sha256")):
        new.add_argument(name, default=default)
    new.add_argument("--level", type=int, default=1)
    store = sub.add_parser("store")
    store.add_argument("repo")
    store.add_argument("target")
    store.add_argument("name", nargs="?", default=datetime.datetime.now().astimezone().strftime("%a, %d %b %Y %H:%M:%S %z"))
    for name in ("list", "verify", "scrub"):
        sub.add_parser(name).add_argument("repo")
    for name in ("contents", "extract"):
        c = sub.add_parser(name)
        c.add_argument("repo")
        c.add_argument("archive")
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--exclude", action="append", default=[])
        if name == "extract":
            c.add_argument("target")
            c.add_argument("--preview", action="store_true")
    lock = sub.add_parser("break-lock")
    lock.add_argument("repo")
    lock.add_argument("--older-than", type=float, default=3600)
    sub.add_parser("bench-crypto").add_argument("--rounds", type=int, default=100)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltbed").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "bench-crypto":
        for cipher, mac, speed in bench_crypto(spark, a.rounds):
            print(f"{cipher:10} {mac:8} {speed:8.1f} MiB/s")
        return 0
    if a.command == "new":
        Repository.create(spark, a.repo, a.password, Settings(a.compression, a.level, a.encryption, a.hmac))
        return 0
    repo = Repository.open(spark, a.repo, a.password)
    if a.command == "store":
        print(repo.store(scan_files(spark, a.target), a.name))
    elif a.command == "break-lock":
        print("broken" if repo.break_lock(a.older_than) else "not broken")
    elif a.command == "list":
        shown = repo.list().withColumn("time", rfc2822(F.col("ts"), F.col("tz_offset_sec")))
        rows = shown.select("position", "name", "time").collect()  # one small row a snapshot
        print(f"{len(rows)} archives")
        for r in rows:
            print(r.position, r.name, r.time, sep="\t")
    elif a.command == "contents" or (a.command == "extract" and a.preview):
        for r in repo.contents(a.archive, a.include, a.exclude).select("path").orderBy("path").toLocalIterator():
            print(r.path)
    elif a.command == "extract":
        print(write_files(repo.extract(a.archive, a.include, a.exclude), a.target).count(), "files")
    else:
        bad = repo.verify().where("not valid") if a.command == "verify" else repo.scrub()
        lost = bad.count()
        print(f"{lost} damaged")
        return int(lost > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
