"""Walks, ranged reads, copies by pieces, resumed copies and archives on real files."""

import hashlib
import json
import os
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from haulage.operators import chunks, packing, planning, transfer, tree
from haulage.sources import store


def fill(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


@pytest.fixture(scope="module")
def estate(tmp_path_factory):
    root = tmp_path_factory.mktemp("estate")
    rng = random.Random(1)
    files = {}
    for year in (2023, 2024):
        for month in (1, 2, 3):
            for k in range(4):
                files[f"logs/{year}{month:02d}15/n{k}/f{k}.log"] = rng.randbytes(rng.randint(0, 3000))
                files[f"logs/{year}{month:02d}15/n{k}/g{k}.csv"] = rng.randbytes(rng.randint(0, 3000))
    files |= {"top.txt": b"t", "deep/a/b/c/d/e.bin": b"e" * 10, "empty": b""}
    fill(root, files)
    (root / "hollow").mkdir()
    os.symlink("top.txt", root / "link")
    os.symlink(str(root / "logs"), root / "deep" / "loop")
    return root


def plain_walk(root):
    out = {}
    for folder, dirs, files in os.walk(root):
        for name in dirs + files:
            path = os.path.join(folder, name)
            info = os.lstat(path)
            kind = "link" if os.path.islink(path) else "dir" if os.path.isdir(path) else "file"
            out[os.path.relpath(path, root)] = (kind, 0 if kind == "dir" else info.st_size, info.st_mtime_ns, info.st_mode, info.st_uid, info.st_gid, info.st_ino, info.st_nlink)
    return out


def test_walk_against_os_walk(spark, estate):
    entries, listed = store.walk(spark, str(estate), tasks=4)
    got = {r.relative_path: ("dir" if r.is_dir else "link" if r.is_symlink else "file", r.size, r.mtime_ns, r.mode, r.uid, r.gid, r.ino, r.hard_links) for r in entries.collect()}
    assert got == plain_walk(estate)
    assert listed.count() == 1 + sum(k[0] == "dir" for k in got.values()) and listed.agg(F.sum("n_entries")).first()[0] == len(got)
    assert {r.link for r in entries.where("is_symlink").collect()} == {"top.txt", str(estate / "logs")}
    shallow, seen = store.walk(spark, str(estate), max_depth=2, tasks=4)
    assert {r.relative_path for r in shallow.collect()} == {p for p in got if p.count("/") < 2} and seen.agg(F.max("level")).first()[0] == 1


@pytest.mark.parametrize("match,exclude", [("dir_date >= 20240101 and dir_date < 20240301", None), (None, 'path == "logs/2023*"'), ("extension == csv", 'name == "n1"'), ('path == "deep/**"', None), ("size > 1000", "dir_date < 20240201")])
def test_walk_prunes_as_the_tree_filter_does(spark, estate, match, exclude):
    every, all_listed = store.walk(spark, str(estate), tasks=4)
    kept, listed = store.walk(spark, str(estate), match, exclude, tasks=4)
    full = every.drop("link", "error")
    want = {r.relative_path for r in tree.filter_tree(full, match, exclude).collect()}
    assert {r.relative_path for r in kept.collect()} == want
    dirs = {r.relative_path for r in listed.collect()}
    assert dirs <= {r.relative_path for r in all_listed.collect()}
    if match and "dir_date" in match:  # what lies below a directory of another date is never listed
        assert not any("/2023" in d for d in dirs) and len(dirs) < all_listed.count() - 10


def test_walk_tells_errors(spark, tmp_path):
    (row,) = store.walk(spark, str(tmp_path / "none"), tasks=2)[0].collect()
    assert row.relative_path == "" and "No such file" in row.error
    (tmp_path / "void").mkdir()
    assert store.walk(spark, str(tmp_path / "void"), tasks=2)[0].count() == 0
    os.makedirs(os.fsencode(str(tmp_path / "odd")) + b"/\xff")
    assert [r.error for r in store.walk(spark, str(tmp_path / "odd"), tasks=2)[0].collect()] == ["the name is no UTF-8"]


def test_ranges_of_files(spark, tmp_path):
    rng = random.Random(2)
    files = {"a/x.bin": rng.randbytes(1_000_000), "b/x.bin": rng.randbytes(700_001), "b/y": b"", "z": b"zz"}
    fill(tmp_path, files)
    with open(tmp_path / "huge", "wb") as f:  # three ranges of a file over 2 GiB, which is mostly a hole
        f.truncate(5 << 30)
        for at in (0, (3 << 30) + 5, (5 << 30) - 4):
            f.seek(at)
            f.write(b"mark")
    wanted = [("a/x.bin", 10, 200_000), ("a/x.bin", 999_990, 2_000_000), ("b/x.bin", 0, 1 << 40), ("b/y", 0, 9), ("gone", 0, 9), ("z", 5, 9), ("huge", (3 << 30) + 5, (3 << 30) + 9), ("huge", (5 << 30) - 4, 1 << 50), ("huge", -5, 4)]
    ranges = spark.createDataFrame(wanted, "relative_path string, start long, end long")
    began = time.perf_counter()
    got = chunks.read_chunks(spark, str(tmp_path), 65_536, ranges, tasks=4).collect()
    assert time.perf_counter() - began < 30
    want = []
    for path, start, end in wanted:
        if path in files:
            at, end = max(start, 0), min(end, len(files[path]))
            while at < end:
                to = min(end, (at // 65_536 + 1) * 65_536)
                want.append((path, at, files[path][at:to]))
                at = to
    want += [("huge", (3 << 30) + 5, b"mark"), ("huge", (5 << 30) - 4, b"mark"), ("huge", 0, b"mark")]
    assert sorted((r.relative_path, r.offset, bytes(r.data)) for r in got) == sorted(want)
    whole = chunks.read_chunks(spark, str(tmp_path / "b"), 1000, tasks=3)
    assert b"".join(r.data for r in whole.where("relative_path = 'x.bin'").orderBy("offset").collect()) == files["b/x.bin"]
    (one,) = chunks.read_chunks(spark, f"file://{tmp_path}/z").collect()
    assert (one.relative_path, one.offset, bytes(one.data)) == ("z", 0, b"zz")
    digests = {r.relative_path for r in chunks.tree_hash_chunks(chunks.read_chunks(spark, str(tmp_path), 1 << 16, glob="x.bin", tasks=3)).collect()}
    assert digests == {"a/x.bin", "b/x.bin"}


def test_only_wanted_bytes_are_read(spark, tmp_path):
    fill(tmp_path, {"big": b"q" * 40_000_000, "other": b"w" * 40_000_000})

    def read_so_far():
        with open("/proc/self/io") as f:
            return int(f.readline().split()[1])

    def counted(batches):
        before = read_so_far()
        total = sum(sum(len(d) for d in b.column(2).to_pylist()) for b in batches)
        import pyarrow as pa

        yield pa.record_batch([pa.array([total]), pa.array([read_so_far() - before])], names=["wanted", "read"])

    ranges = spark.createDataFrame([("big", k * 1_000_000, k * 1_000_000 + 1000) for k in range(40)], "relative_path string, start long, end long")
    # the Python worker's own reads, which include its pipes from Spark
    got = chunks.read_chunks(spark, str(tmp_path), 65_536, ranges, tasks=2).mapInArrow(counted, "wanted long, read long").agg(F.sum("wanted"), F.sum("read")).first()
    assert got[0] == 40_000 and got[1] < 2_000_000


def test_files_of_two_trees_are_compared(spark, tmp_path):
    data = random.Random(3).randbytes(300_000)
    worse = bytearray(data)
    worse[123_456] ^= 1
    fill(tmp_path, {"s/a/f": data, "s/b/f": data, "s/c": b"x", "d/a/f": data, "d/b/f": bytes(worse)})
    files = spark.createDataFrame([("a/f",), ("b/f",), ("c",)], "relative_path string")
    got = dict(map(tuple, chunks.check_files(spark, files, str(tmp_path / "s"), str(tmp_path / "d"), tasks=3).collect()))
    assert got == {"a/f": None, "b/f": 123_456, "c": 0}


def test_packing(spark):
    rng = random.Random(4)
    rows = [(f"f{k:05d}", rng.choice([0, 10, 5000, None]), 1) for k in range(5000)] + [(f"big{k:03d}", 1_000_000, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "relative_path string, size long, _place int")
    dealt = packing.pack(df, F.col("size"), ["relative_path"], 20, overhead=1000)
    loads = dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce("size", F.lit(0)) + 1000).alias("n"), F.count("*")).collect()
    sizes = sorted(r.n for r in loads)
    assert len(sizes) == 20 and sizes[-1] - sizes[0] <= 2 * 1_001_000 and sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)
    assert packing.pack(df.where("false"), F.col("size"), ["relative_path"], 20).count() == 0


def test_one_large_file_is_written_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    files = {f"s/d{k % 10}/f{k}": rng.randbytes(rng.randint(0, 2000)) for k in range(1000)} | {"s/big": rng.randbytes(1 << 20) * 100 + b"end"}
    fill(tmp_path, files)
    manifest = spark.createDataFrame([(p[2:], len(d)) for p, d in files.items()], "relative_path string, size long")
    dealt = packing.pack(transfer._pieces(manifest, 4 << 20), F.col("end") - F.col("start"), ["relative_path", "start"], 8)
    loads = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.col("end") - F.col("start") + packing.OVERHEAD).alias("n"), F.count_if(F.col("relative_path") == "big").alias("big")).collect()
    assert sum(r.big > 0 for r in loads) >= 4 and max(r.n for r in loads) < 2 * sorted(r.n for r in loads)[len(loads) // 2]
    done = transfer.copy_files(manifest, str(tmp_path / "s"), str(tmp_path / "t"), tasks=8, piece=4 << 20)
    assert done.count() == 1001 and done.where("error IS NOT NULL").count() == 0
    assert all((tmp_path / "t" / p[2:]).read_bytes() == d for p, d in files.items())
    ino = os.stat(tmp_path / "t/big").st_ino
    assert done.agg(F.sum("bytes")).first()[0] == sum(map(len, files.values())) and os.stat(tmp_path / "t/big").st_ino == ino
    assert not [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".part")]


def test_a_failed_file_leaves_its_target(spark, tmp_path):
    fill(tmp_path, {"s/a": b"new" * 1000, "t/a": b"old", "s/b": b"b"})
    manifest = spark.createDataFrame([("a", 7), ("b", None)], "relative_path string, size long")
    got = {r.relative_path: (r.bytes, bool(r.error)) for r in transfer.copy_files(manifest, str(tmp_path / "s"), str(tmp_path / "t"), tasks=2).collect()}
    assert got == {"a": (None, True), "b": (1, False)} and (tmp_path / "t/a").read_bytes() == b"old" and sorted(os.listdir(tmp_path / "t")) == ["a", "b"]


def test_resumed_copy_sends_what_is_missing(spark, tmp_path):
    rng = random.Random(6)
    files = {f"s/d/f{k}": rng.randbytes(rng.randint(0, 200_000)) for k in range(12)} | {"s/e": b""}
    fill(tmp_path, files)
    manifest = spark.createDataFrame([(p[2:],) for p in files] + [("gone",), (None,)], "relative_path string")
    run = lambda **more: transfer.copy_resumable(manifest, str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "state"), tasks=4, piece=10_000, **more)
    broken = run(stop=lambda path, start: hashlib.sha256(f"{path}{start}".encode()).digest()[0] < 100)
    first = broken.sent.where("error IS NULL").agg(F.sum("bytes")).first()[0]
    assert broken.sent.where("error = 'stopped'").count() > 20 and broken.files.where("error = 'stopped'").count() > 5
    (note,) = [n for n in sorted(os.listdir(tmp_path / "state/commits")) if n.endswith(".json")][:1]
    with open(tmp_path / "state/commits" / note, "a") as f:  # a line that a lost machine left half written
        f.write('{"relative_path": "d/f1", "size": 1')
    covered = [json.loads(line) for n in os.listdir(tmp_path / "state/commits") if n.endswith(".json") for line in open(tmp_path / "state/commits" / n) if line.endswith("\n")]
    total = sum(len(files["s/" + p]) for p in {c["relative_path"] for c in covered} | {p[2:] for p in files} if not (tmp_path / "t" / p).exists())
    have = sum(c["end"] - c["start"] for c in covered if not (tmp_path / "t" / c["relative_path"]).exists())
    again = run()
    assert again.planned.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == total - have
    assert first + again.sent.agg(F.sum("bytes")).first()[0] == sum(map(len, files.values()))
    assert planning.check_accounting(again.sent, again.planned, "relative_path").where("NOT ok").count() == 0
    errors = {r.relative_path: r.error for r in again.files.where("error IS NOT NULL").collect()}
    assert errors == {"gone": "the source is missing"} and all((tmp_path / "t" / p[2:]).read_bytes() == d for p, d in files.items())
    third = run()
    assert third.planned.count() == 0 and third.sent.count() == 0 and third.files.where("error IS NULL").count() == 13


def test_resumed_copy_trusts_no_changed_source_or_piece(spark, tmp_path):
    fill(tmp_path, {"s/a": b"a" * 50_000, "s/b": b"b" * 50_000, "s/c": b"c" * 50_000})
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "relative_path string")
    run = lambda **more: transfer.copy_resumable(manifest, str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "state"), tasks=3, piece=10_000, **more)
    run(stop=lambda path, start: start == 30_000)
    (tmp_path / "s/a").write_bytes(b"A" * 50_000)  # another source
    os.utime(tmp_path / "s/a", ns=(5, 5))
    with open(tmp_path / "t/b.resume.part", "r+b") as f:  # a piece that went bad
        f.write(b"?")
    os.remove(tmp_path / "t/c.resume.part")
    again = run()
    planned = {r.relative_path: r.n for r in again.planned.groupBy("relative_path").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert planned == {"a": 50_000, "b": 10_000, "c": 50_000}
    assert {r.relative_path: r.error for r in again.files.collect()} == {"a": None, "b": "a noted piece has changed", "c": None}
    assert run().files.where("error IS NOT NULL").count() == 0
    assert [(tmp_path / "t" / n).read_bytes()[:1] for n in "abc"] == [b"A", b"b", b"c"] and len(os.listdir(tmp_path / "t")) == 3


def test_archives_with_directories_and_links(spark, tmp_path):
    fill(tmp_path / "s", {"p/sub/x": b"x" * 1000, "p/y": b"y"})
    os.symlink("sub/x", tmp_path / "s/p/l")
    rows = [("p", "p/sub", 0, True, False), ("p", "p/sub/x", 1000, False, False), ("p", "p/y", 1, False, False), ("p", "p/l", 5, False, True)]
    entries = spark.createDataFrame(rows, "package string, relative_path string, size long, is_dir boolean, is_symlink boolean")
    (row,) = transfer.pack_to_tar(entries, str(tmp_path / "s"), str(tmp_path / "t"), tasks=3).collect()
    assert row.error is None and row.bytes == os.path.getsize(tmp_path / "t/p.tar") == planning.tar_size(entries).first().tar_bytes
    with tarfile.open(tmp_path / "t/p.tar") as tar:
        got = {m.name: (m.type, m.linkname, m.size) for m in tar.getmembers()}
        assert tar.extractfile("sub/x").read() == b"x" * 1000
    assert got == {"sub": (tarfile.DIRTYPE, "", 0), "sub/x": (tarfile.REGTYPE, "", 1000), "y": (tarfile.REGTYPE, "", 1), "l": (tarfile.SYMTYPE, "sub/x", 0)}
