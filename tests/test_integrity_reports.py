"""Odd rows of the comparison, planning, report and list operators."""

import pytest
from pyspark.sql import functions as F

from haulage.operators import acl, blobs, chunks, diff, integrity, planning, report


def test_quick_check_fails_closed(spark):
    kind = "relative_path string, size long, mtime_ns long, mode long, uid long, gid long, is_dir boolean, is_symlink boolean"
    row = lambda p, size=1, m=10**9, mode=0o644, d=False, link=False: (p, size, m, mode, None, None, d, link)
    src = spark.createDataFrame([row("a"), row("b", None), row("c", m=None), row("d", None, None), row("e"), row("f", mode=0o777, link=True), row("g", d=True), row("h"), row("i", mode=None)], kind)
    dst = spark.createDataFrame([row("a"), row("b", 9), row("c"), row("d", None, None), row("e", link=True), row("f", mode=0o644, link=True), row("g", 7, d=None), row("i"), row("j")], kind)
    got = {r.relative_path: (r.outcome, r.fields) for r in integrity.quick_check(src, dst).collect()}
    assert got == {"a": ("ok", ""), "b": ("size", ""), "c": ("metadata", "mtime"), "d": ("ok", ""), "e": ("kind", ""), "f": ("ok", ""), "g": ("kind", ""), "h": ("missing_destination", ""), "i": ("ok", ""), "j": ("missing_source", "")}
    assert integrity.quick_check(src.where("false"), dst.where("false")).count() == 0


def test_hdfs_owners(spark):
    df = spark.sql("SELECT named_struct('mtime_ns', 0L, 'mode', 0L, 'owner', 'a', 'owner_group', CAST(NULL AS STRING)) AS s, named_struct('mtime_ns', 0L, 'mode', 0L, 'owner', CAST(NULL AS STRING), 'owner_group', CAST(NULL AS STRING)) AS d")
    assert df.select(integrity.metadata_mismatches("s", "d", dst_kind="hdfs", src_kind="hdfs")).first()[0] == ["owner"]


def test_verify_copy_fails_closed(spark):
    src = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, None), ("c", None, 1, "x"), ("d", 1, 1, "x"), ("e", 1, 1, "x")], "relative_path string, size long, length long, digest string")
    dst = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 1, "x"), ("d", None, "x")], "relative_path string, length long, digest string")
    done = integrity.verify_copy(src, dst)
    assert dict(map(tuple, done.collect())) == {"a": "ok", "b": "integrity", "c": "size", "d": "size", "e": "missing"}
    assert {r[0] for r in integrity.copies_to_clean(done).collect()} == {"b", "c", "d"}


def test_renames(spark):
    kind = "relative_path string, size long, mtime_ns long, mode long, uid long, gid long, ino long"
    row = lambda p, ino, size=1: (p, size, 0, 0, 0, 0, ino)
    prev = spark.createDataFrame([row("a", 1), row("b", 2), row("c", 3), row("c2", 3), row("d", None), row("s", 9)], kind)
    cur = spark.createDataFrame([row("x", 1), row("y", 2, 5), row("z", 3), row("w", None), row("s", 9)], kind)
    told = diff.pair_renames(diff.diff_inventories(prev, cur))
    got = {r.relative_path: (r.from_path, r.state, r.change) for r in told.collect()}
    assert got == {"x": ("a", "renamed", "same"), "y": ("b", "renamed", "data_changed"), "z": (None, "new", None), "c": (None, "deleted", None), "c2": (None, "deleted", None), "d": (None, "deleted", None), "w": (None, "new", None), "s": (None, "same", None)}
    acts = sorted((r.relative_path, r.step, r.action) for r in diff.sync_actions(told).where("relative_path in ('x', 'y', 's')").collect())
    assert acts == [("x", 0, "rename"), ("y", 0, "rename"), ("y", 1, "copy"), ("y", 2, "set_metadata")]


def test_copy_parts(spark):
    size = lambda *rows: spark.createDataFrame(list(rows), "relative_path string, size long")
    mib = 1 << 20
    got = planning.copy_ranges(size(("a", 12 * mib), ("b", 0), ("c", None), ("huge", 60 << 40)), 5 * mib).collect()
    assert sorted(str(r.bytes) for r in got if r.relative_path == "a") == ["bytes=0-5242879", "bytes=10485760-12582911", "bytes=5242880-10485759"]
    assert [(r.part_number, r.bytes, r.error[:9]) for r in got if r.relative_path == "huge"] == [(None, None, "part size")] and len(got) == 4
    assert planning.copy_ranges(size(("a", 100 * mib)), mib).first().error is not None
    exact = planning.copy_ranges(size(("a", 10_000 * 5 * mib + 1)), 5 * mib)
    assert exact.count() == 10_000 and exact.agg(F.count("error")).first()[0] == 0
    many = planning.plan_chunks(size(("a", 200_000 * 10 + 3)), 10)
    assert many.agg(F.count("*"), F.min("chunk"), F.max("chunk"), F.sum(F.col("end") - F.col("start"))).first()[:] == (200_001, 0, 200_000, 2_000_003)


def test_chunk_reader(spark, tmp_path):
    n = 12 * (1 << 20) + 123
    content = bytes(range(251)) * (n // 251 + 1)
    content = content[:n]
    damaged = bytearray(content)
    damaged[6 * (1 << 20) + 17] ^= 1
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "f.bin").write_bytes(content)
    (tmp_path / "b" / "f.bin").write_bytes(bytes(damaged))
    (tmp_path / "a" / "empty.bin").write_bytes(b"")
    (tmp_path / "b" / "empty.bin").write_bytes(b"")
    a, b = chunks.read_chunks(spark, f"{tmp_path}/a", 1 << 20), chunks.read_chunks(spark, f"{tmp_path}/b", 300_000)
    assert a.count() == 13 and b"".join(r.data for r in a.orderBy("offset").collect()) == content
    files = spark.createDataFrame([("f.bin",), ("empty.bin",)], "relative_path string")
    assert dict(map(tuple, chunks.full_check_chunks(a, b, files).collect())) == {"f.bin": 6 * (1 << 20) + 17, "empty.bin": None}
    wanted = spark.createDataFrame([("f.bin", 5, 70), ("f.bin", n - 3, n + 50), ("none", 0, 9)], "relative_path string, start long, end long")
    got = [(r.offset, bytes(r.data)) for r in chunks.read_chunks(spark, f"{tmp_path}/a", 64, wanted).orderBy("offset").collect()]
    assert got == [(5, content[5:64]), (64, content[64:70]), (n - 3, content[n - 3 :])]


def test_rates_over_stretches(spark):
    second = 1_000_000
    rows = [(j, t * second, 10) for j in (0, 1) for t in range(0, 3000, 7)]
    got = {tuple(r) for r in report.rate_violations(spark.createDataFrame(rows, "job long, ts_us long, bytes long"), 1, 6, 20).collect()}
    want = set()
    for j, t, _ in rows:
        n = sum(10 for k, u, _ in rows if k == j and t - 20 * second <= u <= t)
        if n > 26:
            want.add((j, t, n))
    assert got == want and want
    with pytest.raises(ValueError):
        report.throughput_windows(spark.range(1), 60, 7)


def test_lists_and_headers(spark):
    kind = "path string, trustee string, mask long, flags long, type long"
    src = spark.createDataFrame([("p", "u", 1, 0, 0), ("p", "u", 1, 0, 0), ("q", "u", 1, 3, 1)], kind)
    dst = spark.createDataFrame([("p", "u", 1, 0, 0), ("p", "i", 1, 16, 0), ("q", "u", 1, 3, 1)], kind)
    row, same = sorted(acl.acl_diff(src, dst).collect())
    assert tuple(same) == ("q", 0, 0, True, ["[E] AccessDenied u (OI|CI)"])  # equal explicit entries are written all the same
    assert (row.path, row.only_src, row.only_dst, row.needs_update) == ("p", 1, 0, True)
    assert row.merged == ["[E] AccessAllowed u ()", "[E] AccessAllowed u ()", "[I] AccessAllowed i ()"]
    texts = src.select(acl.ace_text(F.col("flags"), F.col("type"), F.col("trustee"))).distinct().collect()
    assert {r[0] for r in texts} == {"[E] AccessAllowed u ()", "[E] AccessDenied u (OI|CI)"}
    heads = spark.createDataFrame([("a", 1), ("n" * 101, 1), ("b", 8**11), (None, 1)], "name string, size long")
    text = F.lit("")
    got = heads.select(blobs.tar_errors(F.col("name"), F.col("size"), text)).collect()
    assert [r[0] for r in got] == [None, "the name is over 100 bytes", "the size is not within 8 GiB", "no name"]
