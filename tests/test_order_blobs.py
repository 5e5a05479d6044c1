"""Page numbers, packages, resume states and binary records on small inputs."""

import io
import tarfile

from pyspark.sql import functions as F

from haulage.operators import blobs, order, planning


def tree(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, is_dir boolean, visible boolean")


def test_pages_walk_depth_first(spark):
    rows = [("a", True, True), ("a/x", True, True), ("a/x/f", False, None), ("a-b", True, True), ("b", True, False), ("b/g", False, None), ("c.txt", False, None), ("empty", True, True)]
    entries, pages = order.number_pages(tree(spark, rows))
    assert {(r.relative_path, r.ndx) for r in entries.collect()} == {("c.txt", 0), ("a", 1), ("a-b", 2), ("empty", 3), ("a/x", 5), ("a/x/f", 7), ("b/g", 10)}
    # hidden b has no number but a page; a-b and b are followed by a visible sibling; the last directory has no gap
    assert sorted(map(tuple, pages.collect())) == [("", 0, 4, 4), ("a", 5, 1, 6), ("a/x", 7, 1, 8), ("b", 10, 1, 11)]
    flat, _ = order.number_pages(tree(spark, rows), 1)
    assert [r.relative_path for r in flat.orderBy("ndx").collect()] == ["a", "a-b", "b", "c.txt", "empty"]
    none, no_pages = order.number_pages(tree(spark, rows).limit(0))
    assert none.count() == 0 and no_pages.count() == 0


def test_packages(spark):
    names = ["20240101", "20240101/20240102", "20240101/p", "20240101/p/q", "y/20240103", "y", "20240501", "20240501/z", "plain"]
    dirs = spark.createDataFrame([(n, True) for n in names] + [("20240101/f", False)], "relative_path string, is_dir boolean")
    found = lambda *a: sorted(r[0] for r in order.find_packages(dirs, *a).collect())
    assert found("dir_date <= 240301") == ["20240101", "y/20240103"]
    assert found("dir_date <= 240301 and name == p") == []
    assert found("dir_date <= 240301", 1) == ["20240101/20240102", "20240101/p"]
    assert found("dir_date <= 240301", 2, 3) == ["20240101/p/q"]
    assert found("dir_date <= 240301", 0, 1) == ["20240101"]


def test_prior_state(spark):
    states = spark.createDataFrame([(1, '{"size":16,"missing":[[8,16]]}'), (2, '{"size":16}'), (3, "{"), (4, '{"missing":[]}')], "file long, state string")
    files = spark.createDataFrame([(1, 16), (2, 17), (3, 1), (4, 1), (5, 1)], "file long, size long")
    got = {r.file: r.error for r in planning.validate_prior_state(states, files).collect()}
    assert got == {1: None, 2: "size changed: was 16, now 17", 3: "unreadable state", 4: "unreadable state", 5: None}


def test_blobs(spark):
    n = lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
    acl = {"ok": n(1, 0, 2, 3, 2) + "é".encode(), "none": n(0), "many": n(4097), "kind": n(1, 4, 0, 0, 0), "who": n(1, 0, 0, 0, 1025), "utf8": n(1, 0, 0, 0, 1) + b"\xff", "short": n(1, 0), "nothing": b"", "null": None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in acl.items()], "k string, blob binary")
    got = {r.k: r.x for r in df.select("k", blobs.decode_nfs4_acl(F.col("blob")).alias("x")).collect()}
    assert got["null"] is None and got["none"].aces == [] and tuple(got["ok"].aces[0]) == (0, 2, 3, "é")
    assert got["many"].error == "ACE count 4097 is over 4096" and got["kind"].error == "ACE type 4 is over 3"
    assert all(got[k].error and got[k].aces is None for k in ("who", "utf8", "short", "nothing"))
    pairs = spark.createDataFrame([(1, [("user.a", bytearray(b"\0x")), ("b", bytearray())]), (2, None), (3, [("n" * 257, bytearray())])], "k int, p array<struct<name:string,value:binary>>")
    back = {r.k: r.x for r in pairs.select("k", blobs.decode_xattr(blobs.encode_xattr(F.col("p"))).alias("x")).collect()}
    assert [(a.name, bytes(a.value)) for a in back[1].xattrs] == [("user.a", b"\0x"), ("b", b"")] and back[2] is None and "257" in back[3].error


def test_tar_header(spark):
    rows = [("d/" + "é" * 60, 513, 1_700_000_000_999_999_999, 0o644, 10, 20, "0", ""), ("l", 0, -5, None, None, None, "2", "target"), ("", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, size long, t long, mode long, uid long, gid long, kind string, link string")
    heads = [bytes(r[0]) for r in df.select(blobs.ustar_header(*[F.col(c) for c in df.columns])).collect()]
    first, second, _ = [tarfile.TarInfo.frombuf(h, "utf-8", "surrogateescape") for h in heads]
    assert (first.size, first.mtime, first.mode, first.uid, first.gid) == (513, 1_700_000_000, 0o644, 10, 20)
    assert first.name.encode("utf-8", "surrogateescape") == rows[0][0].encode()[:100]
    assert second.issym() and second.linkname == "target" and second.mtime == 0 and {len(h) for h in heads} == {512}
    whole = io.BytesIO(blobs.tar_header(b"f", 3) + b"abc".ljust(512, b"\0") + bytes(1024))
    assert tarfile.open(fileobj=whole).extractfile("f").read() == b"abc"
