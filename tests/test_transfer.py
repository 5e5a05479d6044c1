import os
import tarfile

from haulage.operators import transfer


def fill(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_copies(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    fill(src, {"a/x": b"1" * 5_000_000, "a/y": b"", "z": b"zz"})
    os.utime(src / "z", ns=(1, 1_234_567_890_000_000_001))
    rows = [("a/x", 5_000_000), ("a/y", 0), ("z", 2), ("z", 2), ("gone", 1), ("a/x/../../../q", 1), (None, 1)]
    manifest = spark.createDataFrame(rows, "relative_path string, size long")
    got = {r.relative_path: (r.bytes, bool(r.error)) for r in transfer.copy_files(manifest, str(src), str(dst), delete_source=False, tasks=4).collect()}
    assert got == {"a/x": (5_000_000, False), "a/y": (0, False), "z": (2, False), "gone": (None, True), "a/x/../../../q": (None, True), None: (None, True)}
    assert (dst / "a/x").read_bytes() == b"1" * 5_000_000 and (dst / "z").stat().st_mtime_ns == 1_234_567_890_000_000_001
    assert sorted(os.listdir(dst)) == ["a", "z"] and sorted(os.listdir(dst / "a")) == ["x", "y"]
    wrong = spark.createDataFrame([("a/x", 7)], manifest.schema)
    assert "size changed" in transfer.copy_files(wrong, str(src), str(dst), tasks=2).first().error
    for _ in range(2):  # the second run finds the work done
        moved = transfer.copy_files(manifest.limit(3), str(src), str(dst), delete_source=True, tasks=4).collect()
        assert len(moved) == 3 and not any(r.error for r in moved)
    assert not (src / "z").exists()


def test_archives(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    files = {f"p/{k}/f{j}": bytes([j % 251]) * (j * 300) for k in "ab" for j in range(12)} | {"p/c/big": b"q" * 5_000_001}
    fill(src, files)
    entries = spark.createDataFrame([(n.rsplit("/", 1)[0], n, len(v)) for n, v in files.items()] + [("p/d", "p/d/gone", 4)], "package string, relative_path string, size long")
    got = {r.package: r for r in transfer.pack_to_tar(entries, str(src), str(dst), tasks=4).collect()}
    assert got["p/d"].error and not (dst / "p/d.tar").exists() and not any(got[p].error for p in ("p/a", "p/b", "p/c"))
    for package in ("p/a", "p/b", "p/c"):
        assert (dst / f"{package}.tar").stat().st_size == got[package].bytes
        with tarfile.open(dst / f"{package}.tar") as tar:
            back = {f"{package}/{m.name}": tar.extractfile(m).read() for m in tar.getmembers()}
        assert back == {n: v for n, v in files.items() if n.startswith(package + "/")}
