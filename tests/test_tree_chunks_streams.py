"""Tree filters, chunk tables, object stores and streams on small inputs."""

from datetime import datetime, timedelta

from haulage.operators import chunks, objects, tree
from haulage.streaming import jobs as streams

ENTRY = "relative_path string, is_dir boolean, size long, mtime_ns long"


def names(df):
    return sorted(r[0] for r in df.select("relative_path").collect())


def test_tree_topmost_directory_decides(spark):
    rows = [("a", True), ("a/20240101", True), ("a/20240101/x", True), ("a/20240101/x/f.log", False), ("a/20240501", True), ("a/20240501/g.txt", False), ("a/20240501/20240101", True), ("a/20240501/20240101/h", False), ("a/i.log", False), ("b.txt", False)]
    df = spark.createDataFrame([(p, d, 1, 0) for p, d in rows], ENTRY)
    kept = tree.filter_tree(df, "dir_date <= 20240301", "extension == log")
    assert names(kept) == ["a", "a/20240101", "a/20240101/x", "a/20240101/x/f.log", "b.txt"]
    assert names(tree.filter_tree(df, max_depth=1)) == ["a", "b.txt"]
    assert len(names(tree.filter_tree(df))) == len(rows)
    assert names(tree.filter_tree(df.limit(0), "size > 1")) == []


def sides(spark, rows):
    return spark.createDataFrame([(p, o, bytearray(b)) for p, o, b in rows], "relative_path string, offset long, data binary")


def test_full_check_ignores_chunk_boundaries(spark):
    a = sides(spark, [("same", 0, b"abcdef"), ("same", 6, b"gh"), ("diff", 0, b"abcdefgh"), ("short", 0, b"abcdefgh"), ("gone", 0, b"a")])
    b = sides(spark, [("same", 0, b"abc"), ("same", 3, b"defgh"), ("diff", 0, b"abcde"), ("diff", 5, b"fXh"), ("short", 0, b"abcd"), ("extra", 0, b"z")])
    files = spark.createDataFrame([(p,) for p in ("same", "diff", "short", "gone", "extra", "empty")], "relative_path string")
    got = {r[0]: r[1] for r in chunks.full_check_chunks(a, b, files, grid=4).collect()}
    assert got == {"same": None, "diff": 6, "short": 4, "gone": 0, "extra": 0, "empty": None}


def test_shape_errors(spark):
    rows = [("f", "source", 0, 0, 4), ("f", "source", 1, 5, 4), ("f", "destination", 0, 0, 4), ("f", "destination", 1, 4, 4), ("g", "source", 0, 0, 3), ("g", "destination", 0, 0, 8)]
    df = spark.createDataFrame(rows, "relative_path string, side string, seq long, offset long, length long")
    files = spark.createDataFrame([("f", 8), ("g", 8)], "relative_path string, size long")
    got = sorted(map(tuple, chunks.stream_shape_errors(df, files).collect()))
    assert got == [("f", "source", "offset", 4), ("g", "source", "length", 3)]


def test_can_complete(spark):
    parts = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 2), ("b", 1, 5), ("b", 3, 2), ("c", 1, 5), ("c", 1, 5), ("c", 3, 2), ("d", 1, 5), ("d", 2, 5), ("d", 3, 3)], "file string, part_number long, part_len long")
    files = spark.createDataFrame([(f, 12) for f in "abcde"], "file string, size long")
    assert {r[0]: r[1] for r in objects.can_complete(parts, files, 5).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_history_drops_deleted_keys(spark):
    rows = [("a", 1, 10, "v1", False), ("a", 2, 99, "m", True), ("a", 3, 30, "v3", False), ("b", 1, 5, "v", False), ("b", 2, 0, "m", True), ("c", 1, 5, "v", False), ("c", 1, 0, "m", True)]
    df = spark.createDataFrame(rows, "key string, time_ns long, size long, version_id string, is_marker boolean")
    got = sorted(map(tuple, objects.object_history(df).select("key", "position", "size", "version_count").collect()))
    assert got == [("a", 1, 10, 3), ("a", 2, 0, 3), ("a", 3, 30, 3)]


def feed(spark, folder, batches, schema):
    """A stream that sees one batch a micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_commits_drop_repeats_and_late_events(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    batches = [[("f", 0, 4, t)], [("f", 0, 4, t), ("f", 4, 8, t + timedelta(hours=5))], [("g", 0, 1, t - timedelta(hours=3)), ("h", 0, 1, t + timedelta(hours=5))]]
    events = feed(spark, tmp_path / "in", batches, "file string, start long, end long, ts timestamp")
    got = sorted(map(tuple, streams.drain(streams.stream_commits(events, "1 hour")).select("file", "start", "end").collect()))
    assert got == [("f", 0, 4), ("f", 4, 8), ("h", 0, 1)]


def test_stream_windows_and_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    rows = [(1, t, 10), (1, t + timedelta(minutes=4), 20), (1, t + timedelta(minutes=30), 5), (2, t + timedelta(minutes=1), 7)]
    log = feed(spark, tmp_path / "in", [rows], "job long, ts timestamp, bytes long")
    base = int((t - datetime(1970, 1, 1)).total_seconds())
    slid = sorted(map(tuple, streams.drain(streams.stream_throughput(log, "20 minutes", "10 minutes"), "complete").collect()))
    assert slid == [(base - 600, 3, 37), (base, 3, 37), (base + 1200, 1, 5), (base + 1800, 1, 5)]
    held = sorted(map(tuple, streams.drain(streams.stream_sessions(log, "5 minutes"), "complete").collect()))
    assert held == [(1, base, 2, 30), (1, base + 1800, 1, 5), (2, base + 60, 1, 7)]
