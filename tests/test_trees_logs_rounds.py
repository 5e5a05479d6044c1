"""Hash trees, renamed directories, bucketed inventories, coverage in a stream, retry rounds and clashing names."""

import random

from pyspark.sql import functions as F

from haulage.functions.names import free
from haulage.jobs import registry
from haulage.operators import acl, chunks, diff, objects, order, outcomes, packing, planning, transfer, tree
from haulage.streaming import jobs as streams

LOG = "seq long, kind string, relative_path string, from_path string, size long"


def replay(rows):
    now = {}
    for seq, kind, path, source, size in sorted(rows):
        if kind == "Deleted":
            now.pop(path, None)
            continue
        if kind == "Renamed":
            moved = {p: v for p, v in now.items() if p is not None and (p == source or p.startswith(source + "/"))}
            for p in moved:
                del now[p]
            now |= {path + p[len(source) :]: v for p, v in moved.items()}
        now[path] = size
    return now


def test_renamed_directories_equal_a_replay(spark):
    rng = random.Random(8)
    for trial in range(3):
        names = ["a", "b", "c", "a/x", "a/y", "b/x", "a/x/1", "a/x/2", "b/x/1", "c/z/3", None]
        rows = []
        for seq in range(60):
            kind = rng.choice(["Scanned", "Scanned", "Deleted", "Renamed"])
            source = rng.choice(names[:-1]) if kind == "Renamed" else None
            path = rng.choice(names[:-1] + ["d", "d/e"]) if kind == "Renamed" else rng.choice(names)
            rows.append((seq, kind, path, source, rng.randint(1, 99)))
        got = {r[0]: r[1] for r in diff.merge_scan_messages(spark.createDataFrame(rows, LOG)).collect()}
        assert got == replay(rows), trial
    chain = [(0, "Scanned", "a/f", None, 5), *[(k + 1, "Renamed", f"n{k + 1}", f"n{k}" if k else "a", k) for k in range(5)]]
    assert {r[0]: r[1] for r in diff.merge_scan_messages(spark.createDataFrame(chain, LOG)).collect()} == {"n5/f": 5, "n5": 4}
    assert diff.merge_scan_messages(spark.createDataFrame([], LOG)).count() == 0


def test_registered_log_equals_a_replay(spark, small):
    rows = [tuple(r) for r in registry.tree_log(spark, small).select("seq", "kind", "relative_path", "from_path", "size").collect()]
    assert {r[0]: r[1] for r in registry.queries()["d8_renamed_directories"](spark, small).collect()} == replay(rows)


def test_renames_of_odd_paths_and_at_one_time_equal_a_replay(spark):
    """Absolute paths, doubled and trailing slashes; renames of one directory and of those in it; later news of a moved file."""
    rng = random.Random(11)
    names = ["/a", "/a/b", "/a//b", "/a/b/", "a", "a/b", "//a", "/a/b/c", "/z", "/z/b", "é/b", "é"]
    rows = []
    for seq in range(70):
        kind = rng.choice(["Scanned", "Scanned", "Deleted", "Renamed"])
        rows.append((seq, kind, rng.choice(names), rng.choice(names) if kind == "Renamed" else None, rng.randint(1, 99)))
    assert {r[0]: r[1] for r in diff.merge_scan_messages(spark.createDataFrame(rows, LOG)).collect()} == replay(rows)
    several = [(0, "Scanned", "a/b/f", None, 1), (0, "Scanned", "c/b/f", None, 9), (1, "Renamed", "x", "a", 2), (1, "Renamed", "y", "a/b", 3), (1, "Renamed", "x", "c", 2), (2, "Deleted", "x/b/f", None, None), (3, "Scanned", "x/b/f", None, 4)]
    got = {r[0]: r[1] for r in diff.merge_scan_messages(spark.createDataFrame(several, LOG)).collect()}
    assert got == {"x": 2, "y": 3, "x/b/f": 4}


def test_later_rounds_of_renames_meet_only_what_moved(spark, monkeypatch):
    rows = [(k, "Scanned", f"still/{k % 500}", None, k) for k in range(3000)] + [(3000, "Scanned", "a0/f", None, 5)]
    rows += [(3001 + k, "Renamed", f"a{k + 1}", f"a{k}", k) for k in range(5)]
    written, cut = [], diff.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(diff, "cut", counted)
    monkeypatch.setattr(diff, "UNIONS", 2)
    got = {r[0]: r[1] for r in diff.merge_scan_messages(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {f"still/{k}": 2500 + k for k in range(500)} | {"a5/f": 5, "a5": 4}
    assert written[1] == 500 + 6 and sum(written) < 4 * len(rows) and all(n < 30 for n in written[2:]), written


def test_one_byte_among_many_chunks(spark):
    n = 100_000
    side = lambda bad: spark.range(n).select(F.lit("f").alias("relative_path"), (F.col("id") * 10).alias("offset"), F.when(F.col("id") == bad, F.lit("x")).otherwise(F.col("id").cast("string")).cast("binary").alias("data"))
    a, b = chunks.merkle_tree(side(-1), 10), chunks.merkle_tree(side(77_777), 10)
    unequal, compared = chunks.merkle_diff(a, b)
    assert [tuple(r) for r in unequal.collect()] == [("f", 77_777)]
    assert len(compared) == 4 and max(compared) <= 64 and a.where("level = 3").count() == 1
    assert a.groupBy("level").count().orderBy("level").collect()[0][1] == n
    plan = a._jdf.queryExecution().toString()
    assert "collect_list" not in plan  # each level is written; no later plan gathers digests


def test_trees_of_unlike_files(spark):
    def side(files):
        rows = [(p, at, bytearray(d[at : at + 4])) for p, d in files.items() for at in range(0, len(d), 4)]
        return spark.createDataFrame(rows, "relative_path string, offset long, data binary")

    rng = random.Random(9)
    one = {f"f{k}": rng.randbytes(rng.randint(1, 3000)) for k in range(12)}
    two = {p: d for p, d in one.items()}
    two["f1"] = one["f1"] + b"more" * 200
    two["f2"] = one["f2"][:-1]
    two["f3"] = bytes([one["f3"][0] ^ 1]) + one["f3"][1:]
    del two["f4"]
    two["new"] = b"n"
    files = spark.createDataFrame([(p,) for p in sorted({*one, *two, "none"})], "relative_path string")
    got = {r[0]: r[1] for r in chunks.full_check_trees(side(one), side(two), files, grid=8).collect()}
    want = {r[0]: r[1] for r in chunks.full_check_chunks(side(one), side(two), files, grid=8).collect()}
    assert got == want and got["f1"] == len(one["f1"]) and got["f3"] == 0 and got["f5"] is None
    assert chunks.merkle_diff(*[chunks.merkle_tree(side(x), 4, 4) for x in (one, two)], 4)[0].count() > 3
    empty = side(one).where("false")
    assert {r[1] for r in chunks.full_check_trees(empty, side(two), files, grid=8).collect()} == {0, None}
    assert chunks.tree_hash_chunks(empty).count() == 0


def test_bucketed_inventories_join_without_an_exchange(spark, small):
    for name in ("d2_diff_bucketed", "i2_quick_check_bucketed"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" in plan and "Exchange" not in plan, plan


def test_coverage_in_the_stream(spark, tmp_path):
    rng = random.Random(10)
    files = spark.createDataFrame([(f"f{k}", 100 + k) for k in range(8)] + [("never", 5)], "file string, size long")
    events = [(f"f{rng.randrange(9)}", a := rng.randint(-5, 110), a + rng.randint(-3, 30)) for _ in range(700)] + [(None, 0, 5), ("f1", None, 4)]
    batches = [events[k * 64 : (k + 1) * 64] + events[:5] for k in range(11)]
    schema = "file string, start long, end long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    cover, n = streams.stream_coverage(stream, files, f"{tmp_path}/out", compact=4)
    assert n == 11
    whole = spark.createDataFrame([e for b in batches for e in b], schema)
    want = sorted(map(tuple, streams.commit_coverage(whole, files).collect()))
    assert sorted(map(tuple, cover.report(n).collect())) == want and any(w[3] for w in want)
    told = sorted(map(tuple, cover.completed().collect()))
    assert sorted(t[0] for t in told) == sorted(w[0] for w in want if w[3])
    for number in (10, 8):  # batches that are run again write what they wrote
        cover.add(spark.read.parquet(f"{tmp_path}/in/{number:03d}"), number)
    assert sorted(map(tuple, cover.report(n).collect())) == want and sorted(map(tuple, cover.completed().collect())) == told


def test_retry_rounds_of_a_copy(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "tries").mkdir()
    for k in range(9):
        (tmp_path / "s" / f"f{k}").write_bytes(b"x" * k)
    rows = spark.createDataFrame([(f"f{k}", k) for k in range(9)] + [("gone", 1), (None, 1)], "relative_path string, size long")
    tries, waits = str(tmp_path / "tries"), []

    def flaky(path):
        import os

        seen = len([t for t in os.listdir(tries) if t.startswith(path + ".")])
        open(os.path.join(tries, f"{path}.{seen}"), "x").close()
        if path == "f8" or (path in ("f1", "f2", "f3") and seen < int(path[1])):
            raise OSError(110, "injected")

    work = lambda df: transfer.copy_files(df, str(tmp_path / "s"), str(tmp_path / "t"), tasks=3, before=flaky)
    got = {r[0]: (r.status, r.attempts) for r in outcomes.in_rounds(rows, work, wait=waits.append).collect()}
    assert got == {"f0": ("ok", 1), "f1": ("ok", 2), "f2": ("ok", 3), "f3": ("ok", 4), **{f"f{k}": ("ok", 1) for k in (4, 5, 6, 7)}, "f8": ("failed", 4), "gone": ("permanent", 1)}
    assert waits == [0.2, 0.5, 1.0] and sum(t.startswith("f4") for t in map(str, __import__("os").listdir(tries))) == 1


def test_error_kinds(spark):
    df = spark.createDataFrame([("[Errno 104] reset: 'x'",), ("TimedOut: y",), ("[Errno 2] No such file",), (None,), ("Odd: z",)], "e string")
    assert [r[0] for r in df.select(outcomes.error_kind(F.col("e"))).collect()] == ["ConnectionReset", "TimedOut", "Other", None, "Other"]


def test_top_renames(spark):
    pairs = [("a", "b"), ("a/x", "b/x"), ("a/x/1", "b/x/1"), ("a/y", "b/z"), ("a/y/2", "b/z/2"), ("c/k", "d/k"), ("a/x/3", "b/x/4")]
    got = {tuple(r) for r in diff.top_renames(spark.createDataFrame(pairs, "from_path string, to_path string")).collect()}
    assert got == {("a", "b"), ("a/y", "b/z"), ("c/k", "d/k"), ("a/x/3", "b/x/4")}


def test_lists_keep_their_order(spark):
    kind = "path string, pos long, trustee string, mask long, flags long, type long, protected boolean"
    src = spark.createDataFrame([("p", 2, "a", 1, 0, 0, False), ("p", 1, "z", 1, 0, 1, False), ("q", 1, "i", 1, 16, 0, True), ("r", 1, "i", 1, 16, 0, None)], kind)
    dst = spark.createDataFrame([("p", 5, "j", 1, 16, 0, False), ("p", 4, "k", 1, 16, 1, False), ("q", 1, "i", 1, 16, 0, False), ("r", 1, "i", 1, 16, 0, False), ("s", 1, "e", 1, 0, 0, None)], kind)
    got = {r.path: (r.only_src, r.only_dst, r.needs_update, r.merged) for r in acl.acl_diff(src, dst).collect()}
    assert got == {
        "p": (2, 0, True, ["[E] AccessDenied z ()", "[E] AccessAllowed a ()", "[I] AccessDenied k ()", "[I] AccessAllowed j ()"]),
        "q": (0, 0, True, ["[I] AccessAllowed i ()"]),
        "r": (0, 0, False, None),
        "s": (0, 1, True, []),
    }
    assert acl.acl_summary(src.drop("pos")).where("path = 'p'").first().entries == ["[E] AccessDenied z ()", "[E] AccessAllowed a ()"]


def test_names_that_clash(spark):
    df = spark.createDataFrame([("k", 1, 1, 1, 1, 1)], "relative_path string, _id long, _part long, _w_at long, _b_at long, at long")
    assert free(df, "_id", "_ID", "new") == ["_id_", "_ID__", "new"]
    assert order.running(df.drop("at"), ["relative_path"], {"at": F.lit(3)}).first().at == 0
    odd = df.selectExpr("relative_path", "1 AS place", "2 AS _rn", "'TimedOut' AS kind", "false AS hdfs", "9 AS wait", "3 AS _weight", "4 AS _before")
    clashing = spark.createDataFrame([("a", True, 0, 0, 5, 6, 7, 8), ("a/b.txt", False, 1, 0, 5, 6, 7, 8)], "relative_path string, is_dir boolean, size long, mtime_ns long, _parent int, own_dir int, go int, verdict int")
    assert sorted(map(tuple, tree.filter_tree(clashing, "size >= 0").collect())) == sorted(map(tuple, clashing.collect()))
    tags = spark.createDataFrame([("k", 1, "t", "v")], "relative_path string, pos int, tag string, value string")
    assert objects.join_tags(odd.withColumn("tags", F.lit(1)), tags, "relative_path").first().tag_text == "t=v"
    assert diff.latest(odd, "relative_path", ["place"]).columns == odd.columns
    assert outcomes.split_retryable(odd).select("wait").first()[0] == 9
    assert packing.pack(odd, F.col("_weight"), ["relative_path"], 2).first()[:] == odd.first()[:]
    assert planning.batch_keys(spark.createDataFrame([(None,), ("b",), ("a",), ("b",)], "key string"), 3).orderBy("batch_id").collect()[0].keys == [None, "a", "b"]
