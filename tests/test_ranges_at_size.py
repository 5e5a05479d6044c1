"""Merged ranges and uploads: right on odd rows, by plans whose tasks hold one sorted copy of their rows."""

import random
import re

from pyspark.sql import functions as F

from haulage.operators import objects, planning
from haulage.streaming import jobs as streams

PART = 5


def nodes(df, name):
    return len(re.findall(rf"\b{name}\b[ (]", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


def test_coalesce_ranges_sorts_once(spark):
    rng = random.Random(7)
    rows = [(rng.choice(("a", "b", None, "c")), at := rng.choice((None, *range(60))), None if at is None or rng.random() < 0.05 else at + rng.randint(-1, 4)) for _ in range(400)]
    rows += rows[:80]
    want = set()
    for f in {r[0] for r in rows}:
        held = {x for g, a, z in rows if g == f and a is not None and z is not None for x in range(2 * a, 2 * z + 1) if z > a}
        want |= {(f, x // 2, next(y for y in range(x, 400) if y + 1 not in held) // 2) for x in held if x - 1 not in held}
    got = planning.coalesce_ranges(spark.createDataFrame(rows, "file string, start long, end long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["file", "start", "end"]
    assert nodes(got, "Sort") == 1 and nodes(got, "HashAggregate") == 0


def test_committed_parts_reads_parts_once(spark):
    parts = spark.createDataFrame([("a", 1, 5), ("a", 2, 2), ("b", 1, 5), ("b", 2, 5), ("c", 1, None), ("d", 1, 5), ("d", None, 5), ("x", 1, 5)], "file string, part_number long, part_len long")
    files = spark.createDataFrame([("a", 7), ("b", 7), ("c", 5), ("d", 5), ("e", 5)], "file string, size long")
    got = planning.committed_parts(parts, files, PART)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 0, 5), ("a", 5, 7), ("d", 0, 5), ("d", None, None)]
    assert nodes(got, "SortMergeJoin") + nodes(got, "BroadcastHashJoin") == 1


def old_can_complete(parts, files, part):
    """By joining every part first."""
    total = F.floor((F.col("size") + part - 1) / part).cast("long")
    exact = F.col("part_len") == F.least(F.lit(part).cast("long"), F.col("size") - (F.col("part_number") - 1) * part)
    both = files.join(parts, "file", "left").groupBy("file", "size").agg(F.count("part_number").alias("n"), F.min("part_number").alias("a"), F.max("part_number").alias("z"), F.count_distinct("part_number").alias("d"), F.bool_and(exact).alias("ok"))
    return both.select("file", F.coalesce((F.col("n") == total) & (F.col("d") == total) & (F.col("a") == 1) & (F.col("z") == total) & F.col("ok"), F.lit(False)).alias("complete"))


def test_can_complete_without_distinct_counts(spark):
    rng = random.Random(8)
    rows, sizes = [], []
    for f in range(400):
        size = rng.choice((0, None, *range(1, 18)))
        n = -(-(size or 0) // PART)
        own = [(f, k, min(PART, size - (k - 1) * PART)) for k in range(1, n + 1)]
        for _ in range(rng.choice((0, 0, 1, 2))):
            own.append((f, rng.choice((None, 0, 1, 2, 3, 9)), rng.choice((None, 1, 2, 5, 6))))
        if own and rng.random() < 0.3:
            own[rng.randrange(len(own))] = (f, own[0][1], rng.choice((None, 5, 1)))
        rows += own
        sizes += [(f, size)] * rng.choice((1, 1, 1, 2)) + [(f, 7)] * (rng.random() < 0.1)
    rows += [(None, 1, 5)]
    sizes += [(None, 5), (None, 5)]
    parts = spark.createDataFrame(rows, "file long, part_number long, part_len long")
    files = spark.createDataFrame(sizes, "file long, size long")
    got = objects.can_complete(parts, files, PART)
    told = sorted(map(tuple, got.collect()), key=str)
    assert told == sorted(map(tuple, old_can_complete(parts, files, PART).collect()), key=str)
    assert sum(c for _, c in told) > 50 and nodes(got, "HashAggregate") == 0


def test_coverage_leaves_null_ranges_out(spark, tmp_path):
    """As commit_coverage does, over two batches."""
    files = spark.createDataFrame([("a", 10), ("b", 10), ("c", 4)], "file string, size long")
    rows = [("a", None, 6), ("a", 4, None), ("b", -3, 5), ("x", 0, 3), ("b", 5, 12), ("b", 5, 12), ("a", 2, 3)]
    commits = spark.createDataFrame(rows, "file string, start long, end long")
    cover = streams.Coverage(files, f"{tmp_path}/cover")
    cover.add(spark.createDataFrame(rows[:4], commits.schema), 0)
    cover.add(spark.createDataFrame(rows[4:], commits.schema), 1)
    got = sorted(map(tuple, cover.report(2).collect()))
    assert got == [("a", 1, 1, False), ("b", 10, 1, True), ("c", 0, 0, False)] == sorted(map(tuple, streams.commit_coverage(commits, files).collect()))
