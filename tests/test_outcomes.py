"""Renames, copy errors and retries on small inputs."""

from haulage.operators import outcomes


def test_plan_renames(spark):
    pairs = spark.createDataFrame([("a", "a", 1), ("d", "d/e", 1), ("", "x", 1), ("a", "z", 1), ("a", "y", 2), ("big", "w", None), ("old", "new", 3), ("old", "a", 9), ("no", "nor", 1), (None, "q", 1)], "from_path string, to_path string, expected_size long")
    inventory = spark.createDataFrame([("a", 1), ("d", 1), ("big", outcomes.COPY_LIMIT + 1), ("new", 3)], "relative_path string, size long")
    got = {(r[0], r[1]): r[2] for r in outcomes.plan_renames(pairs, inventory).collect()}
    assert got == {("a", "a"): "noop", ("d", "d/e"): "subtree", ("", "x"): "subtree", ("a", "z"): "copy", ("a", "y"): "source_size", ("big", "w"): "ranges", ("old", "new"): "done", ("old", "a"): "destination_size", ("no", "nor"): "missing", (None, "q"): "missing"}


def test_retries_and_deletion(spark):
    errors = spark.createDataFrame([(1, "TimedOut", None), (2, "TimedOut", True), (3, None, False)], "id long, kind string, hdfs boolean")
    got = sorted(((r.id, r.attempt, r.delay_ms) for r in outcomes.split_retryable(errors).collect()), key=str)
    assert got == [(1, 1, 200), (1, 2, 500), (1, 3, 1000), (2, 0, None), (3, 0, None)]
    results = spark.createDataFrame([(1, True, True, False), (2, True, True, None), (3, True, False, False), (4, True, True, True)], "id long, verified boolean, committed boolean, reserve boolean")
    assert [r.id for r in outcomes.safe_to_delete_source(results).collect()] == [1]
