import time

import pytest
from pyspark.sql import functions as F

from haulage.operators import filters as fl

CASES = [
    ('path == "a/b/c"', None, "a", True, (True, True, True)),
    ('path == "a/b"', None, "x/y", False, (True, False, False)),
    ('path == "src/**"', None, "src/test.rs", False, (False, False, False)),
    (None, 'path == "tmp/**"', "tmp", True, (True, True, True)),
    (None, 'path == "tmp/**"', "tmp/a/b/c", True, (True, False, False)),
    ("dir_date <= 240301", None, "20240101", True, (False, True, False)),
    ("dir_date <= 240301", None, "20240501", True, (True, False, False)),
    ("dir_date <= 240301", None, "project", True, (False, True, True)),
    ('path == "a/**/c"', None, "a/c", False, (False, False, False)),
    ('path == "a/*/c"', None, "a/x/y/c", False, (True, False, False)),
    ("path == '*dir1*'", None, "dir1/subdir1", True, (False, True, False)),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_should_skip(spark, case):
    match, exclude, path, is_dir, want = case
    df = spark.createDataFrame([(path, is_dir, 1, 0)], "relative_path string, is_dir boolean, size long, mtime_ns long")
    assert tuple(df.select(fl.should_skip(match, exclude)).first()[0]) == want


def test_errors():
    for bad in ("foo", "size == 10MB", "type == pipe", "modified == 3d", "(size > 1", 'path == "a**/b"'):
        with pytest.raises(ValueError):
            fl.parse(bad) if bad == "foo" else fl.evaluate(bad)


# The verdict algebra as pairs of verdicts: left, right, and, or.
ALGEBRA = [
    (fl.PATH, fl.NONPATH, fl.MIXED, fl.PATH),
    (fl.PATH, fl.PATH, fl.PATH, fl.PATH),
    (fl.NONPATH, fl.MIXED, fl.MIXED, fl.NONPATH),
    (fl.PATH, fl.PARTIAL, fl.PARTIAL, fl.PATH),
    (fl.PARTIAL, fl.NONPATH, fl.PARTIAL, fl.NONPATH),
    (fl.FULL, fl.PATH, fl.FULL, fl.PATH),
    (fl.PATH, fl.OTHER, fl.OTHER, fl.PATH),
    (fl.FULL, fl.OTHER, fl.FULL, fl.FULL),
    (fl.OTHER, fl.OTHER, fl.OTHER, fl.OTHER),
    (fl.PARTIAL, fl.FULL, fl.FULL, fl.PARTIAL),
    (fl.LAZY, fl.PATH, fl.PATH, fl.PATH),
    (fl.LAZY, fl.OTHER, fl.OTHER, fl.OTHER),
]


def test_algebra(spark):
    df = spark.createDataFrame([(a, b) for a, b, _, _ in ALGEBRA], "a int, b int")
    got = df.select("a", "b", fl.verdict_and(F.col("a"), F.col("b")), fl.verdict_or(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == ALGEBRA


# path == '*dir1*' matches the directory and what lies in it, at any depth; a deeper pattern needs its own depth.
ANCESTORS = [
    ("path == '*dir1*'", "dir1", True, False),
    ("path == '*dir1*'", "dir1/file1.txt", False, False),
    ("path == '*dir1*'", "dir1/subdir1", True, False),
    ("path == '*dir1*'", "dir1/subdir1/deep.txt", False, False),
    ("path == '*dir1*'", "other/dir1", True, True),
    ("path == 'a/*/c'", "a/b/c/d.txt", False, False),
    ("path == 'a/*/c'", "a/b/d", False, True),
    ("path == 'a/**/c'", "a/x/y/c/z.txt", False, False),
    ("path != 'a/*'", "a/b", False, True),
    ("path != 'a/*'", "b/b", False, False),
]


@pytest.mark.parametrize("expr,path,is_dir,skip", ANCESTORS)
def test_ancestors(spark, expr, path, is_dir, skip):
    df = spark.createDataFrame([(path, is_dir, 1, 0)], "relative_path string, is_dir boolean, size long, mtime_ns long")
    assert df.select(fl.should_skip(expr, None)["skip"]).first()[0] == skip


def test_many_conditions_stay_small(spark):
    df = spark.createDataFrame([(f"f{i}", i, None if i % 3 else 0, i % 2 == 0) for i in range(1000)], "relative_path string, size long, mtime_ns long, is_symlink boolean")
    expr = " or ".join(f"(size > {k * 50} and size < {k * 50 + 10} and name != x)" for k in range(10))
    began = time.perf_counter()
    assert fl.filter_entries(df, expr).count() == 90
    assert time.perf_counter() - began < 10
    assert fl.filter_entries(df, "type == symlink").count() == 500
