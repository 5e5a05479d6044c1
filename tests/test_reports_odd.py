"""Cubes, field reports, carried values and page totals on odd rows."""

from haulage.operators import diff, integrity, order

INV = "relative_path string, size long, mtime_ns long, mode long, uid long, gid long, ino long"


def test_change_cube(spark):
    prev = spark.createDataFrame([("a/x", 1, 0, 0, 0, 0, 1), ("b/y", None, 0, 0, 0, 0, 2), (None, 9, 0, 0, 0, 0, 3)], INV)
    cur = spark.createDataFrame([("a/x", 5, 0, 0, 0, 0, 1), ("a/z", 2, 0, 0, 0, 0, 4)], INV)
    got = {(r.state, r.top): (r.n_entries, r.bytes) for r in diff.change_cube(diff.diff_inventories(prev, cur)).collect()}
    assert got[None, None] == (4, 16) and got[None, "a"] == (2, 7) and got["deleted", None] == (2, 9) and got["deleted", "?"] == (1, 9) and got["data_changed", "a"] == (1, 5)
    assert diff.change_cube(diff.diff_inventories(prev.where("false"), cur.where("false"))).where("n_entries > 0").count() == 0


def test_field_report(spark):
    rows = [("a/x", "metadata", "mtime,mode"), ("a/y", "metadata", "mode"), ("b", "ok", ""), (None, "size", "")]
    got = {(r.outcome, r.field, r.top): r.n_entries for r in integrity.field_report(spark.createDataFrame(rows, "relative_path string, outcome string, fields string")).collect()}
    assert got == {("metadata", "mode", "a"): 2, ("metadata", "mtime", "a"): 1, ("metadata", "mode", None): 2, ("metadata", "mtime", None): 1, ("ok", "", "b"): 1, ("ok", "", None): 1, ("size", "", "?"): 1, ("size", "", None): 1}


def test_carried_values(spark):
    acts = spark.createDataFrame([("n", "nas", "set_metadata"), ("s", "s3", "set_metadata"), ("h", "hdfs", "set_metadata"), ("h", "hdfs", "copy"), ("none", "nas", "set_metadata")], "relative_path string, src_kind string, action string")
    kind = "relative_path string, atime_ns long, mtime_ns long, uid long, gid long, mode long, owner string, owner_group string"
    entries = spark.createDataFrame([(p, 1, 2, 3, 4, 0o100644, "o", "") for p in "nsh"], kind)
    got = {r[0]: tuple(r)[1:] for r in diff.carried_values(acts, entries, "nas").collect()}
    assert got == {"n": (1, 2, 3, 4, 0o644, None, None), "s": (2, 2, None, None, None, None, None), "h": (None, 2, None, None, 0o644, None, None), "none": (None,) * 7}
    hdfs = {r[0]: tuple(r)[1:] for r in diff.carried_values(acts, entries.drop("atime_ns"), "hdfs").collect()}
    assert hdfs["h"] == (None, 2, None, None, 0o644, "o", None) and hdfs["s"] == (None, 2, None, None, None, None, None)
    assert diff.carried_values(acts, entries, "s3").where("mtime_ns IS NOT NULL").count() == 0


def test_page_totals(spark):
    tree = spark.createDataFrame([("a", True), ("a/f", False), ("b", True), ("c", False)], "relative_path string, is_dir boolean")
    rows, pages = order.number_pages(tree)
    most = max(max(r.gap_ndx, r.ndx_start + r.n_entries - 1) for r in pages.collect())
    assert tuple(order.page_totals(rows, pages).first()) == (pages.count(), rows.count(), most)
    assert tuple(order.page_totals(rows.where("false"), pages.where("false")).first()) == (0, 0, None)
