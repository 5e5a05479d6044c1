"""Structured comparison of two trees: kinds, sizes, metadata and content digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.columns import floor_div, trunc_div


def entry_kind(is_dir: Column, is_symlink: Column) -> Column:
    """directory, symlink or file; null flags count as false."""
    return F.when(is_dir, "directory").when(is_symlink, "symlink").otherwise("file")


def precision(ns: Column) -> Column:
    """The unit in which a time seems to be kept, in nanoseconds; zero seems exact, and so does null."""
    return F.when(ns == 0, 1).when(ns % 1_000_000_000 == 0, 1_000_000_000).when(ns % 1_000_000 == 0, 1_000_000).when(ns % 1000 == 0, 1000).otherwise(1).cast("long")


def mtime_matches(a: Column, b: Column, auto: bool = True, tolerance_ns: int = 0) -> Column:
    """Equal in the coarser of both apparent precisions (auto) or exactly, or at most the tolerance apart; null if a time is."""
    wide = lambda c: c.cast("decimal(20,0)")
    near = F.abs(wide(a) - wide(b)) <= F.lit(tolerance_ns)
    if not auto:
        return (a == b) | near
    unit = F.greatest(precision(a), precision(b))
    equal = F.when(unit == 1, a == b)
    for u in (1000, 1_000_000):
        equal = equal.when(unit == u, floor_div(a, u) == floor_div(b, u))
    return equal.otherwise(floor_div(a, 1_000_000_000) == floor_div(b, 1_000_000_000)) | near


def hdfs_mtime_match(src_ns: Column, dst_ns: Column, src_kind: Column, dst_kind: Column) -> Column:
    """Milliseconds agree where a side is hdfs, nanoseconds elsewhere; an s3 destination always matches. Null if a time is."""
    ms = trunc_div(src_ns, 1_000_000) == trunc_div(dst_ns, 1_000_000)
    return F.when(dst_kind == "s3", F.lit(True)).when((src_kind == "hdfs") | (dst_kind == "hdfs"), ms).otherwise(src_ns == dst_ns)


def metadata_mismatches(src: str, dst: str, tolerance_ns: int = 0, dst_kind: str = "nas", src_kind: str = "nas", symlinks: bool = False) -> Column:
    """Names of the differing fields in a fixed order: mtime, uid, gid, owner, group, mode.

    A time that only one side has differs. Numeric owners are compared where both sides have them, names always (a
    name that only one side has differs), both between like stores only. Modes are compared where both sides have one
    and neither is a symlink (is_symlink, where the structs hold it). Object-store destinations have nothing to compare.
    """
    if dst_kind == "s3":
        return F.array().cast("array<string>")
    s, d = (lambda c: F.col(f"{src}.{c}")), (lambda c: F.col(f"{dst}.{c}"))
    differ = lambda c: s(c).isNotNull() & d(c).isNotNull() & (s(c) != d(c))
    link = [F.coalesce(side["is_symlink"], F.lit(False)) for side in (F.col(src), F.col(dst))] if symlinks else [F.lit(False)]
    mode = ~reduce(lambda a, b: a | b, link) & s("mode").isNotNull() & d("mode").isNotNull() & (s("mode").bitwiseAND(F.lit(0o7777)) != d("mode").bitwiseAND(F.lit(0o7777)))
    both_none = s("mtime_ns").isNull() & d("mtime_ns").isNull()
    found = [F.when(~F.coalesce(mtime_matches(s("mtime_ns"), d("mtime_ns"), True, tolerance_ns), both_none), F.lit("mtime"))]
    if src_kind == dst_kind == "nas":
        found += [F.when(differ("uid"), F.lit("uid")), F.when(differ("gid"), F.lit("gid"))]
    if src_kind == dst_kind == "hdfs":
        found += [F.when(~s("owner").eqNullSafe(d("owner")), F.lit("owner")), F.when(~s("owner_group").eqNullSafe(d("owner_group")), F.lit("group"))]
    return F.array_compact(F.array(*found, F.when(mode, F.lit("mode"))))


def quick_check(src: DataFrame, dst: DataFrame, tolerance_ns: int = 0) -> DataFrame:
    """relative_path, outcome, fields: the first failing stage only (missing, kind, size, metadata), else ok.

    Kinds come from is_dir and is_symlink, where both sides have these columns (null: false); sizes are compared between
    files. What only one side knows fails: a size or a time that is null at one side differs from any other. Rows that
    repeat a path are compared each with each.
    """
    own = ["size", "mtime_ns", "mode", "uid", "gid"]
    kinds = all(c in df.columns for c in ("is_dir", "is_symlink") for df in (src, dst))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    more = [entry_kind(flag("is_dir"), flag("is_symlink")).alias("kind"), flag("is_symlink").alias("is_symlink")] if kinds else [F.lit("file").alias("kind")]
    side = lambda df, name: df.select("relative_path", F.struct(*own, *more).alias(name))
    both = side(src, "s").join(side(dst, "d"), "relative_path", "full_outer")
    stage = F.when(F.col("s").isNull(), "missing_source").when(F.col("d").isNull(), "missing_destination").when(F.col("s.kind") != F.col("d.kind"), "kind")
    stage = stage.when((F.col("s.kind") == "file") & ~F.col("s.size").eqNullSafe(F.col("d.size")), "size")
    both = both.withColumn("stage", stage)
    both = both.withColumn("fields", F.when(F.col("stage").isNull(), F.array_join(metadata_mismatches("s", "d", tolerance_ns, symlinks=kinds), ",")).otherwise(""))
    return both.select("relative_path", F.coalesce("stage", F.when(F.col("fields") != "", "metadata").otherwise("ok")).alias("outcome"), "fields")


def integrity_report(results: DataFrame) -> DataFrame:
    """Entries by outcome and top directory (null for a null path)."""
    return results.groupBy("outcome", F.substring_index("relative_path", "/", 1).alias("top")).agg(F.count("*").alias("n_entries"))


def field_report(results: DataFrame) -> DataFrame:
    """outcome, field, top, n_entries of quick_check's results: for each outcome and field that differs (an entry counts under
    each of its fields; the empty text: none), by top directory and over all (top null; a null path's top is `?`)."""
    top = F.coalesce(F.substring_index("relative_path", "/", 1), F.lit("?"))
    each = results.select("outcome", top.alias("top"), F.explode(F.split("fields", ",")).alias("field"))
    sums = each.groupBy("outcome", "field", "top").agg(F.count("*").alias("n"))
    by = sums.groupingSets([["outcome", "field", "top"], ["outcome", "field"]], "outcome", "field", "top")
    return by.agg(F.sum("n").alias("n_entries")).select("outcome", "field", "top", "n_entries")


def content_hash(content: Column) -> Column:
    """SHA-256 in hex; empty content has the empty digest, null content a null one."""
    return F.when(F.length(content) == 0, F.lit("")).otherwise(F.sha2(content, 256))


def verify_copy(src: DataFrame, dst: DataFrame) -> DataFrame:
    """relative_path, status: ok, missing, size or integrity; both sides hold relative_path, length, digest, src also size.

    Only what is known to be equal is ok: a null size or length counts as size, a null digest as integrity.
    """
    both = src.join(dst.select("relative_path", F.col("length").alias("d_length"), F.col("digest").alias("d_digest"), F.lit(True).alias("there")), "relative_path", "left")
    sized = F.coalesce((F.col("length") == F.col("size")) & (F.col("d_length") == F.col("size")), F.lit(False))
    same = F.coalesce(F.col("digest") == F.col("d_digest"), F.lit(False))
    status = F.when(F.col("there").isNull(), "missing").when(~sized, "size").when(~same, "integrity").otherwise("ok")
    return both.select("relative_path", status.alias("status"))


def copies_to_clean(verified: DataFrame) -> DataFrame:
    """The destination files that verification rejects and that are to be removed before another try."""
    return verified.where("status IN ('size', 'integrity')").select("relative_path")


def duplicate_content(files: DataFrame, content: str = "content") -> DataFrame:
    """(size, digest, n_files, first_path) of contents that occur more than once; files: relative_path, content.

    Only contents whose size occurs more than once are hashed. Empty and null contents are left out.
    """
    sized = files.withColumn("size", F.octet_length(content).cast("long")).where("size > 0")
    several = sized.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select("size")
    hashed = sized.join(several, "size", "left_semi").select("relative_path", "size", content_hash(F.col(content)).alias("digest"))
    return hashed.groupBy("size", "digest").agg(F.count("*").alias("n_files"), F.min("relative_path").alias("first_path")).where("n_files > 1")
