"""Object stores: histories with delete markers, tags and the completeness of multipart uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def object_history(versions: DataFrame) -> DataFrame:
    """All rows (key, time_ns, size, version_id, is_marker) of keys whose newest row is no delete marker, with position
    from the oldest (1) and version_count over versions and markers; markers have size 0. Order: time, then versions
    before markers, then version_id and size."""
    order = Window.partitionBy("key").orderBy("time_ns", "is_marker", "version_id", "size")
    # the newest row per key by a partial aggregate, so that keys which end deleted are not sorted
    newest = versions.groupBy("key").agg(F.max(F.struct("time_ns", "is_marker")).alias("m"), F.count("*").alias("version_count"))
    alive = newest.where("NOT m.is_marker").select("key", "version_count")
    rows = versions.join(alive, "key").withColumn("position", F.row_number().over(order))
    return rows.select("key", "position", "time_ns", F.when(F.col("is_marker"), F.lit(0).cast("long")).otherwise(F.col("size")).alias("size"), "is_marker", "version_count")


def join_tags(objects: DataFrame, tags: DataFrame, key: str = "file") -> DataFrame:
    """objects with tags (array of tag, value in order of pos) and their text tag=value&...; null where there are none.
    Columns tags and tag_text that objects have already are replaced; a null key has no tags."""
    objects = objects.drop("tags", "tag_text")
    lists = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "value"))).alias("_t"))
    lists = lists.select(key, F.transform("_t", lambda t: F.struct(t["tag"].alias("tag"), t["value"].alias("value"))).alias("tags"))
    return objects.join(lists, key, "left").withColumn("tag_text", F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("="), t["value"])), "&"))


def can_complete(parts: DataFrame, files: DataFrame, part: int, key: str = "file") -> DataFrame:
    """key, complete: parts 1..n are all there, once each, with exact lengths. parts: key, part_number, part_len. A file
    without parts, of size 0 or of null size is not complete; a part without a number must be a whole one and counts for none, lengths
    that are null are not judged unless all are (an incomplete file). A file listed twice has its parts twice."""
    total = F.floor((F.col("size") + part - 1) / part).cast("long")
    # one sort of each side serves its window and the join: parts 1, 2, ... in their order, the least of another length, the last's
    w = Window.partitionBy(key).orderBy("part_number")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select(key, "part_number", "part_len", F.count("part_number").over(upto).alias("_n"))
    right = F.coalesce(F.col("part_number") == F.col("_n"), F.col("part_len") == part)
    short = F.min(F.when(F.col("part_len") != part, F.col("part_number"))).over(upto)
    told = placed.select(key, "part_len", "_n", F.bool_and(right).over(upto).alias("_run"), short.alias("_short"), F.count("part_len").over(upto).alias("_lens"), F.lead("_n").over(w).alias("_next"))
    last = told.where("_next IS NULL").select(key, "_n", "_run", "_short", "_lens", F.col("part_len").alias("_tail"))
    listed = Window.partitionBy(key).orderBy("size")
    same = F.count("*").over(listed.rangeBetween(Window.currentRow, Window.currentRow))
    once = files.select(key, "size", same.alias("_c"), (F.row_number().over(listed) == F.rank().over(listed)).alias("_first")).where("_first")
    exact = (F.col("_short").isNull() | (F.col("_short") >= total)) & (F.col("_tail").isNull() | (F.col("_tail") == F.col("size") - (total - 1) * part))
    whole = (F.col("_n") > 0) & (F.col("_n") == total) & F.col("_run") & (F.col("_lens") > 0) & exact & (F.col("_c") == 1)
    return once.join(last, key, "left").select(key, F.coalesce(whole, F.lit(False)).alias("complete"))
