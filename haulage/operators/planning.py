"""Chunk and part arithmetic, missing ranges, tar layout and deletion plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.functions.columns import path_depth, trunc_div
from haulage.functions.names import free
from haulage.operators.order import running

MIB = 1 << 20
PARTS = 10_000


def _ceil_div(a: Column, b: int) -> Column:
    return trunc_div(a + F.lit(b - 1), b)


def _numbered(rows: DataFrame, n: Column, name: str, first: int = 0) -> DataFrame:
    """rows, each n times (n >= 1), with the numbers from `first` on. Blocks of 65536 numbers are made before the numbers
    themselves, so no row ever holds one array of them all."""
    block = 1 << 16
    count, number = free(rows, "count", "block")
    own = rows.withColumn(count, n).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), trunc_div(F.col(count) - 1, block))))
    low = F.col(number) * block
    return own.withColumn(name, F.explode(F.sequence(low + first, F.least(low + block, count) - 1 + first))).drop(count, number)


def plan_chunks(files: DataFrame, block_size: int = 2 * MIB) -> DataFrame:
    """relative_path, chunk, start, end: half-open ranges, the last one the remainder; none for empty files or null sizes."""
    rows = _numbered(files.where("size > 0").select("relative_path", "size"), _ceil_div(F.col("size"), block_size), "chunk")
    return rows.select("relative_path", "chunk", (F.col("chunk") * block_size).alias("start"), F.least((F.col("chunk") + 1) * block_size, "size").alias("end"))


def part_size(size: Column, block_size: int = 5 * MIB) -> Column:
    """At least the block, and whole MiB so that no more than 10000 parts are needed; a null size gets the block."""
    return F.greatest(F.lit(block_size).cast("long"), _ceil_div(_ceil_div(size, PARTS), MIB) * MIB)


def _parts(files: DataFrame, part: Column, low: int, high: int) -> DataFrame:
    sized = files.where("size > 0").select("relative_path", "size", part.alias("part"))
    n = F.expr("(size + part - 1) div part")
    bad = F.when(~F.col("part").between(low, high), F.concat(F.lit("part size "), F.col("part").cast("string"), F.lit(f" is not within {low} and {high}")))
    bad = bad.when(n > PARTS, F.concat(n.cast("string"), F.lit(f" parts are more than {PARTS}")))
    sized = sized.withColumn("error", bad)
    return _numbered(sized, F.when(F.col("error").isNull(), n).otherwise(F.lit(1).cast("long")), "part_number", 1)


def plan_parts(files: DataFrame, block_size: int = 5 * MIB) -> DataFrame:
    """relative_path, part_number (from 1), start, part_len: none for empty files or null sizes."""
    rows = _parts(files, part_size(F.col("size"), block_size), 1, 1 << 62)
    start = (F.col("part_number") - 1) * F.col("part")
    return rows.select("relative_path", "part_number", start.alias("start"), F.least(F.col("size") - start, "part").alias("part_len"))


#: Sizes that a part of a server-side copy may have.
COPY_PART = (5 * MIB, 5 << 30)


def copy_ranges(files: DataFrame, requested: int = 5 * MIB) -> DataFrame:
    """relative_path, part_number, bytes, error: closed ranges for server-side copies, of the requested size or, where
    that would make over 10000 parts, the size's 10000th part. Where such a part may not be (under 5 MiB or over 5 GiB)
    a file has one row with part_number and bytes null and the error."""
    rows = _parts(files, F.greatest(F.lit(requested).cast("long"), _ceil_div(F.col("size"), PARTS)), *COPY_PART)
    start = (F.col("part_number") - 1) * F.col("part")
    text = F.concat(F.lit("bytes="), start, F.lit("-"), F.least(start + F.col("part"), "size") - 1)
    good = F.col("error").isNull()
    return rows.select("relative_path", F.when(good, F.col("part_number")).alias("part_number"), F.when(good, text).alias("bytes"), "error")


def upload_route(files: DataFrame) -> DataFrame:
    """relative_path, route: server_copy between buckets of one endpoint, relay between others (both without a rate
    limit; columns src_endpoint and dst_endpoint, null: no object store), else single or multipart by size."""
    sized = F.when(F.col("size") <= 5 * MIB, "single").otherwise("multipart")
    if not {"src_endpoint", "dst_endpoint", "limited"} <= set(files.columns):
        return files.select("relative_path", sized.alias("route"))
    stores = F.col("src_endpoint").isNotNull() & F.col("dst_endpoint").isNotNull() & ~F.coalesce("limited", F.lit(False))
    return files.select("relative_path", F.when(stores & (F.col("src_endpoint") == F.col("dst_endpoint")), "server_copy").when(stores, "relay").otherwise(sized).alias("route"))


def check_accounting(committed: DataFrame, planned: DataFrame, key: str = "file") -> DataFrame:
    """key, expected, actual, ok: bytes that a session planned to send (missing ranges) against those it committed,
    repeats included; a file with nothing on one side counts 0 there."""
    total = lambda df, name: df.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    both = total(planned, "expected").join(total(committed, "actual"), key, "full_outer")
    both = both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.withColumn("ok", F.col("expected") == F.col("actual"))


def coalesce_ranges(commits: DataFrame, key: str = "file") -> DataFrame:
    """key, start, end: merged coverage of possibly repeated and overlapping ranges (touching ones merge).
    Empty, reversed and null ranges are left out; a null key is one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = commits.where("end > start").select(key, "start", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"), F.max("end").over(every).alias("_last"), "end")
    # what was seen before the next island ends this one; rows stay sorted, so one sort serves both windows
    first = seen.where("_seen IS NULL OR start > _seen")
    return first.select(key, "start", F.coalesce(F.lead("_seen").over(w), "_last").alias("end"))


def missing_intervals(committed: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """key, start, end: the complement of the committed ranges in [0, size); the whole file where none is.
    Commits of files that are not listed, and files without a size, give nothing."""
    inside = committed.join(files.select(key, "size"), key).select(key, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "size").alias("end")).where("end > start")
    ends = inside.unionByName(files.where("size > 0").select(key, F.col("size").alias("start"), F.col("size").alias("end")))
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ends.withColumn("_from", F.coalesce(F.max("end").over(w), F.lit(0)))
    return gaps.where("start > _from").select(key, F.col("_from").alias("start"), F.col("start").alias("end"))


def interval_bytes(intervals: DataFrame, key: str = "file") -> DataFrame:
    """key, bytes, n_intervals; a null end counts no bytes."""
    return intervals.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("*").alias("n_intervals"))


def prefix_missing(part_files: DataFrame, files: DataFrame) -> DataFrame:
    """relative_path, start, end left to copy after a partial file of length part_len (null: absent)."""
    both = files.join(part_files, "relative_path", "left")
    start = F.when(F.col("part_len").isNull() | (F.col("part_len") > F.col("size")), F.lit(0).cast("long")).otherwise(F.col("part_len"))
    return both.select("relative_path", start.alias("start"), F.col("size").alias("end")).where("start < end")


def committed_parts(parts: DataFrame, files: DataFrame, part: int, key: str = "file") -> DataFrame:
    """Ranges of uploaded parts (key, part_number, part_len); one bad part invalidates the whole upload
    (a part with a null number or length is left out of the judgement); uploads of unlisted files are left out."""
    total = _ceil_div(F.col("size"), part)
    both = parts.join(files.select(key, "size"), key)
    good = (F.col("part_number") >= 1) & (F.col("part_number") <= total) & (F.col("part_len") == F.least(F.lit(part).cast("long"), F.col("size") - (F.col("part_number") - 1) * part))
    judged = both.withColumn("_ok", F.bool_and(good).over(Window.partitionBy(key)))
    return judged.where("_ok").select(key, ((F.col("part_number") - 1) * part).cast("long").alias("start"), ((F.col("part_number") - 1) * part + F.col("part_len")).cast("long").alias("end"))


def pick_uploads(uploads: DataFrame, key: str = "key") -> DataFrame:
    """Of each key's open uploads the newest is kept, the others are to be aborted. Null times are the oldest, equal times go by
    upload_id; a null key is one; rows that are equal in all of it are kept once."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("initiated"), F.desc("upload_id")))
    return uploads.withColumn("action", F.when(rn == 1, "keep").otherwise("abort"))


def validate_prior_state(states: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """files (key, size) with error: null where there is no prior state (key, state: JSON with size) or its size still
    holds. A state of unreadable JSON or without a size is an error; of several states of a key the greatest text counts."""
    prior = states.groupBy(key).agg(F.max("state").alias("_s")).select(key, F.col("_s"), F.from_json("_s", "size long")["size"].alias("_was"))
    both = files.join(prior, key, "left")
    bad = F.when(F.col("_s").isNull(), None).when(F.col("_was").isNull(), "unreadable state")
    return both.select(key, "size", bad.when(F.col("_was") != F.col("size"), F.concat(F.lit("size changed: was "), F.col("_was").cast("string"), F.lit(", now "), F.col("size").cast("string"))).alias("error"))


def tar_blocks(size: Column, is_file: Column | None = None) -> Column:
    """Bytes of a member: its header, and for regular files the content in blocks of 512."""
    content = _ceil_div(F.coalesce(size, F.lit(0)), 512) * 512
    return F.lit(512) + (content if is_file is None else F.when(is_file, content).otherwise(0))


def _tar_kinds(entries: DataFrame) -> tuple[Column, Column]:
    """Whether a member is a regular file, and its type flag; without the columns every member is one."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in entries.columns else F.lit(False)
    kind = F.when(flag("is_dir"), "5").when(flag("is_symlink"), "2").otherwise("0")
    return ~flag("is_dir") & ~flag("is_symlink"), kind


def tar_size(entries: DataFrame, package: str = "package") -> DataFrame:
    """package, tar_bytes, n_members; null sizes count 0."""
    is_file, _ = _tar_kinds(entries)
    return entries.groupBy(package).agg((F.sum(tar_blocks(F.col("size"), is_file)) + 1024).alias("tar_bytes"), F.count("*").alias("n_members"))


def tar_manifest(entries: DataFrame, package: str = "package") -> DataFrame:
    """package, member, type_flag, size, header_offset: members by path, offsets as a running sum inside the package.
    Directories (flag 5) and links (2) have a header only; a null size counts 0, a null path has a null member."""
    is_file, flag = _tar_kinds(entries)
    member = F.substr("relative_path", F.length(package) + 2)
    w = Window.partitionBy(package).orderBy("relative_path").rowsBetween(Window.unboundedPreceding, -1)
    return entries.select(package, member.alias("member"), flag.alias("type_flag"), "size", F.coalesce(F.sum(tar_blocks(F.col("size"), is_file)).over(w), F.lit(0)).alias("header_offset"))


def plan_delete(entries: DataFrame, prefix: str = "") -> DataFrame:
    """relative_path, is_dir, wave: deeper entries first, so children go before their directories. A null is_dir is a file, a
    null path goes with the last wave of none (null); no entries make no plan."""
    own = entries.where(F.startswith("relative_path", F.lit(prefix + "/")) | (F.col("relative_path") == prefix)) if prefix else entries
    depth = path_depth(F.col("relative_path")) * 2 + F.when(F.col("is_dir"), 0).otherwise(1)
    most = own.agg(F.max(depth)).first()[0] or 0
    return own.select("relative_path", "is_dir", (F.lit(most) - depth).cast("long").alias("wave"))


def batch_keys(keys: DataFrame, batch: int = 100) -> DataFrame:
    """(batch_id, n_keys, keys): the keys in their order, `batch` to a batch from number 0 on; only the last has fewer.
    Repeated keys count each, null keys come first, and no keys make no batch."""
    numbered = running(keys.select("key"), ["key"], {"at": None})
    return numbered.groupBy(trunc_div(F.col("at"), batch).alias("batch_id")).agg(F.count("*").alias("n_keys"), F.transform(F.array_sort(F.collect_list(F.struct("key"))), lambda k: k.key).alias("keys"))


def reconcile_delete(requested: DataFrame, failed: DataFrame) -> DataFrame:
    """relative_path, error: null where the deletion succeeded. Repeated requests stay, of repeated failures one counts; a null
    path has no failure."""
    return requested.select("relative_path").join(failed.select("relative_path", "error").dropDuplicates(["relative_path"]), "relative_path", "left")


def live_versions(versions: DataFrame) -> DataFrame:
    """Versions (key, time_ns, size, version_id, is_marker) of keys whose newest marker is not newer than the newest
    version; version_count counts versions, is_latest marks the last by (time, version_id). A null key is one, null
    times are the oldest, and a null is_marker is neither and gives no row. One exchange by key serves all of it."""
    w = Window.partitionBy("key")
    newest = lambda marker: F.coalesce(F.max(F.when(F.col("is_marker") == marker, F.col("time_ns"))).over(w), F.lit(0))
    order = w.orderBy("is_marker", F.desc("time_ns"), F.desc("version_id"), F.desc("size"))
    told = versions.withColumns({"_m": newest(True), "_v": newest(False), "version_count": F.count_if(~F.col("is_marker")).over(w), "_rn": F.row_number().over(order)})
    return told.where("NOT is_marker AND _m <= _v").select("key", "time_ns", "size", "version_id", "version_count", (F.col("_rn") == 1).alias("is_latest"))
