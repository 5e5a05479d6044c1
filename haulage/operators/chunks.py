"""Content as chunk tables (relative_path, offset, data): comparison, order checks and tree hashes."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulage.functions.columns import trunc_div
from haulage.functions.shared import cut
from haulage.sources import store

GRID = 65_536


def cut_chunks(files: DataFrame, length: Column, piece, step: int) -> DataFrame:
    """relative_path, offset, data of files, `step` units each; piece(offset) is the data from there on."""
    rows = files.where(length > 0).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, F.lit(step).cast("long"))))
    return rows.select("relative_path", "offset", piece(F.col("offset")).alias("data"))


def read_chunks(spark: SparkSession, path: str, chunk: int = GRID, wanted: DataFrame | None = None, glob: str | None = None, tasks: int = 200) -> DataFrame:
    """relative_path (below path; its name, if path is a file), offset, data: the content of files in chunks.

    wanted (relative_path, start, end) restricts the reading to these half-open ranges, which may not overlap: only they
    are read, and chunks are cut at their ends. Ranges beyond the end and of missing files give nothing. Without
    it the tree is walked and every file (of the glob, by name; no links) is read whole. Files of any size are read by many
    tasks, by ranges of near equal bytes. Stores that only Spark opens (see sources.store) are read by its source of
    binary files instead: there a file that is wanted comes whole, and one of 2 GiB and more is an error.
    """
    if not store.opens(path):
        return _whole_files(spark, path, chunk, wanted, glob)
    root = store.mounted(path)
    one = root is not None and os.path.isfile(root)
    top = os.path.dirname(root) if one else path
    if wanted is not None:
        names = wanted.select("relative_path").where(F.col("relative_path") == os.path.basename(root)) if one else wanted
        return store.read_ranges(store.clipped(wanted, store.file_sizes(names, top, tasks)), top, chunk, tasks)
    if one:
        sizes = store.file_sizes(spark.createDataFrame([(os.path.basename(root),)], "relative_path string"), top, 1)
    else:
        entries, _ = store.walk(spark, path, tasks=tasks)
        sizes = entries.where("NOT is_dir AND NOT is_symlink AND error IS NULL").select("relative_path", "size")
    if glob:
        sizes = sizes.where(store.glob_matches(F.col("relative_path"), glob))
    return store.read_ranges(sizes.select("relative_path", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), top, chunk, tasks)


def _whole_files(spark: SparkSession, path: str, chunk: int, wanted: DataFrame | None, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    top = urlparse(path).path.rstrip("/")
    below = F.regexp_replace(F.col("path"), "^[^:]+:(?://[^/]*)?", "")
    name = F.when(below == top, F.substring_index(F.lit(top), "/", -1)).otherwise(F.substr(below, F.lit(len(top) + 2)))
    files = files.select(name.alias("relative_path"), "length", "content")
    if wanted is None:
        ranges = files.select("relative_path", "length", "content", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    else:
        ranges = files.join(wanted.select("relative_path", "start", F.col("end").alias("to")), "relative_path").select("relative_path", "length", "content", F.greatest("start", F.lit(0)).alias("start"), F.least("to", "length").alias("end"))
    cells = ranges.where("end > start").withColumn("cell", F.explode(F.sequence(trunc_div(F.col("start"), chunk), trunc_div(F.col("end") - 1, chunk))))
    low, high = F.greatest(F.col("start"), F.col("cell") * chunk), F.least(F.col("end"), (F.col("cell") + 1) * chunk)
    return cells.select("relative_path", low.alias("offset"), F.substring("content", (low + 1).cast("int"), (high - low).cast("int")).alias("data"))


def check_files(spark: SparkSession, files: DataFrame, src_root: str, dst_root: str, grid: int = GRID, tasks: int = 200) -> DataFrame:
    """full_check_chunks of the files (relative_path) of two trees: only they are read, on both sides."""
    whole = files.select("relative_path", F.lit(0).cast("long").alias("start"), F.lit(1 << 62).alias("end")).distinct()
    side = lambda root: read_chunks(spark, root, grid, whole, tasks=tasks)
    return full_check_chunks(side(src_root), side(dst_root), files, grid)


def on_grid(chunks: DataFrame, grid: int = GRID) -> DataFrame:
    """relative_path, cell, data: the same bytes in cells of `grid`, whatever the chunks were; a cell is the largest group."""
    size = F.length("data").cast("long")
    cells = chunks.where(size > 0).withColumn("cell", F.explode(F.sequence(trunc_div(F.col("offset"), grid), trunc_div(F.col("offset") + size - 1, grid))))
    low = F.greatest(F.col("offset"), F.col("cell") * grid)
    high = F.least(F.col("offset") + size, (F.col("cell") + 1) * grid)
    part = F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    parts = cells.select("relative_path", "cell", F.struct(low.alias("at"), part.alias("data")).alias("p"))
    whole = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    return parts.groupBy("relative_path", "cell").agg(whole.alias("data"))


def full_check_chunks(src: DataFrame, dst: DataFrame, files: DataFrame, grid: int = GRID) -> DataFrame:
    """relative_path, first_diff for each of `files`: the first offset where the sides differ or one ends; null if equal.

    Chunk boundaries of the sides need not agree. Only the first unequal cell of a file is searched byte by byte.
    """
    a, b = on_grid(src, grid), on_grid(dst, grid).withColumnRenamed("data", "other")
    bad = a.join(b, ["relative_path", "cell"], "full").where(~F.col("data").eqNullSafe(F.col("other")))
    first = bad.groupBy("relative_path").agg(F.min_by(F.struct("cell", F.coalesce("data", F.lit(b"")).alias("a"), F.coalesce("other", F.lit(b"")).alias("b")), "cell").alias("m"))
    x, y = F.col("m.a"), F.col("m.b")
    shared = F.least(F.length(x), F.length(y))
    unequal = F.filter(F.when(shared > 0, F.sequence(F.lit(1), shared)), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    at = F.col("m.cell") * grid + F.coalesce(F.get(unequal, F.lit(0)) - 1, shared)
    return files.select("relative_path").join(first.select("relative_path", at.cast("long").alias("first_diff")), "relative_path", "left")


def stream_shape_errors(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Per file of `files` (relative_path, size) and side with a fault: relative_path, side, error, at.

    chunks: relative_path, side, seq, offset, length. offset: the first chunk in seq order that does not start where
    its side's bytes read so far end; length: the side gave another number of bytes than expected (at: that number).
    An offset fault hides a later length fault of its side.
    """
    w = Window.partitionBy("relative_path", "side").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    read = chunks.withColumn("_read", F.coalesce(F.sum("length").over(w), F.lit(0)))
    sides = read.groupBy("relative_path", "side").agg(F.sum("length").alias("_got"), F.min_by("_read", F.when(F.col("offset") != F.col("_read"), F.col("seq"))).alias("_wrong"))
    both = sides.join(files.select("relative_path", "size"), "relative_path")
    error = F.when(F.col("_wrong").isNotNull(), "offset").when(F.col("_got") != F.col("size"), "length")
    return both.select("relative_path", "side", error.alias("error"), F.coalesce("_wrong", "_got").alias("at")).where("error IS NOT NULL")


FANOUT = 64


def merkle_tree(chunks: DataFrame, grid: int, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """relative_path, level, node, digest, n: the hash tree of every file over its chunks (relative_path, offset, data).

    Level 0 has the SHA-256 of each chunk, its node the chunk's number on the grid (units of offset); a node of the next level
    has that of its up to `fanout` children's digests in order, so no row holds more than fanout digests. All files have the
    same number of levels: `levels`, or what the file with most chunks needs; the top one has a node for each file. n counts
    the chunks below a node. Both sides need the same grid and one row a chunk. Each level is written once.
    """
    level = cut(chunks.select("relative_path", trunc_div(F.col("offset"), grid).alias("node"), F.sha2("data", 256).alias("digest"), F.lit(1).cast("long").alias("n")))
    out, k = [level.withColumn("level", F.lit(0))], 0
    most = level.agg(F.max("node")).first()[0] or 0
    while (most > 0) if levels is None else (k < levels):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x.digest)
        level = level.withColumn("parent", trunc_div(F.col("node"), fanout)).groupBy("relative_path", "parent").agg(F.sha2(F.array_join(parts, ""), 256).alias("digest"), F.sum("n").alias("n"))
        level = cut(level.select("relative_path", F.col("parent").alias("node"), "digest", "n"))
        most, k = most // fanout, k + 1
        out.append(level.withColumn("level", F.lit(k)))
    if most > 0:
        raise ValueError(f"{levels} levels are too few for {most} nodes above them")
    return reduce(DataFrame.unionByName, out).select("relative_path", "level", "node", "digest", "n")


def merkle_diff(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """(relative_path, node) of the unequal chunks of two hash trees, and how many pairs of nodes each level compared.

    From the top down only the children of unequal nodes are joined. Trees of different height are compared from the top of
    the lower one; nodes that one side lacks are unequal.
    """
    tops = [df.agg(F.max("level")).first()[0] for df in (a, b)]
    if None in tops:  # an empty side: all chunks of the other
        return a.unionByName(b).where("level = 0").select("relative_path", "node"), []
    unequal, compared = None, []
    for k in range(min(tops), -1, -1):
        x, y = (df.where(F.col("level") == k).select("relative_path", "node", F.col("digest").alias(name)) for df, name in ((a, "x"), (b, "y")))
        if unequal is not None:
            above = unequal.select("relative_path", F.col("node").alias("above"))
            x, y = (df.withColumn("above", trunc_div(F.col("node"), fanout)).join(above, ["relative_path", "above"], "left_semi").drop("above") for df in (x, y))
        both = cut(x.join(y, ["relative_path", "node"], "full_outer"))
        compared.insert(0, both.count())
        unequal = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("relative_path", "node")
    return unequal, compared


def tree_hash_chunks(chunks: DataFrame, grid: int = GRID, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """relative_path, n_chunks, digest: the top of each file's hash tree; both sides need the same grid, fanout and levels."""
    tree = merkle_tree(chunks, grid, fanout, levels)
    top = tree.agg(F.max("level")).first()[0] or 0
    return tree.where(F.col("level") == top).select("relative_path", F.col("n").alias("n_chunks"), "digest")


def full_check_trees(src: DataFrame, dst: DataFrame, files: DataFrame, grid: int = GRID) -> DataFrame:
    """full_check_chunks by hash trees: only the bytes of each file's first unequal cell are joined."""
    sides = [cut(on_grid(df, grid)) for df in (src, dst)]
    trees = [merkle_tree(df.select("relative_path", (F.col("cell") * grid).alias("offset"), "data"), grid) for df in sides]
    bad = merkle_diff(*trees)[0].groupBy("relative_path").agg(F.min("node").alias("cell"))
    wanted = [df.join(bad, ["relative_path", "cell"], "left_semi").select("relative_path", (F.col("cell") * grid).alias("offset"), "data") for df in sides]
    return full_check_chunks(*wanted, files, grid)
