"""Inventory tables: normalised listings, and inventories derived from the order and document tables.

The derivations are plain expressions that Spark and the checking SQL read alike, apart from the time stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.columns import path_components, path_depth, path_extension, path_name, path_parent, strip_root

_YMD = "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)"
_EXT = "CASE o_orderkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.log' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' ELSE '.parquet' END"
_PATH = f"concat('orders/', {_YMD}, '/c', o_custkey % 20, '/o', o_orderkey, {_EXT})"
SRC = {
    "relative_path": _PATH,
    "size": "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "mtime_ns": "{ns} + o_orderkey % 1000",
    "mode": "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 33188 ELSE 33152 END AS BIGINT)",
    "uid": "o_custkey",
    "gid": "o_custkey % 10",
    "ino": "o_orderkey",
}
DST = {
    "relative_path": f"CASE WHEN o_orderkey % 19 = 0 THEN replace({_PATH}, 'orders/', 'moved/') ELSE {_PATH} END",
    "size": SRC["size"] + " + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
    "mtime_ns": SRC["mtime_ns"] + " + CASE WHEN o_orderkey % 11 = 0 THEN 1000000000 ELSE 0 END + CASE WHEN o_orderkey % 23 = 0 THEN 500 ELSE 0 END",
    "mode": "CAST(CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 7 = 0) THEN 33188 ELSE 33152 END AS BIGINT)",
    "uid": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END",
    "gid": SRC["gid"],
    "ino": SRC["ino"],
}
EXTRA = {
    "relative_path": "concat('extra/c', c_custkey, '.dat')",
    "size": "c_custkey",
    "mtime_ns": "CAST(0 AS BIGINT)",
    "mode": "CAST(33188 AS BIGINT)",
    "uid": "c_custkey",
    "gid": "CAST(0 AS BIGINT)",
    "ino": "1000000000 + c_custkey",
}
_SPARK_NS, _SQL_NS = "unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000", "epoch_us(o_orderdate) * 1000"


def _select(exprs: dict[str, str], ns: str) -> list[str]:
    return [f"{e.replace('{ns}', ns)} AS {name}" for name, e in exprs.items()]


def inv_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_select(SRC, _SPARK_NS))


def inv_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 17 <> 0").selectExpr(*_select(DST, _SPARK_NS))
    more = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 = 0").selectExpr(*_select(EXTRA, _SPARK_NS))
    return kept.unionByName(more)


SQL_INV = f"""
inv_src AS (SELECT {', '.join(_select(SRC, _SQL_NS))} FROM orders),
inv_dst AS (SELECT {', '.join(_select(DST, _SQL_NS))} FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT {', '.join(_select(EXTRA, _SQL_NS))} FROM customer WHERE c_custkey % 10 = 0)"""


def normalize_entries(listing: DataFrame, backend: str, root: str = "") -> DataFrame:
    """A raw listing (path, size, mtime_ns and what else it has) as inventory rows below root.

    Backslashes become slashes; rows outside root get a null path in `error`. Missing times fall back on mtime for
    object stores and HDFS, where such entries also count as latest and as no delete marker.
    """
    raw = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    rel = strip_root(raw, root) if root else F.regexp_replace(raw, "^/+", "")
    has = set(listing.columns)
    opt = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    back = F.col("mtime_ns").cast("long") if backend in ("s3", "hdfs") else F.lit(None).cast("long")
    is_dir = F.coalesce(opt("is_dir", "boolean"), F.lit(False))
    return listing.select(
        F.lit(backend).alias("backend"),
        rel.alias("relative_path"),
        path_parent(rel).alias("parent_path"),
        path_name(rel).alias("name"),
        F.when(~is_dir, path_extension(rel, nfs=backend == "nfs")).alias("extension"),
        path_depth(rel).cast("long").alias("depth"),
        is_dir.alias("is_dir"),
        (F.coalesce(opt("is_symlink", "boolean"), F.lit(False)) if backend not in ("s3", "hdfs") else F.lit(False)).alias("is_symlink"),
        F.col("size").cast("long").alias("size"),
        F.col("mtime_ns").cast("long").alias("mtime_ns"),
        F.coalesce(opt("atime_ns", "long"), back if backend == "s3" else F.lit(None).cast("long")).alias("atime_ns"),
        F.coalesce(opt("ctime_ns", "long"), back).alias("ctime_ns"),
        *[opt(c, "long").alias(c) for c in ("mode", "uid", "gid", "ino")],
        F.coalesce(opt("is_latest", "boolean"), F.lit(True)).alias("is_latest"),
        F.coalesce(opt("is_delete_marker", "boolean"), F.lit(False)).alias("is_delete_marker"),
        F.when(rel.isNull(), F.concat(F.lit("outside root: "), raw)).alias("error"),
    )


def read_listing(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of any store Spark can list: path, size, mtime_ns. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def write_inventory(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """df as Parquet at path, replacing what is there; rows stay as they are, an empty table keeps its columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """df as the table `table` with its files at path, dealt into buckets by relative_path and sorted in them; the table, read.

    Inventories of the same number of buckets are joined by relative_path without an exchange, however often: the shuffle is
    paid once, when they are written. One file a bucket is written, so that buckets stay sorted.
    """
    df.repartition(buckets, "relative_path").sortWithinPartitions("relative_path").write.mode("overwrite").option("path", path).bucketBy(buckets, "relative_path").sortBy("relative_path").saveAsTable(table)
    return df.sparkSession.table(table)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """What write_inventory has written; partition columns come last, with types that Spark infers."""
    return spark.read.parquet(path)


def prefixes(path: Column) -> Column:
    """All proper prefixes of a path by component, as an array of paths."""
    c = path_components(path)
    return F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.array_join(F.slice(c, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def synthesize_dirs(files: DataFrame) -> DataFrame:
    """Directory rows (size 0, mtime 0) of an object listing: parents are made distinct before their own prefixes are."""
    own = files.where(~F.endswith("relative_path", F.lit("/"))).select(path_parent(F.col("relative_path")).alias("p")).where("p <> ''").distinct()
    every = own.select(F.explode(F.concat(prefixes(F.col("p")), F.array("p"))).alias("relative_path")).distinct()
    return every.select("relative_path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))


def limit_depth(df: DataFrame, max_depth: int | None) -> DataFrame:
    """Entries of at most max_depth components; 0 and None are no limit. With a limit null paths go."""
    return df.where(path_depth(F.col("relative_path")) <= max_depth) if max_depth else df


def subtree(df: DataFrame, sub_path: str) -> DataFrame:
    """The directory sub_path itself and all below it; an empty sub_path is everything, else null paths go."""
    p = sub_path.strip("/")
    return df.where((F.col("relative_path") == p) | F.startswith("relative_path", F.lit(p + "/"))) if p else df


def tree_stats(df: DataFrame) -> DataFrame:
    """Files, bytes and largest file by extension (the empty string: without one)."""
    return df.groupBy(F.coalesce(path_extension(F.col("relative_path")), F.lit("")).alias("extension")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def tree_totals(df: DataFrame) -> DataFrame:
    """One row: n_files, n_dirs, bytes, largest, deepest of entries (relative_path, is_dir, size); zeros for none."""
    d = F.coalesce(F.col("is_dir"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.agg(F.count_if(~d).alias("n_files"), F.count_if(d).alias("n_dirs"), zero(F.sum(F.when(~d, F.col("size")))).alias("bytes"), zero(F.max(F.when(~d, F.col("size")))).alias("largest"), zero(F.max(path_depth(F.col("relative_path")))).cast("long").alias("deepest"))


def rollup_sizes(df: DataFrame) -> DataFrame:
    """Files and bytes below every directory. Rows are summed by parent first, so only directories are exploded."""
    own = df.groupBy(path_parent(F.col("relative_path")).alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("m"))
    up = own.where("p <> ''").select(F.explode(F.concat(prefixes(F.col("p")), F.array("p"))).alias("dir_path"), "n", "b", "m")
    return up.groupBy("dir_path").agg(F.sum("n").alias("n_files"), F.sum("b").alias("bytes"), F.max("m").alias("largest"))
