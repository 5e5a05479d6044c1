"""What the operators share: table access, lineage cuts and byte-level word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 2 << 20
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir.

    In local mode, where there is one machine, a fresh temporary folder stands in for it; on a cluster an unset
    spark.checkpoint.dir is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="haulage-"))
    return _own_dir[0]


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; then delete the earlier cuts that nothing needs any more.

    The written files survive the loss of any executor, and the reread frame carries no partitioning, so a
    later join exchanges both sides and AQE may split a hot key. Shuffle files go when their query ends (a setting of
    the session); a stage whose files are gone is run again if it is needed again.
    """
    return cut_each([df], *spent)


def cut_each(frames: Iterable[DataFrame], *spent: DataFrame) -> DataFrame:
    """The cut of all frames (of one schema), written one after another: the shuffle files of one are gone before the
    next is run, so they never lie on disk together."""
    path = ""
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        path = path or f"{shared_dir(spark)}/haulage-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    drop_cuts(*spent)
    return out


def drop_cuts(*spent: DataFrame) -> None:
    """Delete the files of cuts whose dependants have all been written."""
    for df in spent:
        path = getattr(df, "cut_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, size: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow with batches of a few megabytes, however long the texts are (a setting of the session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker copies few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def fold(column, seed_mod: int):
    """crc32 of an id's decimal text, modulo seed_mod (null ids fold like the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % seed_mod
