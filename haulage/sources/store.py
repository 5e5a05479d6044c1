"""Trees of a store as tables: a distributed walk that prunes, sizes of named files, and byte ranges of their content.

A root is a path (or file: URI) of a file system that all machines mount, or a URI that pyarrow opens (s3, gs, hdfs). What
runs in tasks lists one directory, asks for one file or reads one range; which, is planned in tables.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.columns import trunc_div
from haulage.functions.shared import cut
from haulage.operators.filters import Inputs, should_skip
from haulage.operators.packing import pack

ENTRY = "relative_path string, is_dir boolean, is_symlink boolean, size long, mtime_ns long, atime_ns long, ctime_ns long, mode long, uid long, gid long, ino long, hard_links long, link string, error string"
_NAMES = [f.split()[0] for f in ENTRY.split(", ")]
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ENTRY.split(", ")])
#: Schemes that pyarrow opens; others are left to Spark's own source of binary files.
OPENED = ("s3", "gs", "gcs", "hdfs", "abfs", "abfss")
BATCH, SPAN = 8192, 32 << 20


def mounted(root: str) -> str | None:
    """The path of a root that all machines mount; None for a URI of another store."""
    parts = urlparse(root)
    if parts.scheme in ("", "file"):
        return os.path.normpath(unquote(parts.path) if parts.scheme else root)
    return None


def opens(root: str) -> bool:
    return mounted(root) is not None or urlparse(root).scheme in OPENED


def below(root: str, path: str) -> str:
    """root/path; an error if path leads out of root."""
    place = os.path.normpath(os.path.join(root, path))
    if place != os.path.normpath(root) and not place.startswith(os.path.normpath(root).rstrip("/") + "/"):
        raise OSError(f"outside root: {path}")
    return place


def _entry(path: str, info: os.stat_result, place: str) -> dict:
    link = stat.S_ISLNK(info.st_mode)
    return {
        "relative_path": path, "is_dir": stat.S_ISDIR(info.st_mode), "is_symlink": link, "size": 0 if stat.S_ISDIR(info.st_mode) else info.st_size, "mtime_ns": info.st_mtime_ns, "atime_ns": info.st_atime_ns, "ctime_ns": info.st_ctime_ns,
        "mode": info.st_mode, "uid": info.st_uid, "gid": info.st_gid, "ino": info.st_ino, "hard_links": info.st_nlink, "link": os.readlink(place) if link else None, "error": None,
    }


def _listed(root: str, folder: str) -> Iterator[dict]:
    """The entries of one directory; one that cannot be read, and entries that vanish meanwhile, are told as errors."""
    here = mounted(root)
    try:
        if here is None:
            store, base = fs.FileSystem.from_uri(root)
            for info in store.get_file_info(fs.FileSelector(below(base, folder))):
                yield {"relative_path": f"{folder}/{info.base_name}".lstrip("/"), "is_dir": info.type == fs.FileType.Directory, "is_symlink": False, "size": info.size or 0, "mtime_ns": info.mtime_ns}
            return
        with os.scandir(below(here, folder)) as found:
            for item in found:
                path = f"{folder}/{item.name}" if folder else item.name
                try:
                    yield _entry(path, item.stat(follow_symlinks=False), item.path)
                except OSError as e:
                    yield {"relative_path": path, "is_dir": False, "is_symlink": False, "error": str(e)}
    except OSError as e:
        yield {"relative_path": folder, "is_dir": True, "is_symlink": False, "error": str(e)}


def walk(spark: SparkSession, root: str, match: str | None = None, exclude: str | None = None, max_depth: int = 0, now: int = 0, tasks: int = 200) -> tuple[DataFrame, DataFrame]:
    """The entries below root that both filters keep (ENTRY), and the directories that were listed (level, relative_path,
    n_entries).

    Level by level: a table of directories is listed by many tasks, the filters judge what they found, and directories that
    may go on are the next table. So what is pruned is never listed, and no machine holds the tree. Directories below one that
    needs no checks are walked without. Links are told and not followed. What cannot be read is an entry with an error,
    whatever the filters say. One directory's entries come from one task, in batches. A root that is a file, is missing
    or is empty has no entries but, if missing, its error. Names that are no UTF-8 carry replacement signs and an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, checked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for e in _listed(root, folder):
                    try:
                        e["relative_path"].encode()
                    except UnicodeEncodeError:
                        e |= {"relative_path": e["relative_path"].encode(errors="replace").decode(), "error": "the name is no UTF-8", "is_dir": False}
                    if e.get("link"):
                        e["link"] = e["link"].encode(errors="replace").decode()
                    rows.append(e)
                    if len(rows) == BATCH:
                        yield told(rows, folder, checked)
                        rows = []
                if rows:
                    yield told(rows, folder, checked)

    def told(rows: list[dict], folder: str, checked: bool) -> pa.RecordBatch:
        own = [pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW]
        return pa.RecordBatch.from_arrays([*own, pa.array([folder] * len(rows)), pa.array([checked] * len(rows))], names=[*_NAMES, "folder", "checked"])

    frontier = spark.createDataFrame([("", True)], "relative_path string, checked boolean")
    kept, seen, level = [], [], 0
    filtered = any(e and e.strip() for e in (match, exclude))
    while not frontier.isEmpty():
        found = frontier.repartition(tasks if level > 1 else 1 if not level else min(tasks, 16)).mapInArrow(run, f"{ENTRY}, folder string, checked boolean")
        verdict = should_skip(match, exclude, Inputs.of(found, now)) if filtered else F.struct(F.lit(False).alias("skip"), F.lit(True).alias("continue_scan"), F.lit(False).alias("check_children"))
        judged, bad = cut(found.withColumn("v", verdict)), F.col("error").isNotNull()
        kept.append(judged.where(bad | ~(F.col("checked") & F.col("v.skip"))).select(*_NAMES))
        listed = frontier.select("relative_path").join(judged.groupBy(F.col("folder").alias("relative_path")).agg(F.count_if(~bad).alias("n_entries")), "relative_path", "left")
        seen.append(listed.select(F.lit(level).alias("level"), "relative_path", F.coalesce("n_entries", F.lit(0)).alias("n_entries")))
        level += 1
        go = ~bad & F.col("is_dir") & (~F.col("checked") | F.col("v.continue_scan"))
        if max_depth and level >= max_depth:
            break
        frontier = cut(judged.where(go).select("relative_path", (F.col("checked") & F.col("v.check_children")).alias("checked")))
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, seen)


def file_sizes(files: DataFrame, root: str, tasks: int = 200) -> DataFrame:
    """relative_path, size, mtime_ns of the distinct paths of files below root that are files there (links are followed);
    others, and paths that lead out of root, have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = mounted(root)
        store, base = (None, here) if here else fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    if here:
                        info = os.stat(below(base, path))
                        out += [(path, info.st_size, info.st_mtime_ns)] if stat.S_ISREG(info.st_mode) else []
                    else:
                        info = store.get_file_info(below(base, path))
                        out += [(path, info.size, info.mtime_ns)] if info.is_file else []
                except OSError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["relative_path", "size", "mtime_ns"])

    paths = files.select("relative_path").where("relative_path IS NOT NULL").distinct()
    return paths.repartition(tasks, "relative_path").mapInArrow(run, "relative_path string, size long, mtime_ns long")


def cut_ranges(ranges: DataFrame, span: int) -> DataFrame:
    """ranges (relative_path, start, end) cut at the multiples of span; empty and reversed ones go."""
    cells = ranges.where("end > start").select("relative_path", "start", "end", F.explode(F.sequence(trunc_div(F.col("start"), span), trunc_div(F.col("end") - 1, span))).alias("cell"))
    return cells.select("relative_path", F.greatest("start", F.col("cell") * span).alias("start"), F.least("end", (F.col("cell") + 1) * span).alias("end"))


def read_ranges(ranges: DataFrame, root: str, chunk: int, tasks: int = 200, span: int = SPAN) -> DataFrame:
    """relative_path, offset, data: the bytes of ranges (relative_path, start, end; half-open, inside the files, not
    overlapping), cut at the multiples of chunk.

    Ranges are cut into spans and the spans dealt to tasks by their bytes. A task seeks to its spans and reads nothing
    else; a file that is shorter than planned, or gone, is an error.
    """
    span = max(chunk, span // chunk * chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = mounted(root)
        store, base = (None, here) if here else fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if source:
                        source.close()
                    name, source = path, (open(below(base, path), "rb", buffering=0) if here else store.open_input_file(below(base, path)))
                source.seek(start)
                at = start
                while at < end:
                    data = b""
                    while len(data) < (want := min(end, (at // chunk + 1) * chunk) - at):
                        more = source.read(want - len(data))
                        if not more:
                            raise OSError(f"{path} ends at {at + len(data)}, before {end}")
                        data += more
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([data], pa.binary())], names=["relative_path", "offset", "data"])
                    at += len(data)
        if source:
            source.close()

    spans = cut_ranges(ranges, span)
    packed = pack(spans, F.col("end") - F.col("start"), ["relative_path", "start"], tasks)
    return packed.mapInArrow(run, "relative_path string, offset long, data binary")


def clipped(wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """The wanted ranges inside files of these sizes; what lies beyond an end, before 0 or in no file goes."""
    both = wanted.select("relative_path", "start", F.col("end").alias("to")).join(sizes.select("relative_path", "size"), "relative_path")
    return both.select("relative_path", F.greatest("start", F.lit(0)).alias("start"), F.least("to", "size").alias("end")).where("end > start")


def glob_matches(path: Column, glob: str) -> Column:
    """Whether the name of a path matches a glob."""
    from haulage.operators.filters import glob_regex

    return F.substring_index(path, "/", -1).rlike(glob_regex(glob))


