"""Copies and tar archives on file systems that all machines mount. A task that runs again writes the same bytes.

Files are cut into pieces, and pieces are dealt to tasks by their bytes, so one large file is written by many tasks. Pieces go
to their places in a sibling of the target; only when all pieces of a file are in place, in a second step, it is renamed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.shared import cut
from haulage.operators import planning
from haulage.operators.blobs import tar_header
from haulage.operators.packing import pack
from haulage.sources.store import below, cut_ranges, file_sizes

BLOCK, PIECE = 2 << 20, 64 << 20
_SENT = "relative_path string, start long, end long, bytes long, mtime_ns long, error string"
_DONE = "relative_path string, bytes long, error string"


def _stretch(fd: int, start: int, end: int | None) -> Iterator[bytes]:
    """The bytes of an open file from start to end (None: its end)."""
    while end is None or start < end:
        data = os.pread(fd, BLOCK if end is None else min(BLOCK, end - start), start)
        if not data:
            return
        yield data
        start += len(data)


def _put(fd: int, data: bytes, at: int) -> int:
    done = 0
    while done < len(data):
        done += os.pwrite(fd, memoryview(data)[done:], at + done)
    return done


def _digest(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
    return h.hexdigest()


def _outcome(work, *args) -> tuple:
    try:
        return work(*args), None
    except (OSError, ValueError) as e:
        return None, str(e)


def _write_piece(source: str, part: str, size: int | None, start: int, end: int | None, verify: bool) -> tuple[int, int, str]:
    """Copy a stretch of source to its place in part: bytes, the source's time and the digest."""
    from_fd = os.open(source, os.O_RDONLY)
    try:
        info = os.fstat(from_fd)
        if size is not None and info.st_size != size:
            raise OSError(f"size changed: was {size}, now {info.st_size}")
        os.makedirs(os.path.dirname(part), exist_ok=True)
        to_fd = os.open(part, os.O_RDWR | os.O_CREAT, 0o600)
        try:
            h, n = hashlib.sha256(), 0
            for piece in _stretch(from_fd, start, end):
                n += _put(to_fd, piece, start + n)
                h.update(piece)
            os.fsync(to_fd)
            if n != (info.st_size if end is None else end) - start or (verify and _digest(_stretch(to_fd, start, start + n)) != h.hexdigest()):
                raise OSError("the copy differs from its source")
        finally:
            os.close(to_fd)
        return n, info.st_mtime_ns, h.hexdigest()
    finally:
        os.close(from_fd)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _each(rows: DataFrame, work: Callable[[dict], tuple], schema: str) -> DataFrame:
    """One outcome row for each row, made in the row's task and written once: later actions only read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([work(row)], schema)

    return cut(rows.mapInArrow(run, schema))


def _pieces(files: DataFrame, piece: int) -> DataFrame:
    """(relative_path, size, start, end) of files; empty files have one empty piece, those of null size one without an end."""
    size = F.col("size")
    cuts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(piece).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return files.select("relative_path", "size", F.explode(cuts).alias("start")).withColumn("end", F.least(F.col("start") + piece, "size") if piece else F.col("size")).withColumn("end", F.when(size.isNotNull(), F.col("end")))


def _finish(source: str, target: str, part: str, size: int, mtime: int | None, delete: bool) -> int:
    """Give a complete part its name, mode and times; found done, it is done."""
    if os.path.exists(part):
        info = os.stat(source)
        if info.st_size != size or (mtime is not None and info.st_mtime_ns != mtime):
            raise OSError("the source changed meanwhile")
        if os.path.getsize(part) != size:
            raise OSError(f"{os.path.getsize(part)} bytes of {size} are there")
        os.chmod(part, info.st_mode & 0o7777)
        os.utime(part, ns=(info.st_atime_ns, info.st_mtime_ns))
        os.replace(part, target)
    elif not os.path.exists(target) or os.path.getsize(target) != size:
        raise OSError("the copy is missing")
    if delete and os.path.exists(source):
        os.remove(source)
    return size


def _forget(part: str) -> None:
    try:
        os.remove(part)
    except OSError:
        pass


def copy_files(manifest: DataFrame, src_root: str, dst_root: str, verify: bool = True, delete_source: bool = False, tasks: int = 200, piece: int = PIECE, before: Callable[[str], None] | None = None) -> DataFrame:
    """relative_path, bytes, error: one row per file of manifest (relative_path, size; repeats count once); failures never end
    the job. The work is done once, when this is called; the result is a table.

    Pieces go to a sibling of the target, are read again, and when all of a file's are in place it gets its mode,
    times and name. A file that failed leaves no sibling, and its target as it was; sources go only after a verified
    copy. A source that is gone beside a target of the same size counts as done, so retries succeed. A null
    size is any size, copied by one task. Null paths and paths that leave the roots are errors; an empty manifest does nothing.
    before(path) is called ahead of each piece; an OSError of its own fails the piece.
    """
    run_id = uuid.uuid4().hex
    part = lambda target: f"{target}.{run_id}.part"

    def send(row: dict) -> tuple:
        path, size, start, end = row["relative_path"], row["size"], row["start"], row["end"]

        def work() -> tuple:
            if path is None:
                raise OSError("no path")
            if before:
                before(path)
            source, target = below(src_root, path), below(dst_root, path)
            if delete_source and not os.path.exists(source) and os.path.exists(target) and os.path.getsize(target) == size:
                return (end or 0) - start, None
            return _write_piece(source, part(target), size, start, end, verify)[:2]

        done, error = _outcome(work)
        return (path, start, end, *(done or (None, None)), error)

    def finish(row: dict) -> tuple:
        path, error = row["relative_path"], row["error"]
        if path is None:
            return None, None, error
        if not error:
            n, error = _outcome(lambda: _finish(below(src_root, path), below(dst_root, path), part(below(dst_root, path)), row["bytes"], row["high"], delete_source and verify))
            if not error:
                return path, n, None
        _outcome(lambda: _forget(part(below(dst_root, path))))
        return path, None, error

    files = manifest.select("relative_path", F.col("size").cast("long").alias("size")).distinct()
    sent = _each(pack(_pieces(files, piece), F.col("end") - F.col("start"), ["relative_path", "start"], tasks), send, _SENT)
    error = F.coalesce(F.min("error"), F.when(F.min("mtime_ns") != F.max("mtime_ns"), "the source changed meanwhile"))
    whole = sent.groupBy("relative_path").agg(F.sum("bytes").alias("bytes"), F.max("mtime_ns").alias("high"), error.alias("error"))
    return _each(whole.repartition(tasks, "relative_path"), finish, _DONE)


class Resumed(NamedTuple):
    """What a resumable copy did: files (relative_path, bytes, error), what it planned to send and what it sent (relative_path,
    start, end; sent also bytes, mtime_ns, error)."""

    files: DataFrame
    planned: DataFrame
    sent: DataFrame


_COMMIT = "relative_path string, size long, mtime_ns long, start long, end long, sha256 string"


def read_commits(spark, state_root: str) -> DataFrame:
    """The commits that tasks have noted in a folder; a line that was broken off is none."""
    folder = os.path.join(state_root, "commits")
    os.makedirs(folder, exist_ok=True)
    rows = spark.read.schema(_COMMIT).option("mode", "PERMISSIVE").json(f"file://{os.path.abspath(folder)}")
    return rows.where("relative_path IS NOT NULL AND sha256 IS NOT NULL")


def copy_resumable(manifest: DataFrame, src_root: str, dst_root: str, state_root: str, verify: bool = True, tasks: int = 200, piece: int = 8 << 20, stop: Callable[[str, int], bool] | None = None) -> Resumed:
    """A copy of manifest (relative_path) that goes on where an earlier one with the same state_root broke off.

    Every piece that is safely in place is noted: a task appends a line (path, size and time of the source, start, end,
    digest) to its own file in state_root/commits. A later run sends only what no note covers, if the source still has the
    noted size and time and the unfinished target (`.resume.part` beside the target) is there; it reads each noted
    piece again, with verify, before the file gets its name, and a piece that no longer has its digest is an error whose
    notes stop counting: the unfinished target goes, and the next run sends the whole file. A target of its source's size
    and time is done. Failed pieces are errors of their files and cost nothing else. Null paths are left out, missing sources
    are errors. stop(path, start) may end the work of a piece as a failure (for tests and drains).
    """
    spark = manifest.sparkSession
    part = lambda path: below(dst_root, path) + ".resume.part"
    notes = os.path.join(state_root, "commits")
    wanted = manifest.select("relative_path").where("relative_path IS NOT NULL").distinct()
    commits = cut(read_commits(spark, state_root))
    known = file_sizes(wanted, src_root, tasks)
    there = file_sizes(wanted, dst_root, tasks).select("relative_path", F.col("size").alias("there"), F.col("mtime_ns").alias("since"))
    begun = file_sizes(wanted.withColumn("relative_path", F.concat("relative_path", F.lit(".resume.part"))), dst_root, tasks)
    begun = begun.select(F.regexp_replace("relative_path", r"\.resume\.part$", "").alias("relative_path"), F.col("size").alias("begun"))
    files = cut(wanted.join(known, "relative_path", "left").join(there, "relative_path", "left").join(begun, "relative_path", "left"))
    done = F.coalesce((F.col("there") == F.col("size")) & (F.col("since") == F.col("mtime_ns")), F.lit(False))
    open_files = files.where(F.col("size").isNotNull() & ~done)
    same = commits.join(open_files.where("begun IS NOT NULL"), ["relative_path", "size", "mtime_ns"]).where("end <= begun")
    covered = cut(same.select("relative_path", "start", "end", "sha256"))
    planned = cut(planning.missing_intervals(covered.select("relative_path", "start", "end"), open_files.select("relative_path", "size"), "relative_path"))

    def send_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note = None
        for batch in batches:
            for row in batch.to_pylist():
                path, start, end = row["relative_path"], row["start"], row["end"]

                def work() -> tuple:
                    if stop and stop(path, start):
                        raise OSError("stopped")
                    n, mtime, digest = _write_piece(below(src_root, path), part(path), row["size"], start, end, verify)
                    if mtime != row["mtime_ns"]:
                        raise OSError("the source changed meanwhile")
                    return n, mtime, digest

                got, error = _outcome(work)
                if got:
                    if note is None:
                        note = open(os.path.join(notes, f"{uuid.uuid4().hex}.json"), "a", encoding="utf-8")
                    note.write(json.dumps({"relative_path": path, "size": row["size"], "mtime_ns": got[1], "start": start, "end": end, "sha256": got[2]}) + "\n")
                    note.flush()
                    os.fsync(note.fileno())
                yield _batch([(path, start, end, *(got[:2] if got else (None, None)), error)], _SENT)
        if note:
            note.close()

    pieces = cut_ranges(planned, piece).join(open_files.select("relative_path", "size", "mtime_ns"), "relative_path")
    sent = cut(pack(pieces, F.col("end") - F.col("start"), ["relative_path", "start"], tasks).mapInArrow(send_all, _SENT))

    def check(row: dict) -> tuple:
        path = row["relative_path"]

        def work() -> None:
            fd = os.open(part(path), os.O_RDONLY)
            try:
                if _digest(_stretch(fd, row["start"], row["end"])) != row["sha256"]:
                    raise OSError("a noted piece has changed")
            finally:
                os.close(fd)

        return path, row["start"], row["end"], None, None, _outcome(work)[1]

    checked = sent.select("relative_path", "error")
    if verify:
        checked = checked.unionByName(_each(pack(covered, F.col("end") - F.col("start"), ["relative_path", "start"], tasks), check, _SENT).select("relative_path", "error"))
    failed = checked.groupBy("relative_path").agg(F.min("error").alias("error"))
    state = files.select("relative_path", "size", "mtime_ns", done.alias("done")).join(failed, "relative_path", "left")

    def finish(row: dict) -> tuple:
        path, error = row["relative_path"], row["error"]
        if row["size"] is None:
            return path, None, "the source is missing"
        if row["done"]:
            return path, row["size"], None
        if error:
            if error == "a noted piece has changed":
                _outcome(lambda: _forget(part(path)))
            return path, None, error

        def work() -> int:
            if row["size"] == 0:
                os.makedirs(os.path.dirname(part(path)), exist_ok=True)
                open(part(path), "ab").close()
            return _finish(below(src_root, path), below(dst_root, path), part(path), row["size"], row["mtime_ns"], False)

        return (path, *_outcome(work))

    return Resumed(_each(state.repartition(tasks, "relative_path"), finish, _DONE), planned, sent)


def pack_to_tar(entries: DataFrame, src_root: str, dst_root: str, tasks: int = 200) -> DataFrame:
    """package, bytes, error: one archive dst_root/package.tar per package of entries (package, relative_path, size and, where
    there are some, is_dir and is_symlink). The work is done once, when this is called; the result is a table.

    Offsets are known from the manifest, so the members of one archive are written in many tasks, each at its own
    place, dealt by their bytes. Directories (names end in a slash) and links (with their targets) have a header and no
    content. What was written is noted in the shared folder before any archive is renamed, so that no member is
    written again after that. An archive with a failed member stays unnamed. Entries need distinct paths within their package.
    """
    stem = lambda package: os.path.join(dst_root, package + ".tar")
    run_id = uuid.uuid4().hex

    def put(package: str, member: str, size: int, at: int, kind: str) -> int:
        source, part = below(src_root, os.path.join(package, member)), f"{stem(package)}.{run_id}.part"
        info, name, link = os.lstat(source), member.encode(), b""
        if kind == "0" and info.st_size != size:
            raise OSError(f"size changed: {member}")
        if kind == "5":
            name = name.rstrip(b"/") + b"/"
        elif kind == "2":
            link = os.readlink(source).encode()
        if len(name) > 100 or len(link) > 100 or size >= 8**11:
            raise OSError(f"no ustar header can hold the name, the link or the size: {member}")
        os.makedirs(os.path.dirname(part), exist_ok=True)
        fd = os.open(part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            here = at + _put(fd, tar_header(name, size if kind == "0" else 0, int(info.st_mtime), info.st_mode & 0o7777, 0, 0, kind.encode(), link), at)
            if kind == "0":
                from_fd = os.open(source, os.O_RDONLY)
                try:
                    for piece in _stretch(from_fd, 0, size):
                        here += _put(fd, piece, here)
                finally:
                    os.close(from_fd)
                if here != at + 512 + size:
                    raise OSError(f"size changed: {member}")
        finally:
            os.close(fd)
        return size

    def close(package: str, size: int) -> int:
        part = f"{stem(package)}.{run_id}.part"
        if os.path.exists(part):
            os.truncate(part, size)
            os.replace(part, stem(package))
        elif not os.path.exists(stem(package)) or os.path.getsize(stem(package)) != size:
            raise OSError("the archive is missing")
        return size

    def write(row: dict) -> tuple:
        size = row["size"] or 0
        _, error = _outcome(put, row["package"], row["member"], size, row["at"], row["type_flag"])
        return row["package"], row["at"] + 512 + (-(-size // 512) * 512 if row["type_flag"] == "0" else 0), error

    def finish(row: dict) -> tuple:
        if not row["error"]:
            return (row["package"], *_outcome(close, row["package"], row["bytes"]))
        _outcome(lambda: _forget(f"{stem(row['package'])}.{run_id}.part"))
        return row["package"], None, row["error"]

    rows = planning.tar_manifest(entries).select("package", "member", F.col("size").cast("long").alias("size"), F.col("header_offset").cast("long").alias("at"), "type_flag")
    content = F.when(F.col("type_flag") == "0", F.col("size")).otherwise(0)
    written = _each(pack(rows, content, ["package", "at"], tasks), write, "package string, end long, error string")
    whole = written.groupBy("package").agg((F.max("end") + 1024).alias("bytes"), F.min("error").alias("error"))
    return _each(whole, finish, "package string, bytes long, error string")
