"""What becomes of each planned rename, failed copy and retryable error."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.names import free
from haulage.functions.shared import cut

# Kinds of input and output errors and of opaque protocol errors worth another try, and the waits (ms).
TRANSIENT = ["Interrupted", "WouldBlock", "TimedOut", "ConnectionReset", "ConnectionAborted", "ConnectionRefused", "NotConnected", "UnexpectedEof", "NfsError", "CifsError", "S3Error"]
DELAYS_MS = [200, 500, 1000]
COPY_LIMIT = 5 << 30


def plan_renames(pairs: DataFrame, inventory: DataFrame) -> DataFrame:
    """from_path, to_path, status of pairs (from_path, to_path, expected_size) against an inventory of distinct paths.

    noop: same path; subtree: the root, or into its own subtree; source_size, destination_size: another size than
    expected; done: an earlier attempt finished; missing: on neither side; copy, ranges: to do, by size. Null paths are
    missing; with a null expected size any size will do.
    """
    sizes = inventory.select("relative_path", "size", F.lit(True).alias("here"))
    side = lambda name: sizes.select(F.col("relative_path").alias(f"{name}_path"), F.col("size").alias(f"_{name}_size"), F.col("here").alias(f"_{name}"))
    both = pairs.join(side("from"), "from_path", "left").join(side("to"), "to_path", "left")
    fits = lambda c: F.coalesce(F.col(c) == F.col("expected_size"), F.col("expected_size").isNull())
    below = (F.col("from_path") == "") | F.startswith("to_path", F.concat("from_path", F.lit("/")))
    status = F.when(F.col("from_path") == F.col("to_path"), "noop").when(below, "subtree")
    status = status.when(F.col("_from") & ~fits("_from_size"), "source_size").when(F.col("_from") & (F.col("_from_size") > COPY_LIMIT), "ranges").when(F.col("_from"), "copy")
    status = status.when(F.col("_to") & fits("_to_size"), "done").when(F.col("_to"), "destination_size").otherwise("missing")
    return both.select("from_path", "to_path", status.alias("status"))


def attribute_errors(results: DataFrame) -> DataFrame:
    """results with side and error: the destination's error if there is one, else the source's, else nulls."""
    side = F.when(F.col("write_error").isNotNull(), "destination").when(F.col("read_error").isNotNull(), "source")
    return results.withColumn("side", side).withColumn("error", F.coalesce("write_error", "read_error"))


def safe_to_delete_source(results: DataFrame) -> DataFrame:
    """Results that are verified and committed and do not reserve their source; unknown flags keep the source."""
    return results.where("coalesce(verified AND committed AND NOT reserve, false)")


def split_retryable(errors: DataFrame) -> DataFrame:
    """errors (kind, hdfs, ...) with attempt and delay_ms: one row a retry; attempt 0 without delay for permanent ones.

    HDFS errors were already tried again by their client and are permanent here.
    """
    again = F.col("kind").isin(TRANSIENT) & ~F.coalesce("hdfs", F.lit(False))
    waits = F.when(again, F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(ms).alias("delay_ms")) for i, ms in enumerate(DELAYS_MS)]))
    none = F.array(F.struct(F.lit(0).alias("attempt"), F.lit(None).cast("int").alias("delay_ms")))
    (wait,) = free(errors, "wait")
    return errors.withColumn(wait, F.explode(F.coalesce(waits, none))).select(*errors.columns, f"{wait}.attempt", f"{wait}.delay_ms")


# Numbers of system errors and the kinds they are told as.
SYSTEM = {4: "Interrupted", 11: "WouldBlock", 103: "ConnectionAborted", 104: "ConnectionReset", 107: "NotConnected", 110: "TimedOut", 111: "ConnectionRefused"}


def error_kind(error: Column) -> Column:
    """The kind of a system error's text (`[Errno 110] ...`), or of a text that starts with a kind and a colon; else Other, and
    null for null."""
    number = F.regexp_extract(error, r"^\[Errno ([0-9]+)\]", 1)
    kinds = F.create_map(*[x for n, kind in SYSTEM.items() for x in (F.lit(str(n)), F.lit(kind))])
    told = F.regexp_extract(error, r"^([A-Z][A-Za-z0-9]+):", 1)
    return F.when(error.isNull(), None).otherwise(F.coalesce(F.try_element_at(kinds, number), F.when(told.isin(TRANSIENT), told), F.lit("Other")))


def in_rounds(rows: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "relative_path", delays_ms: list[int] = DELAYS_MS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, status, attempts, error of rows: work done once for all and again, after each delay, only for those that failed with
    an error worth another try.

    work takes rows and gives an outcome row (key, error) for each key; it must do its work when called or when its result
    is written, which happens once a round. status: ok, permanent (an error that no retry mends) or failed (still worth a try
    after the last round). Keys that work does not report are permanent errors; keys that are reported twice take the
    first error. What is ok is never done again. Null keys are left out.
    """
    todo, done = rows.where(F.col(key).isNotNull()), []
    for attempt, delay in enumerate([0, *delays_ms], 1):
        if attempt > 1:
            wait(delay / 1000)
        told = work(todo).groupBy(key).agg(F.min("error").alias("error"), F.count("*").alias("n"))
        both = todo.select(key).distinct().join(told, key, "left")
        error = F.when(F.col("n").isNull(), "no outcome was reported").otherwise(F.col("error"))
        out = cut(both.select(key, error.alias("error")))
        again = error_kind(F.col("error")).isin(TRANSIENT)
        last = attempt > len(delays_ms)
        status = F.when(F.col("error").isNull(), "ok").when(again, "failed").otherwise("permanent")
        settled = out.select(key, status.alias("status"), F.lit(attempt).alias("attempts"), "error")
        done.append(settled if last else settled.where("status != 'failed'"))
        if last:
            break
        failed = settled.where("status = 'failed'").select(key)
        if failed.isEmpty():
            break
        todo = cut(todo.join(failed, key, "left_semi"))
    return reduce(DataFrame.unionByName, done)
