"""Transfer and error reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20


def transfer_report(log: DataFrame) -> DataFrame:
    """job, ops, bytes, elapsed_s, mib_s: rates are 0 where no time passed. log: job, ts_us, bytes; null bytes
    count 0 (a job of nulls alone has null bytes), a null job is one, an empty log gives no row."""
    sums = log.groupBy("job").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("elapsed_s"))
    return sums.withColumn("mib_s", F.when(F.col("elapsed_s") > 0, F.col("bytes") / MIB / F.col("elapsed_s")).otherwise(F.lit(0.0)))


def throughput_windows(log: DataFrame, seconds: int, slide: int | None = None) -> DataFrame:
    """window_start (epoch seconds), ops, bytes of every window: tumbling, or one that begins every `slide` seconds.

    Sliding windows are summed by slide first, so a transfer is not repeated for each window that holds it. The width
    must be a whole number of slides.
    """
    slide = slide or seconds
    if seconds % slide:
        raise ValueError("the width must be a whole number of slides")
    start = F.floor(F.col("ts_us") / F.lit(1_000_000 * slide)).cast("long") * slide
    sums = log.groupBy(start.alias("window_start")).agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"))
    if slide == seconds:
        return sums
    moved = sums.select("ops", "bytes", "window_start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seconds - slide).cast("long"), F.lit(slide).cast("long"))).alias("_back"))
    return moved.groupBy((F.col("window_start") - F.col("_back")).alias("window_start")).agg(F.sum("ops").alias("ops"), F.sum("bytes").alias("bytes"))


def parse_rate(text: str | int) -> int:
    """Bytes a second of '8MiB/s', '8 mb' or a number; decimal and binary names mean the same powers of 1024."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([kmgt]?)(?:i?b)?(?:/s)?", re.sub(r"\s", "", str(text)).lower())
    if not m:
        raise ValueError(f"invalid rate: {text}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def rate_violations(log: DataFrame, limit: str | int, burst: int, seconds: int) -> DataFrame:
    """Transfers (job, ts_us, in_window) at whose time the bytes of the last `seconds` exceed limit * seconds + burst.

    Time is cut into stretches of some windows' length; each stretch of a job is a group of its own and also gets the
    transfers of the window before it, so one job's log is spread over many tasks.
    """
    width = seconds * 1_000_000
    stretch = 16 * width
    at = F.floor(F.col("ts_us") / stretch).cast("long")
    shown = F.when(F.col("ts_us") + width >= (at + 1) * stretch, F.array(at, at + 1)).otherwise(F.array(at))
    spread = log.select("job", "ts_us", "bytes", at.alias("_own"), F.explode(shown).alias("_at"))
    w = Window.partitionBy("job", "_at").orderBy("ts_us").rangeBetween(-width, 0)
    rows = spread.select("job", "ts_us", "_own", "_at", F.sum("bytes").over(w).alias("in_window")).where("_own = _at")
    return rows.where(F.col("in_window") > parse_rate(limit) * seconds + burst).select("job", "ts_us", "in_window").distinct()


def expected_requests(files: DataFrame, burst: int = 65_536) -> DataFrame:
    """One row: requests of at most `burst` bytes and bytes of all files; null sizes are left out, no files give nulls."""
    return files.agg(F.sum(((F.col("size") + burst - 1) - (F.col("size") + burst - 1) % burst) / burst).cast("long").alias("requests"), F.sum("size").alias("bytes"))


# Words that tell the class of an error's reason, the first that is found.
REASONS = [("timed out", "timeout"), ("timeout", "timeout"), ("not found", "missing"), ("no such", "missing"), ("denied", "permission"), ("forbidden", "permission"), ("refused", "connection"), ("reset", "connection"), ("no space", "capacity"), ("quota", "capacity")]


def reason_class(reason: Column) -> Column:
    """The class of an error's text; other where no word is known, and for null."""
    out, low = F.lit("other"), F.lower(reason)
    for word, name in reversed(REASONS):
        out = F.when(low.contains(word), F.lit(name)).otherwise(out)
    return out


def error_summary(errors: DataFrame, rollup: bool = False) -> DataFrame:
    """Errors by event and job, and by backend and class of reason where there are such columns; with rollup also the
    subtotals (null: all)."""
    by = [F.col("event"), F.col("job")]
    by += [F.col("backend")] if "backend" in errors.columns else []
    by += [reason_class(F.col("reason")).alias("reason_class")] if "reason" in errors.columns else []
    grouped = errors.rollup(*by) if rollup else errors.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"))
