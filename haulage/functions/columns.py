"""Scalar column functions: paths, times, URLs and small codes. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
#: 100 ns ticks between 1601-01-01 and 1970-01-01 (fixed value).
FILETIME_EPOCH = 116_444_736_000_000_000


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_extension(path: Column, nfs: bool = False) -> Column:
    """Text after the last dot of the name; null without one. A leading dot counts only with nfs."""
    found = F.regexp_extract(path_name(path), r"(?s)^.*\.([^.]*)$" if nfs else r"(?s)^.+\.([^.]*)$", 1)
    return F.when(path_name(path).rlike(r"(?s)^.*\." if nfs else r"(?s)^.+\."), found)


def path_parent(path: Column) -> Column:
    """Parent directory; the empty string at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"(?s)/[^/]*$", "")).otherwise(F.lit(""))


def path_components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_depth(path: Column) -> Column:
    return F.size(path_components(path))


def path_ancestors(path: Column) -> Column:
    """Proper ancestors, topmost first."""
    c = path_components(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.array_join(F.slice(c, 1, i), "/"))


def join_paths(a: Column, b: Column) -> Column:
    """Exactly one slash between the parts; an empty part leaves the other."""
    left, right = F.regexp_replace(a, "/+$", ""), F.regexp_replace(b, "^/+", "")
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.lit("/"), right))


def strip_root(path: Column, root: str) -> Column:
    """The path below root, on a component boundary; null outside of it."""
    root = root.rstrip("/")
    return F.when(path == root, F.lit("")).when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30))


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down (Spark's rounds towards zero)."""
    return _div(a, b) - F.when(a % b < 0, F.lit(1)).otherwise(F.lit(0))


def _div(a: Column, b: int) -> Column:
    """Integer division that rounds towards zero, exact for every long."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def trunc_div(a: Column, b: int) -> Column:
    return _div(a, b)


def ns_to_secs(ns: Column) -> Column:
    return floor_div(ns, NS)


def ns_subsec(ns: Column) -> Column:
    return F.pmod(ns, F.lit(NS).cast("long"))


def _clamp(x: Column) -> Column:
    wide = x.cast("decimal(38,0)")
    return F.when(wide > F.lit(LONG_MAX).cast("decimal(38,0)"), F.lit(LONG_MAX)).when(wide < F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MIN)).otherwise(wide.cast("long"))


def filetime_to_ns(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601 to nanoseconds since 1970, saturating."""
    return _clamp((ticks.cast("decimal(20,0)") - F.lit(FILETIME_EPOCH).cast("decimal(20,0)")) * F.lit(100).cast("decimal(5,0)"))


def ns_to_filetime(ns: Column) -> Column:
    """Nanoseconds since 1970 to ticks since 1601, rounding down; before 1601 it is 0."""
    return F.greatest(F.lit(0).cast("long"), floor_div(ns, 100) + F.lit(FILETIME_EPOCH))


def ns_to_string(ns: Column) -> Column:
    """UTC text with nine fractional digits (the session's time zone must be UTC)."""
    return F.concat(F.date_format(F.timestamp_seconds(ns_to_secs(ns)), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(ns_subsec(ns).cast("string"), 9, "0"))


def days_between(now_ns: Column, ns: Column) -> Column:
    """Fractional days from now to ns, positive if ns is later."""
    return (ns - now_ns).cast("double") / F.lit(86400e9)


def smb_mode(is_dir: Column, readonly: Column) -> Column:
    return F.when(is_dir & readonly, F.lit(0o555)).when(is_dir, F.lit(0o755)).when(readonly, F.lit(0o444)).otherwise(F.lit(0o644)).cast("long")


def millis_to_ns(ms: Column) -> Column:
    """Null (an error) when negative or beyond a long."""
    return F.when(ms >= 0, F.try_multiply(ms, F.lit(1_000_000).cast("long")))


def ns_to_millis(ns: Column) -> Column:
    return F.when(ns >= 0, _div(ns, 1_000_000))


# URL prefixes and the storage they name.
SCHEMES = {"hdfs://": "hdfs", "smb://": "cifs", "nfs://": "nfs", "s3://": "s3", "s3+http://": "s3", "s3+https://": "s3", "s3+hcp+http://": "s3", "s3+hcp+https://": "s3", "s3+sg+http://": "s3", "s3+sg+https://": "s3", "s3+dxn+http://": "s3", "s3+dxn+https://": "s3"}


def storage_type(url: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, kind in SCHEMES.items():
        out = out.when(F.startswith(url, F.lit(prefix)), F.lit(kind))
    return out.otherwise(F.lit("local"))


def redact_url(url: Column) -> Column:
    """Everything between the scheme and the last @ becomes ***:***; other text is unchanged."""
    return F.regexp_replace(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://).*@", "$1***:***@")


def s3_parts(url: Column) -> Column:
    """scheme, bucket, endpoint and prefix of an object-store URL; credentials are dropped."""
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z0-9+.-]+://(?:.*@)?", "")
    host = F.substring_index(rest, "/", 1)
    return F.struct(
        F.regexp_extract(url, r"^([A-Za-z0-9+.-]+)://", 1).alias("scheme"),
        F.substring_index(host, ".", 1).alias("bucket"),
        F.when(F.instr(host, ".") > 0, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(F.lit("localhost:9000")).alias("endpoint"),
        F.when(F.instr(rest, "/") > 0, F.regexp_replace(rest, r"(?s)^[^/]*/+", "")).otherwise(F.lit("")).alias("prefix"),
    )


def copy_source(bucket: Column, key: Column) -> Column:
    """bucket/key with every UTF-8 byte percent-encoded except A-Za-z0-9-._~/."""
    coded = F.url_encode(F.concat(bucket, F.lit("/"), key))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return coded
