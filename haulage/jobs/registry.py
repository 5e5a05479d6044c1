"""All registered queries of the storage operators and their SQL, over tables derived from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions import columns as C
from haulage.functions.shared import shared_dir
from haulage.operators import acl, blobs, chunks, diff, filters, integrity, objects, order, outcomes, planning, report, transfer, tree
from haulage.sources import inventory as inv
from haulage.sources import store
from haulage.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PART = 5 * planning.MIB

# Each derived table: its source, columns as expressions that Spark and the SQL read alike ({us}: epoch microseconds).
DERIVED = {
    "versions": ("lineitem", ["concat('obj/', l_orderkey, '/', l_linenumber) AS key", "{us:l_shipdate} * 1000 AS time_ns", "CAST(l_quantity * 1000 AS BIGINT) AS size", "concat(l_partkey, '-', l_suppkey, '-', CAST(floor(l_extendedprice) AS BIGINT)) AS version_id", "(l_returnflag = 'R' AND l_linestatus = 'F') AS is_marker"]),
    "commits": ("lineitem", ["l_orderkey AS file", "CAST((l_linenumber - 1) * 1048576 AS BIGINT) AS \"start\"", "CAST(l_linenumber * 1048576 AS BIGINT) AS \"end\""]),
    "parts": ("lineitem", ["l_orderkey AS file", "CAST(l_linenumber AS BIGINT) AS part_number", f"CAST({PART} + CASE WHEN l_orderkey % 101 = 0 THEN 1 ELSE 0 END AS BIGINT) AS part_len"]),
    "uploads": ("lineitem", ["l_orderkey AS key", "{us:l_shipdate} AS initiated", "concat(l_partkey, '-', l_suppkey) AS upload_id"]),
    "tags": ("lineitem", ["l_orderkey AS file", "CAST(l_linenumber AS BIGINT) AS pos", "concat('line', l_linenumber) AS tag", "l_returnflag AS value"]),
    "messages": ("events", ["event_id AS seq", "CASE event_id % 5 WHEN 0 THEN 'Deleted' WHEN 1 THEN 'Renamed' ELSE 'Scanned' END AS kind", "concat('u', user_id) AS relative_path", "CASE WHEN event_id % 5 = 1 THEN concat('u', user_id + 1) END AS from_path", "CAST(floor(value) AS BIGINT) AS size"]),
    "copies": ("orders", ["o_orderkey AS file", "CASE WHEN o_orderkey % 11 = 0 THEN 'read failed' END AS read_error", "CASE WHEN o_orderkey % 7 = 0 THEN 'write failed' END AS write_error", "o_orderkey % 5 <> 0 AS verified", "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 3 <> 0 END AS committed", "o_orderkey % 2 = 0 AS reserve"]),
    "failures": ("events", ["event_id", "CASE event_id % 5 WHEN 0 THEN 'TimedOut' WHEN 1 THEN 'NotFound' WHEN 2 THEN 'S3Error' WHEN 3 THEN 'PermissionDenied' ELSE 'NotConnected' END AS kind", "event_id % 7 = 0 AS hdfs"]),
    "transfers": ("events", ["{us:ts} AS ts_us", "user_id % 8 AS job", "CAST(floor(value * 1048576) AS BIGINT) AS bytes", "event_type AS event"]),
    "content": ("documents", ["concat(source, '/', lang, '/doc_', doc_id, '.txt') AS relative_path", "doc_id", "text"]),
    "acls": ("customer", ["concat('share/', c_nationkey, '/', c_custkey % 40) AS path", "c_custkey AS pos", "concat('u', c_custkey % 9) AS trustee", "CAST(CASE WHEN c_custkey % 3 = 0 THEN 2032127 ELSE 1179785 END AS BIGINT) AS mask", "CAST(CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 6 = 0 THEN 16 ELSE c_custkey % 2 * 2 END AS BIGINT) AS flags", "CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS type", "c_nationkey % 5 = 0 AS protected"]),
    "aces": ("supplier", ["concat('share/', s_nationkey, '/', s_suppkey) AS path", "s_name AS trustee", "CAST(CASE s_suppkey % 8 WHEN 0 THEN 2032127 WHEN 1 THEN 1245631 WHEN 2 THEN 1179817 WHEN 3 THEN 1179926 WHEN 4 THEN 1179785 WHEN 5 THEN 1180063 WHEN 6 THEN 35 ELSE 0 END AS BIGINT) AS mask", "CAST(floor(s_suppkey / 8) % 4 * 8 AS BIGINT) AS flags", "CAST(s_suppkey % 2 AS BIGINT) AS type"]),
}


def _exprs(name: str, spark: bool) -> list[str]:
    import re

    us = (lambda m: f"unix_micros(CAST({m[1]} AS TIMESTAMP))") if spark else (lambda m: f"epoch_us({m[1]})")
    return [re.sub(r"\{us:(\w+)\}", us, e).replace('"', "`" if spark else '"') for e in DERIVED[name][1]]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{DERIVED[name][0]}.parquet").selectExpr(*_exprs(name, True))


def _with(*names: str, more: str = "") -> str:
    ctes = [f"{n} AS (SELECT {', '.join(_exprs(n, False))} FROM {DERIVED[n][0]})" for n in names]
    return "WITH " + ", ".join([*([inv.SQL_INV.strip()] if not names or "inv" in more else []), *ctes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


INV = _with()
_KIND = """CASE WHEN p.relative_path IS NULL THEN 'new' WHEN c.relative_path IS NULL THEN 'deleted' ELSE
  CASE WHEN (p.size IS DISTINCT FROM c.size OR p.mtime_ns IS DISTINCT FROM c.mtime_ns) AND (p.mode IS DISTINCT FROM c.mode OR p.uid IS DISTINCT FROM c.uid OR p.gid IS DISTINCT FROM c.gid) THEN 'both_changed'
  WHEN p.size IS DISTINCT FROM c.size OR p.mtime_ns IS DISTINCT FROM c.mtime_ns THEN 'data_changed'
  WHEN p.mode IS DISTINCT FROM c.mode OR p.uid IS DISTINCT FROM c.uid OR p.gid IS DISTINCT FROM c.gid THEN 'metadata_changed' ELSE 'same' END END"""
DIFF = f"{INV}, diff AS (SELECT coalesce(p.relative_path, c.relative_path) AS relative_path, {_KIND} AS state, p.size AS p_size, c.size AS c_size FROM inv_src p FULL JOIN inv_dst c ON p.relative_path = c.relative_path)"


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_inventories(inv.inv_src(spark, d), inv.inv_dst(spark, d))


@query("d2_diff", DIFF + " SELECT relative_path, state FROM diff")
def d2(s, d):
    return _diff(s, d).select("relative_path", "state")


@query("d7_diff_summary", DIFF + " SELECT state, count(*) AS n_entries, CAST(coalesce(sum(coalesce(c_size, p_size)), 0) AS BIGINT) AS bytes FROM diff GROUP BY state")
def d7(s, d):
    return diff.summarize_changes(_diff(s, d))


@query("d3_new", INV + " SELECT relative_path, size FROM inv_dst c WHERE NOT EXISTS (SELECT 1 FROM inv_src p WHERE p.relative_path = c.relative_path)")
def d3(s, d):
    return diff.new_entries(inv.inv_src(s, d), inv.inv_dst(s, d)).select("relative_path", "size")


@query("d3_deleted", INV + " SELECT relative_path, size FROM inv_src c WHERE NOT EXISTS (SELECT 1 FROM inv_dst p WHERE p.relative_path = c.relative_path)")
def d3b(s, d):
    return diff.deleted_entries(inv.inv_src(s, d), inv.inv_dst(s, d)).select("relative_path", "size")


@query("d4_renames", INV + """, n AS (SELECT * FROM inv_dst c WHERE NOT EXISTS (SELECT 1 FROM inv_src p WHERE p.relative_path = c.relative_path)),
g AS (SELECT * FROM inv_src c WHERE NOT EXISTS (SELECT 1 FROM inv_dst p WHERE p.relative_path = c.relative_path))
SELECT g.relative_path AS from_path, n.relative_path AS to_path, g.ino AS ino FROM g JOIN n ON g.ino = n.ino""")
def d4(s, d):
    return diff.detect_renames(inv.inv_src(s, d), inv.inv_dst(s, d))


RENAMED = DIFF + f""", del AS (SELECT p.* FROM inv_src p JOIN diff USING (relative_path) WHERE state = 'deleted' AND p.ino IS NOT NULL QUALIFY count(*) OVER (PARTITION BY p.ino) = 1),
add AS (SELECT c.* FROM inv_dst c JOIN diff USING (relative_path) WHERE state = 'new' AND c.ino IS NOT NULL QUALIFY count(*) OVER (PARTITION BY c.ino) = 1),
pair AS (SELECT p.relative_path AS f, c.relative_path AS t, {_KIND} AS change FROM del p JOIN add c ON p.ino = c.ino),
st AS (SELECT relative_path, CAST(NULL AS VARCHAR) AS from_path, state, CAST(NULL AS VARCHAR) AS change FROM diff WHERE NOT (state = 'deleted' AND relative_path IN (SELECT f FROM pair)) AND NOT (state = 'new' AND relative_path IN (SELECT t FROM pair))
  UNION ALL SELECT t, f, 'renamed', change FROM pair)"""


@query("d4_rename_states", RENAMED + " SELECT relative_path, from_path, state, change FROM st")
def d4b(s, d):
    return diff.pair_renames(_diff(s, d)).select("relative_path", "from_path", "state", "change")


_ACTS = "CASE {0} WHEN 'new' THEN ['copy'] WHEN 'data_changed' THEN ['copy', 'set_metadata'] WHEN 'both_changed' THEN ['copy', 'set_metadata'] WHEN 'metadata_changed' THEN ['set_metadata'] WHEN 'deleted' THEN ['delete'] WHEN 'renamed' THEN ['rename'] ELSE CAST([] AS VARCHAR[]) END"


@query("d5_actions", RENAMED + f""", a AS (SELECT relative_path, list_concat({_ACTS.format('state')}, {_ACTS.format('change')}) AS acts FROM st)
SELECT relative_path, CAST(i - 1 AS INTEGER) AS step, acts[i] AS action FROM (SELECT relative_path, acts, unnest(range(1, len(acts) + 1)) AS i FROM a)""")
def d5(s, d):
    return diff.sync_actions(diff.pair_renames(_diff(s, d)))


_META = """array_to_string(list_filter([
  CASE WHEN NOT (CASE greatest({p1}, {p2}) WHEN 1 THEN s.mtime_ns = d.mtime_ns ELSE floor(s.mtime_ns::DECIMAL(38,0) / greatest({p1}, {p2})) = floor(d.mtime_ns::DECIMAL(38,0) / greatest({p1}, {p2})) END) THEN 'mtime' END,
  CASE WHEN s.uid <> d.uid THEN 'uid' END, CASE WHEN s.gid <> d.gid THEN 'gid' END, CASE WHEN s.mode % 4096 <> d.mode % 4096 THEN 'mode' END], lambda x: x IS NOT NULL), ',')"""
_P = "(CASE WHEN {0} = 0 THEN 1 WHEN {0} % 1000000000 = 0 THEN 1000000000 WHEN {0} % 1000000 = 0 THEN 1000000 WHEN {0} % 1000 = 0 THEN 1000 ELSE 1 END)"
QUICK = INV + f""", j AS (SELECT coalesce(s.relative_path, d.relative_path) AS relative_path, s.relative_path AS sp, d.relative_path AS dp, s.size AS ss, d.size AS ds,
  {_META.format(p1=_P.format('s.mtime_ns'), p2=_P.format('d.mtime_ns'))} AS f FROM inv_src s FULL JOIN inv_dst d ON s.relative_path = d.relative_path),
q AS (SELECT relative_path, CASE WHEN sp IS NULL THEN 'missing_source' WHEN dp IS NULL THEN 'missing_destination' WHEN ss <> ds THEN 'size' WHEN f <> '' THEN 'metadata' ELSE 'ok' END AS outcome,
  CASE WHEN sp IS NOT NULL AND dp IS NOT NULL AND ss = ds THEN f ELSE '' END AS fields FROM j)"""


@query("i2_quick_check", QUICK + " SELECT relative_path, outcome, fields FROM q")
def i2(s, d):
    return integrity.quick_check(inv.inv_src(s, d), inv.inv_dst(s, d))


def _flagged(files: DataFrame, link: str) -> DataFrame:
    """files with kinds and with sizes and times that are not known everywhere."""
    unknown = {"size": "CASE WHEN ino % 53 = 0 THEN NULL ELSE size END", "mtime_ns": "CASE WHEN ino % 59 = 0 THEN NULL ELSE mtime_ns END"}
    more = unknown if "<>" in link else {"size": "CASE WHEN ino % 106 = 0 THEN NULL ELSE size END", "mtime_ns": "CASE WHEN ino % 118 = 0 THEN NULL ELSE mtime_ns END"}
    return files.selectExpr("relative_path", "mode", "uid", "gid", "ino", *[f"{e} AS {c}" for c, e in more.items()], "ino % 61 = 0 AS is_dir", f"{link} AS is_symlink")


_LINKS = ("ino % 5 = 0", "(ino % 5 = 0) <> (ino % 47 = 0)")


@query("i1_entry_kind", INV + " SELECT relative_path, CASE WHEN ino % 61 = 0 THEN 'directory' WHEN ino % 5 = 0 THEN 'symlink' ELSE 'file' END AS kind FROM inv_src")
def i1(s, d):
    return _flagged(inv.inv_src(s, d), _LINKS[0]).select("relative_path", integrity.entry_kind(F.col("is_dir"), F.col("is_symlink")).alias("kind"))


_P0 = _P.replace("{0} = 0", "coalesce({0}, 0) = 0")
_FAILED = """array_to_string(list_filter([
  CASE WHEN NOT coalesce(CASE greatest({p1}, {p2}) WHEN 1 THEN sm = dm ELSE floor(sm::DECIMAL(38,0) / greatest({p1}, {p2})) = floor(dm::DECIMAL(38,0) / greatest({p1}, {p2})) END, sm IS NULL AND dm IS NULL) THEN 'mtime' END,
  CASE WHEN suid <> duid THEN 'uid' END, CASE WHEN sgid <> dgid THEN 'gid' END, CASE WHEN NOT sl AND NOT dl AND smode % 4096 <> dmode % 4096 THEN 'mode' END], lambda x: x IS NOT NULL), ',')"""


@query("i2_quick_check_kinds", INV + f""", a AS (SELECT *, CASE WHEN ino % 106 = 0 THEN NULL ELSE size END AS z, CASE WHEN ino % 118 = 0 THEN NULL ELSE mtime_ns END AS m, ino % 5 = 0 AS l FROM inv_src),
b AS (SELECT *, CASE WHEN ino % 53 = 0 THEN NULL ELSE size END AS z, CASE WHEN ino % 59 = 0 THEN NULL ELSE mtime_ns END AS m, (ino % 5 = 0) <> (ino % 47 = 0) AS l FROM inv_dst),
j AS (SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, a.relative_path AS sp, b.relative_path AS dp, a.z AS sz, b.z AS dz, a.m AS sm, b.m AS dm, a.uid AS suid, b.uid AS duid, a.gid AS sgid, b.gid AS dgid, a.mode AS smode, b.mode AS dmode, a.l AS sl, b.l AS dl,
  CASE WHEN a.ino % 61 = 0 THEN 'directory' WHEN a.l THEN 'symlink' ELSE 'file' END AS sk, CASE WHEN b.ino % 61 = 0 THEN 'directory' WHEN b.l THEN 'symlink' ELSE 'file' END AS dk FROM a FULL JOIN b ON a.relative_path = b.relative_path),
o AS (SELECT relative_path, CASE WHEN sp IS NULL THEN 'missing_source' WHEN dp IS NULL THEN 'missing_destination' WHEN sk <> dk THEN 'kind' WHEN sk = 'file' AND sz IS DISTINCT FROM dz THEN 'size' END AS stage, {_FAILED.format(p1=_P0.format('sm'), p2=_P0.format('dm'))} AS f FROM j)
SELECT relative_path, coalesce(stage, CASE WHEN f <> '' THEN 'metadata' ELSE 'ok' END) AS outcome, CASE WHEN stage IS NULL THEN f ELSE '' END AS fields FROM o""")
def i2b(s, d):
    return integrity.quick_check(_flagged(inv.inv_src(s, d), _LINKS[0]), _flagged(inv.inv_dst(s, d), _LINKS[1]))


@query("i7_integrity_report", QUICK + " SELECT outcome, split_part(relative_path, '/', 1) AS top, count(*) AS n_entries FROM q GROUP BY ALL")
def i7(s, d):
    return integrity.integrity_report(integrity.quick_check(inv.inv_src(s, d), inv.inv_dst(s, d)))


@query("f3_filter_symlinks", INV + " SELECT relative_path FROM inv_src WHERE ino % 61 <> 0 AND ino % 5 = 0 AND size > 1000")
def f3(s, d):
    files = inv.inv_src(s, d).selectExpr("*", "ino % 61 = 0 AS is_dir", "ino % 5 = 0 AS is_symlink")
    return filters.filter_entries(files, "type == symlink and size > 1000").select("relative_path")


@query("f6_filter_age", INV + " SELECT relative_path FROM inv_src WHERE (1000000000 - mtime_ns // 1000000000) / 86400.0 <= 2000 OR (1000000000 - mtime_ns // 1000000000) / 86400.0 > 3000.5")
def f6(s, d):
    return filters.filter_entries(inv.inv_src(s, d), "modified <= 2000d or modified > 3000.5", now=1_000_000_000).select("relative_path")


_MANY = [f"size > {4000 * k + 100} and size <= {4000 * k + 2000}" for k in range(12)]


@query("f10_many_conditions", INV + " SELECT relative_path FROM inv_src WHERE " + " OR ".join(f"({m})" for m in _MANY))
def f10(s, d):
    return filters.filter_entries(inv.inv_src(s, d), " or ".join(f"({m})" for m in _MANY)).select("relative_path")


@query("f12_filter_size_name", INV + " SELECT relative_path FROM inv_src WHERE NOT regexp_matches(relative_path, '\\.log$') AND (size > 150000 OR regexp_matches(relative_path, '\\.gz$'))")
def f12(s, d):
    return filters.filter_entries(inv.inv_src(s, d), 'size > 150000 or name == "*.gz"', "extension == log").select("relative_path")


@query("f12_filter_path_modified", INV + " SELECT relative_path FROM inv_src WHERE regexp_matches(relative_path, '^orders/1995[0-9]*/') AND mtime_ns // 1000000000 >= 796694400")
def f12b(s, d):
    return filters.filter_entries(inv.inv_src(s, d), 'path == "orders/1995*" and modified >= "1995-04-01"').select("relative_path")


@query("f13_filter_tree", INV + """, d0 AS (SELECT DISTINCT regexp_replace(relative_path, '/[^/]*$', '') AS p FROM inv_src), e AS (SELECT relative_path FROM inv_src UNION SELECT p FROM d0 UNION SELECT regexp_replace(p, '/[^/]*$', '') FROM d0)
SELECT relative_path FROM e WHERE split_part(relative_path, '/', 2) <= '19950101' AND split_part(relative_path, '/', 2) NOT LIKE '19940%'""")
def f13(s, d):
    files = inv.inv_src(s, d).select("relative_path", F.lit(False).alias("is_dir"), "size", "mtime_ns")
    return tree.filter_tree(files.unionByName(inv.synthesize_dirs(files)), "dir_date <= 19950101", 'extension == log or path == "orders/19940*"').select("relative_path")


@query("f9_dir_date", INV + " SELECT DISTINCT split_part(relative_path, '/', 2) AS name, CAST(epoch(strptime(split_part(relative_path, '/', 2), '%Y%m%d')) AS BIGINT) AS day_s FROM inv_src")
def f9(s, d):
    return inv.inv_src(s, d).select(F.get(F.split("relative_path", "/"), 1).alias("name")).distinct().select("name", filters.extract_dir_date(F.col("name")).alias("day_s"))


_DIRS = """, d0 AS (SELECT DISTINCT regexp_replace(relative_path, '/[^/]*$', '') AS p FROM inv_src),
dirs AS (SELECT DISTINCT unnest([split_part(p, '/', 1), split_part(p, '/', 1) || '/' || split_part(p, '/', 2), p]) AS relative_path FROM d0)"""


@query("s5_dirs", INV + _DIRS + " SELECT relative_path, true AS is_dir, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_ns FROM dirs")
def s5(s, d):
    return inv.synthesize_dirs(inv.inv_src(s, d))


@query("f8_filter_dir_date", INV + _DIRS + " SELECT relative_path FROM dirs WHERE NOT (regexp_matches(split_part(relative_path, '/', -1), '^[0-9]{8}$') AND split_part(relative_path, '/', -1) < '19950101')")
def f8(s, d):
    return filters.filter_entries(inv.synthesize_dirs(inv.inv_src(s, d)), 'dir_date >= "1995-01-01"').select("relative_path")


@query("s2_normalize", INV + """ SELECT 's3' AS backend, relative_path, regexp_replace(relative_path, '/[^/]*$', '') AS parent_path, split_part(relative_path, '/', -1) AS name,
  nullif(regexp_extract(split_part(relative_path, '/', -1), '^.+\\.([^.]*)$', 1), '') AS extension, CAST(4 AS BIGINT) AS depth, size, mtime_ns AS ctime_ns FROM inv_src""")
def s2(s, d):
    raw = inv.inv_src(s, d).withColumn("path", F.concat(F.lit("/bucket/"), F.replace("relative_path", F.lit("/"), F.lit("\\"))))
    return inv.normalize_entries(raw, "s3", "/bucket").select("backend", "relative_path", "parent_path", "name", "extension", "depth", "size", "ctime_ns")


@query("w2_subtree", INV + " SELECT relative_path FROM inv_src WHERE starts_with(relative_path, 'orders/19950101/')")
def w2(s, d):
    return inv.subtree(inv.inv_src(s, d), "orders/19950101").select("relative_path")


@query("w1_limit_depth", INV + _DIRS + " SELECT relative_path FROM dirs WHERE len(string_split(relative_path, '/')) <= 2")
def w1(s, d):
    return inv.limit_depth(inv.synthesize_dirs(inv.inv_src(s, d)), 2).select("relative_path")


@query("w5_tree_stats", INV + " SELECT regexp_extract(split_part(relative_path, '/', -1), '^.+\\.([^.]*)$', 1) AS extension, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM inv_src GROUP BY 1")
def w5(s, d):
    return inv.tree_stats(inv.inv_src(s, d))


@query("w6_rollup_sizes", INV + """, e AS (SELECT unnest([split_part(relative_path, '/', 1), split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2), regexp_replace(relative_path, '/[^/]*$', '')]) AS dir_path, size FROM inv_src)
SELECT dir_path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM e GROUP BY 1""")
def w6(s, d):
    return inv.rollup_sizes(inv.inv_src(s, d))


_VERSIONS = _with("versions") + """, alive AS (SELECT key FROM versions GROUP BY key HAVING coalesce(max(time_ns) FILTER (is_marker), 0) <= coalesce(max(time_ns) FILTER (NOT is_marker), 0))"""


@query("v2_live_versions", _VERSIONS + """ SELECT key, time_ns, size, version_id, count(*) OVER (PARTITION BY key) AS version_count,
  row_number() OVER (PARTITION BY key ORDER BY time_ns DESC, version_id DESC, size DESC) = 1 AS is_latest FROM versions WHERE NOT is_marker AND key IN (SELECT key FROM alive)""")
def v2(s, d):
    return planning.live_versions(derived(s, d, "versions"))


@query("v3_latest", _with("versions") + " SELECT key, version_id, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time_ns DESC, version_id DESC, size DESC) AS rn FROM versions) WHERE rn = 1")
def v3(s, d):
    return diff.latest(derived(s, d, "versions"), "key", [F.desc("time_ns"), F.desc("version_id"), F.desc("size")]).select("key", "version_id", "size")


@query("p1_chunks", INV + " SELECT relative_path, i AS chunk, i * 65536 AS \"start\", least((i + 1) * 65536, size) AS \"end\" FROM (SELECT relative_path, size, unnest(range((size + 65535) // 65536)) AS i FROM inv_src)")
def p1(s, d):
    return planning.plan_chunks(inv.inv_src(s, d), 65536)


_BIG = INV + f", big AS (SELECT relative_path, size * 1000 AS size, greatest({PART}, ((size * 1000 + 9999) // 10000 + 1048575) // 1048576 * 1048576) AS part FROM inv_src WHERE size > 0), pp AS (SELECT *, unnest(range(1, (size + part - 1) // part + 1)) AS part_number FROM big)"


def _big(s, d):
    return inv.inv_src(s, d).withColumn("size", F.col("size") * 1000)


@query("p3_parts", _BIG + " SELECT relative_path, part_number, (part_number - 1) * part AS \"start\", least(size - (part_number - 1) * part, part) AS part_len FROM pp")
def p3(s, d):
    return planning.plan_parts(_big(s, d))


_COPY = INV + f""", z AS (SELECT relative_path, CASE WHEN ino % 97 = 0 THEN size * 1000000000 WHEN ino % 1009 = 0 THEN size * 400000 ELSE size * 1000 END AS size FROM inv_src WHERE size > 0),
c AS (SELECT *, greatest({PART}, (size + 9999) // 10000) AS part FROM z)"""


@query("p4_copy_ranges", _COPY + """ SELECT relative_path, CAST(n AS BIGINT) AS part_number, 'bytes=' || (n - 1) * part || '-' || (least(n * part, size) - 1) AS bytes, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(range(1, (size + part - 1) // part + 1)) AS n FROM c WHERE part <= 5368709120)
UNION ALL SELECT relative_path, NULL, NULL, 'part size ' || part || ' is not within 5242880 and 5368709120' FROM c WHERE part > 5368709120""")
def p4(s, d):
    size = F.expr("CASE WHEN ino % 97 = 0 THEN size * 1000000000 WHEN ino % 1009 = 0 THEN size * 400000 ELSE size * 1000 END")
    return planning.copy_ranges(inv.inv_src(s, d).withColumn("size", size))


@query("p5_route", INV + """ SELECT relative_path, CASE WHEN ino % 4 = 3 OR ino % 5 = 0 THEN CASE WHEN size * 1000 <= 5242880 THEN 'single' ELSE 'multipart' END WHEN ino % 3 = 0 THEN 'server_copy' ELSE 'relay' END AS route FROM inv_src""")
def p5(s, d):
    ends = _big(s, d).selectExpr("*", "CASE WHEN ino % 4 < 3 THEN 'a' END AS src_endpoint", "CASE WHEN ino % 3 = 0 THEN 'a' ELSE 'b' END AS dst_endpoint", "ino % 5 = 0 AS limited")
    return planning.upload_route(ends)


_COVER = _with("commits") + """, w AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM commits),
n AS (SELECT *, CASE WHEN seen IS NULL OR "start" > seen THEN 1 ELSE 0 END AS fresh FROM w),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY "start", "end", fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM n),
cover AS (SELECT file, min("start") AS "start", max("end") AS "end" FROM i GROUP BY file, island)"""


@query("r8_coalesce_ranges", _COVER + ' SELECT file, "start", "end" FROM cover')
def r8(s, d):
    return planning.coalesce_ranges(derived(s, d, "commits"))


def _files(s, d, size: int):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("file"), F.lit(size).cast("long").alias("size"))


@query("r3_missing_intervals", _COVER + """, ends AS (SELECT file, "start", "end" FROM cover WHERE file IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 7340032, 7340032 FROM orders)
SELECT file, f AS "start", "start" AS "end" FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY file ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM ends) WHERE "start" > f""")
def r3(s, d):
    return planning.missing_intervals(derived(s, d, "commits"), _files(s, d, 7 * planning.MIB))


@query("r6_interval_bytes", _COVER + ' SELECT file, CAST(sum("end" - "start") AS BIGINT) AS bytes, count(*) AS n_intervals FROM cover GROUP BY file')
def r6(s, d):
    return planning.interval_bytes(planning.coalesce_ranges(derived(s, d, "commits")))


@query("r2_committed_parts", _with("parts") + f""", bad AS (SELECT file FROM parts WHERE part_len <> {PART})
SELECT file, (part_number - 1) * {PART} AS "start", part_number * {PART} AS "end" FROM parts WHERE file NOT IN (SELECT file FROM bad) AND file IN (SELECT o_orderkey FROM orders)""")
def r2(s, d):
    return planning.committed_parts(derived(s, d, "parts"), _files(s, d, 7 * PART), PART)


@query("r6_accounting", _COVER + """, p AS (SELECT file, CAST(sum("end" - "start") AS BIGINT) AS e FROM cover WHERE file % 7 <> 0 GROUP BY file), c AS (SELECT file, CAST(sum("end" - "start") AS BIGINT) AS a FROM commits WHERE file % 11 <> 0 GROUP BY file)
SELECT coalesce(p.file, c.file) AS file, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual, coalesce(e, 0) = coalesce(a, 0) AS ok FROM p FULL JOIN c ON p.file = c.file""")
def r6b(s, d):
    commits = derived(s, d, "commits")
    return planning.check_accounting(commits.where("file % 11 <> 0"), planning.coalesce_ranges(commits.where("file % 7 <> 0")))


def _packages(s, d):
    return inv.inv_src(s, d).select("relative_path", "size", F.substring_index("relative_path", "/", 2).alias("package"))


_PACK = INV + ", pk AS (SELECT relative_path, size, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS package, 512 + (size + 511) // 512 * 512 AS b FROM inv_src)"


@query("t1_tar_size", _PACK + " SELECT package, CAST(sum(b) + 1024 AS BIGINT) AS tar_bytes, count(*) AS n_members FROM pk GROUP BY package")
def t1(s, d):
    return planning.tar_size(_packages(s, d))


@query("t2_tar_manifest", _PACK + " SELECT package, substr(relative_path, length(package) + 2) AS member, '0' AS type_flag, size, CAST(coalesce(sum(b) OVER (PARTITION BY package ORDER BY relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_offset FROM pk")
def t2(s, d):
    return planning.tar_manifest(_packages(s, d))


@query("t2_tar_kinds", INV + _DIRS + """, e AS (SELECT relative_path, size, CASE WHEN ino % 31 = 0 THEN '2' ELSE '0' END AS type_flag FROM inv_src UNION ALL SELECT relative_path, 0, '5' FROM dirs WHERE len(string_split(relative_path, '/')) > 2),
k AS (SELECT *, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS package, 512 + CASE type_flag WHEN '0' THEN (size + 511) // 512 * 512 ELSE 0 END AS b FROM e)
SELECT package, substr(relative_path, length(package) + 2) AS member, type_flag, size, CAST(coalesce(sum(b) OVER (PARTITION BY package ORDER BY relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_offset FROM k""")
def t2b(s, d):
    files = inv.inv_src(s, d).selectExpr("relative_path", "size", "false AS is_dir", "ino % 31 = 0 AS is_symlink")
    dirs = inv.synthesize_dirs(files).where("size(split(relative_path, '/')) > 2").selectExpr("relative_path", "size", "is_dir", "false AS is_symlink")
    return planning.tar_manifest(files.unionByName(dirs).withColumn("package", F.substring_index("relative_path", "/", 2)))


@query("x2_batch_keys", INV + ", n AS (SELECT relative_path AS key, (row_number() OVER (ORDER BY relative_path) - 1) // 100 AS batch_id FROM inv_src) SELECT batch_id, count(*) AS n_keys, sha256(string_agg(key, chr(10) ORDER BY key)) AS keys_sha256 FROM n GROUP BY batch_id")
def x2(s, d):
    batches = planning.batch_keys(inv.inv_src(s, d).select(F.col("relative_path").alias("key")), 100)
    return batches.select("batch_id", "n_keys", F.sha2(F.array_join("keys", "\n"), 256).alias("keys_sha256"))


@query("x1_plan_delete", INV + _DIRS + """, e AS (SELECT relative_path, true AS is_dir FROM dirs UNION ALL SELECT relative_path, false FROM inv_src), k AS (SELECT *, len(string_split(relative_path, '/')) * 2 + CASE WHEN is_dir THEN 0 ELSE 1 END AS dep FROM e)
SELECT relative_path, is_dir, (SELECT max(dep) FROM k) - dep AS wave FROM k""")
def x1(s, d):
    files = inv.inv_src(s, d)
    return planning.plan_delete(files.select("relative_path", F.lit(False).alias("is_dir")).unionByName(inv.synthesize_dirs(files).select("relative_path", "is_dir")))


@query("x3_reconcile_delete", INV + " SELECT s.relative_path, f.error FROM inv_src s LEFT JOIN (SELECT relative_path, 'denied' AS error FROM inv_src WHERE ino % 37 = 0) f ON s.relative_path = f.relative_path")
def x3(s, d):
    src = inv.inv_src(s, d)
    return planning.reconcile_delete(src, src.where("ino % 37 = 0").select("relative_path", F.lit("denied").alias("error")))


_ACES = _with("aces")
_ACE = "'[' || CASE WHEN flags & 16 <> 0 THEN 'I' ELSE 'E' END || '] ' || CASE type WHEN 0 THEN 'AccessAllowed' ELSE 'AccessDenied' END || ' ' || trustee || ' (' || CASE WHEN flags & 8 <> 0 THEN 'IO' ELSE '' END || ')'"


@query("a1_decode_mask", _ACES + """ SELECT path, array_to_string(CASE mask WHEN 2032127 THEN ['FullControl'] WHEN 1245631 THEN ['Modify'] WHEN 1179817 THEN ['ReadAndExecute'] WHEN 1179926 THEN ['Write'] WHEN 1179785 THEN ['Read'] WHEN 1180063 THEN ['Read', 'Write']
  WHEN 35 THEN ['ReadData', 'WriteData', 'ExecuteFile'] ELSE [] END, ',') AS plain, CASE mask WHEN 35 THEN 'ReadData,WriteData,ExecuteFile' WHEN 0 THEN '' END AS more FROM aces""")
def a1(s, d):
    more = F.when(F.col("mask").isin(0, 35), F.array_join(acl.decode_mask(F.col("mask").bitwiseOR(F.lit(0x100040))), ","))
    return derived(s, d, "aces").select("path", F.array_join(acl.decode_mask(F.col("mask")), ",").alias("plain"), more.alias("more"))


@query("a3_acl_summary", _ACES + f" SELECT path, count(*) AS n_aces, count(*) FILTER (flags & 16 = 0) AS n_explicit, count(*) FILTER (flags & 16 <> 0) AS n_inherited, string_agg({_ACE}, ';' ORDER BY {_ACE}) AS entries FROM aces GROUP BY path")
def a3(s, d):
    return acl.acl_summary(derived(s, d, "aces")).select("path", "n_aces", "n_explicit", "n_inherited", F.array_join("entries", ";").alias("entries"))


@query("a7_who_can", _ACES + """, p AS (SELECT trustee, type, unnest(CASE mask WHEN 2032127 THEN ['FullControl'] WHEN 1245631 THEN ['Modify'] WHEN 1179817 THEN ['ReadAndExecute'] WHEN 1179926 THEN ['Write'] WHEN 1179785 THEN ['Read']
  WHEN 1180063 THEN ['Read', 'Write'] WHEN 35 THEN ['ReadData', 'WriteData', 'ExecuteFile'] ELSE [] END) AS permission FROM aces)
SELECT permission, CAST(sum(CASE WHEN type = 0 THEN 1 ELSE -1 END) AS BIGINT) AS net, count(DISTINCT trustee) AS n_trustees FROM p GROUP BY permission""")
def a7(s, d):
    return acl.who_can(derived(s, d, "aces"))


_TEXT = "'[' || CASE WHEN flags & 16 <> 0 THEN 'I' ELSE 'E' END || '] ' || CASE type WHEN 0 THEN 'AccessAllowed' ELSE 'AccessDenied' END || ' ' || trustee || ' (' || CASE WHEN flags & 2 <> 0 THEN 'CI' ELSE '' END || ')'"
_NOT_KEPT = "pos % 7 <> 0"


@query("a4_acl_diff", _with("acls") + f""", dst AS (SELECT path, pos, trustee, CASE WHEN pos % 11 = 0 THEN mask + 1 ELSE mask END AS mask, flags, type, protected <> (length(path) % 3 = 0) AS protected FROM acls WHERE {_NOT_KEPT}),
se AS (SELECT * FROM acls WHERE flags & 16 = 0), de AS (SELECT * FROM dst WHERE flags & 16 = 0),
os AS (SELECT path, count(*) AS n FROM (SELECT path, trustee, mask, flags, type FROM se EXCEPT ALL SELECT path, trustee, mask, flags, type FROM de) GROUP BY path),
od AS (SELECT path, count(*) AS n FROM (SELECT path, trustee, mask, flags, type FROM de EXCEPT ALL SELECT path, trustee, mask, flags, type FROM se) GROUP BY path),
p AS (SELECT path FROM acls UNION SELECT path FROM dst),
f AS (SELECT path, coalesce((SELECT bool_or(protected) FROM acls x WHERE x.path = p.path), false) <> coalesce((SELECT bool_or(protected) FROM dst x WHERE x.path = p.path), false) OR path IN (SELECT path FROM se) OR path IN (SELECT path FROM de) AS needs_update FROM p),
m AS (SELECT path, string_agg(t, ';' ORDER BY k, pos) AS merged FROM (SELECT path, 0 AS k, pos, {_TEXT} AS t FROM se UNION ALL SELECT path, 1, pos, {_TEXT} FROM dst WHERE flags & 16 <> 0) GROUP BY path)
SELECT f.path, coalesce(os.n, 0) AS only_src, coalesce(od.n, 0) AS only_dst, needs_update, CASE WHEN needs_update THEN coalesce(merged, '') END AS merged FROM f LEFT JOIN os ON f.path = os.path LEFT JOIN od ON f.path = od.path LEFT JOIN m ON f.path = m.path""")
def a4(s, d):
    """Lists of several entries; the destination lacks some, has other masks and, for a third of the paths, another protection."""
    a = derived(s, d, "acls")
    b = a.where(_NOT_KEPT).withColumns({"mask": F.when(F.col("pos") % 11 == 0, F.col("mask") + 1).otherwise(F.col("mask")), "protected": F.col("protected") != (F.length("path") % 3 == 0)})
    return acl.acl_diff(a, b).select("path", "only_src", "only_dst", "needs_update", F.array_join("merged", ";").alias("merged"))


@query("a3_acl_lists", _with("acls") + f" SELECT path, count(*) AS n_aces, count(*) FILTER (flags & 16 = 0) AS n_explicit, count(*) FILTER (flags & 16 <> 0) AS n_inherited, string_agg({_TEXT}, ';' ORDER BY pos) AS entries FROM acls GROUP BY path")
def a3b(s, d):
    return acl.acl_summary(derived(s, d, "acls")).select("path", "n_aces", "n_explicit", "n_inherited", F.array_join("entries", ";").alias("entries"))


_LOG = _with("transfers")


@query("g1_transfer_report", _LOG + " SELECT job, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes, (max(ts_us) - min(ts_us)) / 1e6 AS elapsed_s, CASE WHEN max(ts_us) > min(ts_us) THEN CAST(sum(bytes) AS BIGINT) / 1048576 / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0.0 END AS mib_s FROM transfers GROUP BY job")
def g1(s, d):
    return report.transfer_report(derived(s, d, "transfers"))


@query("g2_throughput", _LOG + " SELECT ts_us // 3600000000 * 3600 AS window_start, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfers GROUP BY 1")
def g2(s, d):
    return report.throughput_windows(derived(s, d, "transfers"), 3600)


@query("g3_rate_violations", _LOG + """, w AS (SELECT job, ts_us, CAST(sum(bytes) OVER (PARTITION BY job ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM transfers)
SELECT DISTINCT job, ts_us, in_window FROM w WHERE in_window > 1024 * 600 + 1048576""")
def g3(s, d):
    return report.rate_violations(derived(s, d, "transfers"), "1 KiB/s", 1 << 20, 600)


@query("g4_expected_requests", INV + " SELECT CAST(sum((size + 65535) // 65536) AS BIGINT) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM inv_src")
def g4(s, d):
    return report.expected_requests(inv.inv_src(s, d))


@query("g2_sliding_throughput", _LOG + " SELECT w AS window_start, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT bytes, unnest([ts_us // 900000000 * 900, ts_us // 900000000 * 900 - 900, ts_us // 900000000 * 900 - 1800, ts_us // 900000000 * 900 - 2700]) AS w FROM transfers) GROUP BY w")
def g2b(s, d):
    return report.throughput_windows(derived(s, d, "transfers"), 3600, 900)


_WHY = "CASE event_id % 4 WHEN 0 THEN 'connection reset' WHEN 1 THEN 'Permission Denied' WHEN 2 THEN 'read timed out' ELSE 'odd' END"
_WHERE = "CASE user_id % 3 WHEN 0 THEN 's3' WHEN 1 THEN 'nas' ELSE 'hdfs' END"


@query("g5_error_summary", f"""SELECT event, job, backend, reason_class, count(*) AS n FROM (SELECT event_type AS event, user_id % 8 AS job, {_WHERE} AS backend, CASE event_id % 4 WHEN 0 THEN 'connection' WHEN 1 THEN 'permission' WHEN 2 THEN 'timeout' ELSE 'other' END AS reason_class FROM events WHERE event_type = 'error')
GROUP BY ROLLUP (event, job, backend, reason_class)""")
def g5(s, d):
    errors = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").selectExpr("event_type AS event", "user_id % 8 AS job", f"{_WHERE} AS backend", f"{_WHY} AS reason")
    return report.error_summary(errors, rollup=True)


@query("c1_content_hash", _with("content") + " SELECT relative_path, CASE WHEN length(text) = 0 THEN '' ELSE sha256(text) END AS digest FROM content")
def c1(s, d):
    return derived(s, d, "content").select("relative_path", integrity.content_hash(F.col("text")).alias("digest"))


@query("c7_duplicate_content", _with("content") + " SELECT strlen(text) AS size, sha256(text) AS digest, count(*) AS n_files, min(relative_path) AS first_path FROM content WHERE strlen(text) > 0 GROUP BY 1, 2 HAVING count(*) > 1")
def c7(s, d):
    return integrity.duplicate_content(derived(s, d, "content").select("relative_path", F.col("text").alias("content")))


@query("c3_fails_closed", _with("content") + """ SELECT relative_path, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size' WHEN doc_id % 7 = 0 THEN 'integrity' ELSE 'ok' END AS status FROM content""")
def c3b(s, d):
    src = derived(s, d, "content").select("relative_path", "doc_id", F.octet_length("text").cast("long").alias("size"), F.octet_length("text").cast("long").alias("length"), integrity.content_hash(F.col("text")).alias("digest"))
    dst = src.where("doc_id % 3 <> 0").selectExpr("relative_path", "CASE WHEN doc_id % 5 <> 0 THEN length END AS length", "CASE WHEN doc_id % 7 <> 0 THEN digest END AS digest")
    return integrity.verify_copy(src, dst)


@query("c3_verify_copy", _with("content") + """ SELECT relative_path, CASE WHEN doc_id % 31 = 0 AND length(text) > 0 THEN 'size' WHEN doc_id % 9 = 0 AND length(text) > 0 THEN 'integrity' ELSE 'ok' END AS status FROM content""")
def c3(s, d):
    src = derived(s, d, "content")
    changed = F.when((F.col("doc_id") % 31 == 0) & (F.length("text") > 0), F.expr("substring(text, 2)")).when((F.col("doc_id") % 9 == 0) & (F.length("text") > 0), F.concat(F.when(F.expr("substring(text, 1, 1) = '#'"), F.lit("*")).when(F.expr("octet_length(substring(text, 1, 1)) = 2"), F.lit("͸")).otherwise(F.lit("#")), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    side = lambda t: (F.octet_length(t).cast("long").alias("length"), integrity.content_hash(t).alias("digest"))
    return integrity.verify_copy(src.select("relative_path", F.octet_length("text").cast("long").alias("size"), *side(F.col("text"))), src.select("relative_path", *side(changed)))


@query("k_columns", INV + """ SELECT relative_path, ino, mtime_ns // 1000000000 AS secs, strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(mtime_ns % 1000000000 AS VARCHAR), 9, '0') AS shown,
  CAST(mtime_ns // 100 + 116444736000000000 AS BIGINT) AS filetime, 'b/' || replace(relative_path, ' ', '%20') AS copy_source FROM inv_src""")
def k(s, d):
    m = F.col("mtime_ns")
    return inv.inv_src(s, d).select("relative_path", "ino", C.ns_to_secs(m).alias("secs"), C.ns_to_string(m).alias("shown"), C.ns_to_filetime(m).alias("filetime"), C.copy_source(F.lit("b"), F.col("relative_path")).alias("copy_source"))


@query("k_urls", """SELECT page_id, 's3+https://***:***@' || regexp_extract(url, '://([^/]*)', 1) || '/x' AS redacted, 's3' AS kind, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS bucket, 'x' AS prefix FROM pages""")
def ku(s, d):
    url = F.concat(F.lit("s3+https://AK"), F.col("page_id"), F.lit(":S/K@"), F.regexp_extract("url", "://([^/]*)", 1), F.lit("/x"))
    parts = C.s3_parts(url)
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", C.redact_url(url).alias("redacted"), C.storage_type(url).alias("kind"), parts["bucket"].alias("bucket"), parts["prefix"].alias("prefix"))


@query("v1_object_history", _with("versions") + """, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time_ns, is_marker, version_id, size) AS position, count(*) OVER (PARTITION BY key) AS version_count FROM versions),
l AS (SELECT key FROM k WHERE position = version_count AND NOT is_marker) SELECT key, position, time_ns, CASE WHEN is_marker THEN 0 ELSE size END AS size, is_marker, version_count FROM k WHERE key IN (SELECT key FROM l)""")
def v1(s, d):
    return objects.object_history(derived(s, d, "versions"))


@query("v4_join_tags", _with("tags") + """, t AS (SELECT file, string_agg(tag || '=' || value, '&' ORDER BY pos, tag, value) AS tag_text, count(*) AS n_tags FROM tags GROUP BY file)
SELECT o_orderkey AS file, tag_text, n_tags FROM orders LEFT JOIN t ON o_orderkey = file""")
def v4(s, d):
    tagged = objects.join_tags(_files(s, d, 1), derived(s, d, "tags"))
    return tagged.select("file", "tag_text", F.when(F.col("tags").isNotNull(), F.size("tags")).cast("long").alias("n_tags"))


@query("r1_pick_uploads", _with("uploads") + " SELECT key, initiated, upload_id, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY initiated DESC, upload_id DESC) = 1 THEN 'keep' ELSE 'abort' END AS action FROM uploads")
def r1(s, d):
    return planning.pick_uploads(derived(s, d, "uploads"))


@query("r4_prefix_missing", INV + """, p AS (SELECT relative_path, size, CASE ino % 4 WHEN 0 THEN size WHEN 1 THEN size // 2 WHEN 2 THEN size + 1 END AS part_len FROM inv_src)
SELECT relative_path, CASE WHEN part_len IS NULL OR part_len > size THEN 0 ELSE part_len END AS "start", size AS "end" FROM p WHERE CASE WHEN part_len IS NULL OR part_len > size THEN 0 ELSE part_len END < size""")
def r4(s, d):
    src = inv.inv_src(s, d)
    partial = src.where("ino % 4 < 3").selectExpr("relative_path", "CASE ino % 4 WHEN 0 THEN size WHEN 1 THEN size div 2 ELSE size + 1 END AS part_len")
    return planning.prefix_missing(partial, src.select("relative_path", "size"))


@query("r7_can_complete", _with("parts") + f""", f AS (SELECT o_orderkey AS file, CAST((o_orderkey % 7 + 1) * {PART} AS BIGINT) AS size FROM orders),
j AS (SELECT f.file, size, p.part_number, p.part_len FROM f LEFT JOIN parts p ON f.file = p.file)
SELECT file, coalesce(count(part_number) = size // {PART} AND count(DISTINCT part_number) = size // {PART} AND min(part_number) = 1 AND max(part_number) = size // {PART} AND bool_and(part_len = {PART}), false) AS complete FROM j GROUP BY file, size""")
def r7(s, d):
    files = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS file", f"CAST((o_orderkey % 7 + 1) * {PART} AS BIGINT) AS size")
    return objects.can_complete(derived(s, d, "parts"), files, PART)


@query("d6_metadata_carry", DIFF + """, a AS (SELECT relative_path, CASE state WHEN 'new' THEN 'copy' WHEN 'deleted' THEN 'delete' WHEN 'metadata_changed' THEN 'set_metadata' ELSE 'copy' END AS action FROM diff WHERE state <> 'same' UNION ALL SELECT relative_path, 'set_metadata' FROM diff WHERE state IN ('data_changed', 'both_changed'))
SELECT relative_path, action, CASE WHEN action <> 'set_metadata' THEN '' ELSE CASE length(relative_path) % 3 WHEN 0 THEN 'atime,mtime,uid,gid,mode' WHEN 1 THEN 'atime,mtime' ELSE 'mtime,mode' END END AS attributes FROM a""")
def d6(s, d):
    actions = diff.sync_actions(_diff(s, d)).withColumn("src_kind", F.expr("element_at(array('nas', 's3', 'hdfs'), CAST(length(relative_path) % 3 + 1 AS INT))"))
    return diff.metadata_carry(actions, "nas").select("relative_path", "action", "attributes")


@query("d8_merge_messages", _with("messages") + """, e AS (SELECT seq, kind, relative_path, size FROM messages UNION ALL SELECT seq, 'Deleted', from_path, NULL FROM messages WHERE kind = 'Renamed'),
l AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY seq DESC) AS rn FROM e) SELECT relative_path, size FROM l WHERE rn = 1 AND kind <> 'Deleted'""")
def d8(s, d):
    return diff.merge_scan_messages(derived(s, d, "messages"))


def _bytes(files: DataFrame, text: str, step: int) -> DataFrame:
    """Chunks of a text column's bytes."""
    raw = files.select("relative_path", F.col(text).cast("binary").alias("raw"))
    return chunks.cut_chunks(raw, F.length("raw"), lambda at: F.substring(F.col("raw"), (at + 1).cast("int"), F.lit(step)), step)


def _sides(s, d) -> DataFrame:
    """Contents and their damaged copies: the first e is now E, or the last character is lost."""
    damaged = F.when(F.col("doc_id") % 31 == 0, F.expr("left(text, length(text) - 1)")).when(F.col("doc_id") % 9 == 0, F.expr("CASE WHEN instr(text, 'e') > 0 THEN overlay(text PLACING 'E' FROM instr(text, 'e') FOR 1) ELSE text END")).otherwise(F.col("text"))
    return derived(s, d, "content").withColumn("copied", damaged)


_CUT = "(doc_id % 31 = 0 AND length(text) > 0)"


@query("i5_full_check", _with("content") + f""" SELECT relative_path, CAST(CASE WHEN {_CUT} THEN strlen(left(text, length(text) - 1)) WHEN doc_id % 31 <> 0 AND doc_id % 9 = 0 AND instr(text, 'e') > 0 THEN strlen(left(text, instr(text, 'e') - 1)) END AS BIGINT) AS first_diff FROM content""")
def i5(s, d):
    both = _sides(s, d)
    return chunks.full_check_chunks(_bytes(both, "text", 4096), _bytes(both, "copied", 1000), both)


@query("i6_stream_shape", _with("content") + f""" SELECT relative_path, 'destination' AS side, CASE WHEN doc_id % 7 = 0 AND strlen(c) > 1000 THEN 'offset' ELSE 'length' END AS error, CASE WHEN doc_id % 7 = 0 AND strlen(c) > 1000 THEN 1000 ELSE strlen(c) END AS "at"
FROM (SELECT *, CASE WHEN {_CUT} THEN left(text, length(text) - 1) ELSE text END AS c FROM content) WHERE strlen(c) > 0 AND ((doc_id % 7 = 0 AND strlen(c) > 1000) OR {_CUT})""")
def i6(s, d):
    both = _sides(s, d)
    own = lambda c, side, step: _bytes(both, c, step).select("relative_path", F.lit(side).alias("side"), F.col("offset").alias("seq"), "offset", F.length("data").cast("long").alias("length"))
    shifted = F.when((F.regexp_extract("relative_path", r"_(\d+)\.txt$", 1).cast("long") % 7 == 0) & (F.col("seq") == 1000), F.col("offset") + 1).otherwise(F.col("offset"))
    every = own("text", "source", 4096).unionByName(own("copied", "destination", 1000).withColumn("offset", shifted))
    return chunks.stream_shape_errors(every, both.select("relative_path", F.octet_length("text").cast("long").alias("size")))


@query("c2_tree_hash", _with("content") + """, p AS (SELECT relative_path, i, sha256(substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000)) AS h FROM content, unnest(range(0, (length(text) + 999) // 1000)) AS r(i)),
q AS (SELECT relative_path, i // 8 AS i, count(*) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM p GROUP BY 1, p.i // 8),
r AS (SELECT relative_path, i // 8 AS i, sum(n) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM q GROUP BY 1, q.i // 8)
SELECT relative_path, CAST(sum(n) AS BIGINT) AS n_chunks, sha256(string_agg(h, '' ORDER BY i)) AS digest FROM r GROUP BY relative_path""")
def c2(s, d):
    """Hash trees of three levels of eight children (up to 512,000 characters)."""
    files = derived(s, d, "content")
    cut = chunks.cut_chunks(files, F.length("text"), lambda at: F.substring(F.col("text"), (at + 1).cast("int"), F.lit(1000)), 1000)
    return chunks.tree_hash_chunks(cut, 1000, 8, 3)


@query("i5_full_check_trees", _with("content") + f""" SELECT relative_path, CAST(CASE WHEN {_CUT} THEN strlen(left(text, length(text) - 1)) WHEN doc_id % 31 <> 0 AND doc_id % 9 = 0 AND instr(text, 'e') > 0 THEN strlen(left(text, instr(text, 'e') - 1)) END AS BIGINT) AS first_diff FROM content""")
def i5b(s, d):
    both = _sides(s, d)
    return chunks.full_check_trees(_bytes(both, "text", 4096), _bytes(both, "copied", 1000), both, 4096)


def _bucketed(s, d) -> tuple[DataFrame, DataFrame]:
    """Both inventories as tables of eight buckets by path."""
    name = uuid.uuid4().hex
    return tuple(inv.write_bucketed(df, f"inv_{side}_{name}", f"{shared_dir(s)}/bucketed-{side}-{name}", 8) for side, df in (("src", inv.inv_src(s, d)), ("dst", inv.inv_dst(s, d))))


@query("d2_diff_bucketed", DIFF + " SELECT relative_path, state FROM diff")
def d2b(s, d):
    return diff.diff_inventories(*_bucketed(s, d)).select("relative_path", "state")


@query("i2_quick_check_bucketed", QUICK + " SELECT relative_path, outcome, fields FROM q")
def i2c(s, d):
    return integrity.quick_check(*_bucketed(s, d))


@query("d4_top_renames", """WITH e AS (SELECT DISTINCT concat('d', o_custkey % 50, '/e', o_orderkey % 7, '/f', o_orderkey) AS f, concat(CASE WHEN o_custkey % 50 % 3 = 0 THEN 'n' ELSE 'd' END, o_custkey % 50, '/e', o_orderkey % 7, CASE WHEN o_orderkey % 7 = 2 THEN 'x' ELSE '' END, '/f', o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'y' ELSE '' END) AS t FROM orders),
every AS (SELECT f, t FROM e UNION SELECT regexp_replace(f, '/[^/]*$', ''), regexp_replace(t, '/[^/]*$', '') FROM e UNION SELECT split_part(f, '/', 1), split_part(t, '/', 1) FROM e),
p AS (SELECT * FROM every WHERE f <> t)
SELECT f AS from_path, t AS to_path FROM p WHERE NOT (split_part(f, '/', -1) = split_part(t, '/', -1) AND EXISTS (SELECT 1 FROM p q WHERE q.f = regexp_replace(p.f, '/[^/]*$', '') AND q.t = regexp_replace(p.t, '/[^/]*$', '') AND p.f LIKE '%/%'))""")
def d4c(s, d):
    """Renames of files and directories, of which those that a directory's rename explains go."""
    e = s.read.parquet(f"{d}/orders.parquet").selectExpr("concat('d', o_custkey % 50, '/e', o_orderkey % 7, '/f', o_orderkey) AS f", "concat(CASE WHEN o_custkey % 50 % 3 = 0 THEN 'n' ELSE 'd' END, o_custkey % 50, '/e', o_orderkey % 7, CASE WHEN o_orderkey % 7 = 2 THEN 'x' ELSE '' END, '/f', o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'y' ELSE '' END) AS t")
    up = lambda df: df.select(C.path_parent(F.col("f")).alias("f"), C.path_parent(F.col("t")).alias("t")).distinct()
    every = e.unionByName(up(e)).unionByName(up(up(e))).where("f != t").distinct()
    return diff.top_renames(every.selectExpr("f AS from_path", "t AS to_path"))


@query("d8_renamed_directories")
def d8b(s, d):
    """A log of files in directories that are renamed again and again (a replay in order; tested against one)."""
    return diff.merge_scan_messages(tree_log(s, d))


def tree_log(s, d) -> DataFrame:
    place = "concat('d', user_id % 20, '/e', user_id % 3)"
    return s.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS seq", "CASE WHEN event_id % 50 = 7 THEN 'Renamed' WHEN event_id % 9 = 4 THEN 'Deleted' ELSE 'Scanned' END AS kind", f"CASE WHEN event_id % 100 = 7 THEN concat('d', event_id % 17) WHEN event_id % 100 = 57 THEN concat({place}, 'x') ELSE concat({place}, '/f', event_id % 40) END AS relative_path", f"CASE WHEN event_id % 100 = 7 THEN concat('d', event_id % 20) WHEN event_id % 100 = 57 THEN {place} END AS from_path", "CAST(floor(value) AS BIGINT) AS size")


@query("i8_retry_rounds", _with("failures") + """, r AS (SELECT event_id, kind, event_id % 6 AS bad, kind IN ('TimedOut', 'S3Error', 'NotConnected') AS again FROM failures)
SELECT event_id, CASE WHEN bad = 0 THEN 'ok' WHEN NOT again THEN 'permanent' WHEN bad < 4 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN bad = 0 OR NOT again THEN 1 WHEN bad < 4 THEN CAST(bad + 1 AS INTEGER) ELSE 4 END AS attempts, CASE WHEN bad = 0 OR (again AND bad < 4) THEN NULL ELSE kind || ': event' END AS error FROM r""")
def i8c(s, d):
    """Events that fail up to five times, tried four times where their kind is worth it."""
    tries = iter(range(4))

    def work(rows):
        return rows.select("event_id", F.when(F.col("event_id") % 6 > next(tries), F.concat("kind", F.lit(": event"))).alias("error"))

    return outcomes.in_rounds(derived(s, d, "failures"), work, "event_id", wait=lambda seconds: None)


@query("g6_stream_scan", "SELECT concat('o', o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN '.log' ELSE '.csv' END) AS relative_path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) > 150000 AND o_orderkey % 2 <> 0")
def g6(s, d):
    entries = streams.read_stream(s, f"{d}/orders.parquet").selectExpr("concat('o', o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN '.log' ELSE '.csv' END) AS relative_path", "CAST(floor(o_totalprice) AS BIGINT) AS size")
    return streams.drain(streams.stream_scan(entries, "size > 150000", "extension == log"))


@query("g7_stream_commits", _with("commits") + ' SELECT file, CAST(sum("end" - "start") AS BIGINT) AS bytes, count(*) AS n_commits FROM (SELECT DISTINCT * FROM commits) GROUP BY file')
def g7(s, d):
    # all commits are in one micro-batch, before any watermark has advanced
    events = streams.read_stream(s, f"{d}/lineitem.parquet").selectExpr(*_exprs("commits", True), "CAST(l_shipdate AS TIMESTAMP) AS ts")
    kept = streams.drain(streams.stream_commits(events, "36500 days"))
    return kept.groupBy("file").agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("*").alias("n_commits"))


@query("g8_stream_throughput", _LOG + " SELECT ts_us // 3600000000 * 3600 AS window_start, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfers GROUP BY 1")
def g8(s, d):
    log = streams.read_stream(s, f"{d}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "CAST(floor(value * 1048576) AS BIGINT) AS bytes")
    return streams.drain(streams.stream_throughput(log, "1 hour"), "complete")


@query("g9_stream_deletes", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'deleted' END AS status, count(*) AS n FROM events GROUP BY 1")
def g9(s, d):
    results = streams.read_stream(s, f"{d}/events.parquet").select(F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"))
    return streams.drain(streams.stream_delete_progress(results), "complete")


@query("k_more_columns", INV + """ SELECT relative_path, CAST(mtime_ns - 800000000000000000 AS DOUBLE) / 86400e9 AS days, CAST(CASE WHEN mode = 33188 THEN 420 ELSE 292 END AS BIGINT) AS smb, mtime_ns // 1000000 AS ms, size * 1000000 AS ns, 'r/' || relative_path AS joined, substr(relative_path, 8) AS inner_path FROM inv_src""")
def km(s, d):
    m, path = F.col("mtime_ns"), F.col("relative_path")
    joined = C.join_paths(F.lit("r//"), F.concat(F.lit("/"), path))
    return inv.inv_src(s, d).select(path, C.days_between(F.lit(800000000000000000), m).alias("days"), C.smb_mode(F.lit(False), F.col("mode") != 33188).alias("smb"), C.ns_to_millis(m).alias("ms"), C.millis_to_ns(F.col("size")).alias("ns"), joined.alias("joined"), C.strip_root(path, "orders/").alias("inner_path"))


@query("d9_plan_renames", INV + """, p AS (SELECT relative_path AS f, CASE WHEN ino % 41 = 0 THEN relative_path || '/sub' WHEN ino % 3 = 0 THEN 'archive/' || relative_path WHEN ino % 19 = 0 THEN replace(relative_path, 'orders/', 'moved/') ELSE relative_path END AS t, size AS e FROM inv_src)
SELECT f AS from_path, t AS to_path, CASE WHEN f = t THEN 'noop' WHEN starts_with(t, f || '/') THEN 'subtree' WHEN a.relative_path IS NOT NULL THEN CASE WHEN a.size <> e THEN 'source_size' ELSE 'copy' END
  WHEN b.relative_path IS NOT NULL THEN CASE WHEN b.size = e THEN 'done' ELSE 'destination_size' END ELSE 'missing' END AS status
FROM p LEFT JOIN inv_dst a ON a.relative_path = f LEFT JOIN inv_dst b ON b.relative_path = t""")
def d9(s, d):
    to = F.expr("CASE WHEN ino % 41 = 0 THEN relative_path || '/sub' WHEN ino % 3 = 0 THEN 'archive/' || relative_path WHEN ino % 19 = 0 THEN replace(relative_path, 'orders/', 'moved/') ELSE relative_path END")
    pairs = inv.inv_src(s, d).select(F.col("relative_path").alias("from_path"), to.alias("to_path"), F.col("size").alias("expected_size"))
    return outcomes.plan_renames(pairs, inv.inv_dst(s, d))


@query("c5_attribute_errors", _with("copies") + " SELECT file, CASE WHEN write_error IS NOT NULL THEN 'destination' WHEN read_error IS NOT NULL THEN 'source' END AS side, coalesce(write_error, read_error) AS error FROM copies")
def c5(s, d):
    return outcomes.attribute_errors(derived(s, d, "copies")).select("file", "side", "error")


@query("c6_safe_to_delete", _with("copies") + " SELECT file FROM copies WHERE verified AND committed AND NOT reserve")
def c6(s, d):
    return outcomes.safe_to_delete_source(derived(s, d, "copies")).select("file")


@query("i9_hdfs_mtime", INV + """ SELECT s.relative_path, CASE WHEN s.ino % 4 = 0 THEN true WHEN s.ino % 2 = 1 THEN s.mtime_ns // 1000000 = d.mtime_ns // 1000000 ELSE s.mtime_ns = d.mtime_ns END AS same_time FROM inv_src s JOIN inv_dst d ON s.relative_path = d.relative_path""")
def i9(s, d):
    other = inv.inv_dst(s, d).select("relative_path", F.col("mtime_ns").alias("other_ns"))
    both = inv.inv_src(s, d).join(other, "relative_path")
    kind = F.when(F.col("ino") % 4 == 0, "s3").when(F.col("ino") % 2 == 1, "hdfs").otherwise("nas")
    return both.select("relative_path", integrity.hdfs_mtime_match(F.col("mtime_ns"), F.col("other_ns"), F.lit("nas"), kind).alias("same_time"))


@query("i8_retries", _with("failures") + """, r AS (SELECT *, kind IN ('TimedOut', 'S3Error', 'NotConnected') AND NOT hdfs AS again FROM failures), w(attempt, delay_ms) AS (VALUES (1, 200), (2, 500), (3, 1000))
SELECT event_id, attempt, delay_ms FROM r JOIN w ON again UNION ALL SELECT event_id, 0, NULL FROM r WHERE NOT again""")
def i8(s, d):
    return outcomes.split_retryable(derived(s, d, "failures")).select("event_id", "attempt", "delay_ms")


@query("v5_name_order", INV + " SELECT relative_path, row_number() OVER (ORDER BY split_part(relative_path, '/', -1), mtime_ns, relative_path) - 1 AS position FROM inv_src")
def v5(s, d):
    return order.name_order(inv.inv_src(s, d)).select("relative_path", "position")


def _tree(s, d) -> DataFrame:
    """Files and directories; some directories are hidden from pages but walked."""
    files = inv.inv_src(s, d)
    every = files.select("relative_path", F.lit(False).alias("is_dir")).unionByName(inv.synthesize_dirs(files).select("relative_path", "is_dir"))
    return every.withColumn("visible", ~F.col("is_dir") | ~F.endswith("relative_path", F.lit("7")))


_PAGES = INV + _DIRS + """, e AS (SELECT relative_path AS p, false AS sub, true AS vis FROM inv_src UNION ALL SELECT relative_path, true, right(relative_path, 1) <> '7' FROM dirs),
i AS (SELECT *, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS page, split_part(p, '/', -1) AS name FROM e),
d AS (SELECT '' AS p UNION ALL SELECT p FROM i WHERE sub),
f AS (SELECT p FROM i JOIN (SELECT page, max(name) AS last FROM i WHERE sub AND vis GROUP BY page) USING (page) WHERE sub AND name < last),
u AS (SELECT p, unnest(list_transform(range(1, len(string_split(p, '/')) + 1), lambda k : array_to_string(string_split(p, '/')[1:k], '/'))) AS above FROM d),
later AS (SELECT DISTINCT u.p FROM u JOIN f ON u.above = f.p),
n AS (SELECT page AS p, count(*) FILTER (NOT sub OR vis) AS n, bool_or(sub) AS parent FROM i GROUP BY page),
g AS (SELECT d.p, coalesce(n.n, 0) AS n, coalesce(n.parent, false) OR later.p IS NOT NULL AS gap FROM d LEFT JOIN n ON n.p = d.p LEFT JOIN later ON later.p = d.p),
w AS (SELECT *, CAST(coalesce(sum(n + gap::INTEGER) OVER (ORDER BY string_split(p, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM g)"""


@query("w3_number_pages", _PAGES + " SELECT i.p AS relative_path, i.page, first + row_number() OVER (PARTITION BY page ORDER BY sub, name) - 1 AS ndx FROM i JOIN w ON w.p = i.page WHERE NOT sub OR vis")
def w3(s, d):
    return order.number_pages(_tree(s, d))[0]


@query("w3_pages", _PAGES + " SELECT p AS dir_path, first AS ndx_start, n AS n_entries, CASE WHEN gap THEN first + n ELSE -1 END AS gap_ndx FROM w WHERE n > 0")
def w3b(s, d):
    return order.number_pages(_tree(s, d))[1]


@query("w4_find_packages", INV + _DIRS + " SELECT relative_path AS package FROM dirs WHERE len(string_split(relative_path, '/')) = 3 AND split_part(relative_path, '/', 2) <= '19960301'")
def w4(s, d):
    return order.find_packages(inv.synthesize_dirs(inv.inv_src(s, d)), "dir_date <= 19960301 or (dir_date > 19960301 and name == x)", 1, 3)


@query("r5_validate_state", INV + " SELECT ino AS file, size, CASE WHEN ino % 6 = 0 THEN NULL WHEN ino % 5 = 0 THEN 'unreadable state' WHEN ino % 4 = 0 THEN 'size changed: was ' || (size + 1) || ', now ' || size END AS error FROM inv_src")
def r5(s, d):
    files = inv.inv_src(s, d).select(F.col("ino").alias("file"), "size")
    state = F.concat(F.lit('{"size":'), (F.col("size") + F.when(F.col("file") % 4 == 0, 1).otherwise(0)).cast("string"), F.when(F.col("file") % 5 == 0, "").otherwise(',"missing":[[8,16]]}'))
    return planning.validate_prior_state(files.where("file % 6 <> 0").select("file", state.alias("state")), files)


@query("a5_nfs4_acl", _ACES + " SELECT path, type, flags, mask, trustee AS who, CAST(NULL AS VARCHAR) AS error FROM aces WHERE mask <> 0 UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'ACE who: unexpected end' FROM aces WHERE mask = 0")
def a5(s, d):
    lists = derived(s, d, "aces").groupBy("path").agg(F.collect_list(F.struct("type", "flags", "mask", F.col("trustee").alias("who"))).alias("aces"))
    blob = blobs.encode_nfs4_acl(F.col("aces"))
    lists = lists.select("path", blob.alias("blob"), F.exists("aces", lambda a: a["mask"] == 0).alias("short"))
    lists = lists.select("path", F.when(F.col("short"), F.expr("substring(blob, 1, octet_length(blob) - 1)")).otherwise(F.col("blob")).alias("blob"))
    out = lists.select("path", blobs.decode_nfs4_acl(F.col("blob")).alias("x"))
    return out.select("path", "x.error", F.explode_outer("x.aces").alias("a")).select("path", "a.type", "a.flags", "a.mask", "a.who", "error")


@query("a6_xattr", "SELECT c_custkey AS file, 'user.name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'user.segment', c_mktsegment FROM customer")
def a6(s, d):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("binary").alias("value"))
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("file"), F.array(pair("user.name", "c_name"), pair("user.segment", "c_mktsegment")).alias("pairs"))
    out = rows.select("file", blobs.encode_xattr(F.col("pairs")).alias("blob")).select("file", blobs.decode_xattr(F.col("blob")).alias("x"))
    return out.select("file", F.explode("x.xattrs").alias("a")).select("file", "a.name", F.col("a.value").cast("string").alias("value"))


@query("t3_ustar_header", INV + """ SELECT relative_path, lpad(format('{:o}', mode), 7, '0') || '|' || lpad(format('{:o}', coalesce(uid, 0)), 7, '0') || '|' || lpad(format('{:o}', gid), 7, '0') || '|' || lpad(format('{:o}', size), 11, '0') || '|' || lpad(format('{:o}', mtime_ns // 1000000000), 11, '0') AS numbers, CAST(512 AS INTEGER) AS n_bytes FROM inv_dst""")
def t3(s, d):
    head = blobs.ustar_header(F.col("relative_path"), F.col("size"), F.col("mtime_ns"), F.col("mode"), F.col("uid"), F.col("gid"), F.lit("0"), F.lit(""))
    rows = inv.inv_dst(s, d).select("relative_path", head.alias("head"))
    field = lambda at, n: F.substring("head", at, n).cast("string")
    return rows.select("relative_path", F.concat_ws("|", field(101, 7), field(109, 7), field(117, 7), field(125, 11), field(137, 11)).alias("numbers"), F.octet_length("head").alias("n_bytes"))


@query("g7_commit_coverage", _COVER + """, f AS (SELECT o_orderkey AS file, CAST((o_orderkey % 7 + 1) * 1048576 AS BIGINT) AS size FROM orders),
ins AS (SELECT f.file, greatest("start", 0) AS a, least("end", size) AS b FROM f JOIN cover ON f.file = cover.file WHERE least("end", size) > greatest("start", 0)),
sums AS (SELECT file, CAST(sum(b - a) AS BIGINT) AS covered, count(*) AS n_ranges FROM ins GROUP BY file)
SELECT f.file, coalesce(covered, 0) AS covered, coalesce(n_ranges, 0) AS n_ranges, coalesce(covered, 0) = size AS complete FROM f LEFT JOIN sums ON f.file = sums.file""")
def g7b(s, d):
    events = streams.read_stream(s, f"{d}/lineitem.parquet").selectExpr(*_exprs("commits", True), "CAST(l_shipdate AS TIMESTAMP) AS ts")
    files = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS file", "CAST((o_orderkey % 7 + 1) * 1048576 AS BIGINT) AS size")
    return streams.commit_coverage(streams.drain(streams.stream_commits(events, "36500 days")), files)


@query("g7_stream_coverage", _COVER + """, f AS (SELECT o_orderkey AS file, CAST((o_orderkey % 7 + 1) * 1048576 AS BIGINT) AS size FROM orders),
ins AS (SELECT f.file, greatest("start", 0) AS a, least("end", size) AS b FROM f JOIN cover ON f.file = cover.file WHERE least("end", size) > greatest("start", 0)),
sums AS (SELECT file, CAST(sum(b - a) AS BIGINT) AS covered, count(*) AS n_ranges FROM ins GROUP BY file)
SELECT f.file, coalesce(covered, 0) AS covered, coalesce(n_ranges, 0) AS n_ranges, coalesce(covered, 0) = size AS complete, CASE WHEN coalesce(covered, 0) = size THEN 1 ELSE 0 END AS n_told FROM f LEFT JOIN sums ON f.file = sums.file""")
def g7c(s, d):
    events = streams.read_stream(s, f"{d}/lineitem.parquet").selectExpr(*_exprs("commits", True))
    files = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS file", "CAST((o_orderkey % 7 + 1) * 1048576 AS BIGINT) AS size")
    cover, batches = streams.stream_coverage(events, files)
    told = cover.completed().groupBy("file").agg(F.count("*").cast("int").alias("n_told"))
    return cover.report(batches).join(told, "file", "left").withColumn("n_told", F.coalesce("n_told", F.lit(0)))


@query("w5_tree_totals", INV + _DIRS + " SELECT (SELECT count(*) FROM inv_src) AS n_files, (SELECT count(*) FROM dirs) AS n_dirs, CAST((SELECT sum(size) FROM inv_src) AS BIGINT) AS bytes, (SELECT max(size) FROM inv_src) AS largest, CAST(4 AS BIGINT) AS deepest")
def w5b(s, d):
    files = inv.inv_src(s, d).select("relative_path", F.lit(False).alias("is_dir"), "size", "mtime_ns")
    return inv.tree_totals(files.unionByName(inv.synthesize_dirs(files)))


@query("s4_inventory", INV + " SELECT relative_path, size, mode FROM inv_src")
def s4(s, d):
    """The inventory written by mode and read again."""
    path = f"{shared_dir(s)}/inventory-{uuid.uuid4().hex}"
    inv.write_inventory(inv.inv_src(s, d), path, ["mode"])
    return inv.read_inventory(s, path).select("relative_path", "size", F.col("mode").cast("long").alias("mode"))


@query("s1_listing")
def s1(s, d):
    """The files of the order table (no SQL: names and times are those of the store)."""
    return inv.read_listing(s, f"{d}/orders.parquet")


@query("s3_read_chunks")
def s3(s, d):
    """The order table's own files in chunks of 64 KiB, less their second ones (no SQL: files of a store)."""
    files = inv.read_listing(s, f"{d}/orders.parquet").select(F.substring_index("path", "/", -1).alias("relative_path"), "size")
    ranges = files.select("relative_path", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(65536).cast("long").alias("end")), F.struct(F.lit(131072).cast("long").alias("start"), F.col("size").alias("end")))).alias("r"))
    got = chunks.read_chunks(s, f"{d}/orders.parquet", 65536, ranges.select("relative_path", "r.start", "r.end"))
    return got.select("relative_path", "offset", F.length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"))


@query("d7_change_cube", DIFF + " SELECT state, top, count(*) AS n_entries, CAST(coalesce(sum(coalesce(c_size, p_size, 0)), 0) AS BIGINT) AS bytes FROM (SELECT *, split_part(relative_path, '/', 1) AS top FROM diff) GROUP BY CUBE (state, top)")
def d7b(s, d):
    return diff.change_cube(_diff(s, d))


@query("i7_field_report", QUICK + ", e AS (SELECT outcome, split_part(relative_path, '/', 1) AS top, unnest(string_split(fields, ',')) AS field FROM q) SELECT outcome, field, top, count(*) AS n_entries FROM e GROUP BY GROUPING SETS ((outcome, field, top), (outcome, field))")
def i7b(s, d):
    return integrity.field_report(integrity.quick_check(inv.inv_src(s, d), inv.inv_dst(s, d)))


@query("w5_page_totals", _PAGES + " SELECT (SELECT count(*) FROM w WHERE n > 0) AS n_pages, (SELECT count(*) FROM i JOIN w ON w.p = i.page WHERE NOT sub OR vis) AS n_numbered, (SELECT max(first + n - 1 + CASE WHEN gap THEN 1 ELSE 0 END) FROM w WHERE n > 0) AS max_ndx")
def w5c(s, d):
    return order.page_totals(*order.number_pages(_tree(s, d)))


@query("d6_carried_values", DIFF + """, k AS (SELECT relative_path, length(relative_path) % 3 AS k FROM diff WHERE state IN ('metadata_changed', 'data_changed', 'both_changed'))
SELECT k.relative_path, CASE WHEN k.k = 1 THEN mtime_ns END AS atime_ns, mtime_ns, CASE WHEN k.k = 0 THEN uid END AS uid, CASE WHEN k.k = 0 THEN gid END AS gid, CASE WHEN k.k <> 1 THEN mode % 4096 END AS mode FROM k JOIN inv_dst d ON d.relative_path = k.relative_path""")
def d6b(s, d):
    """What set_metadata writes to a file system, of entries that come from three kinds of store."""
    actions = diff.sync_actions(_diff(s, d)).withColumn("src_kind", F.expr("element_at(array('nas', 's3', 'hdfs'), CAST(length(relative_path) % 3 + 1 AS INT))"))
    return diff.carried_values(actions, inv.inv_dst(s, d), "nas").drop("owner", "owner_group")


@query("s1_walk")
def s1b(s, d):
    """The tables' own files and folders, by a distributed walk (no SQL: files of a store)."""
    return store.walk(s, d, tasks=8)[0].select("relative_path", "is_dir", "size", "mtime_ns", "error")


def _own_files(s, d) -> DataFrame:
    return store.walk(s, d, tasks=8)[0].where("NOT is_dir AND NOT is_symlink").select("relative_path", "size")


@query("c4_copy_files")
def c4(s, d):
    """The tables' own files copied in pieces to the shared folder and compared there (no SQL: files of a store)."""
    files, target = _own_files(s, d), store.mounted(shared_dir(s)) + f"/copies-{uuid.uuid4().hex}"
    done = transfer.copy_files(files, store.mounted(d), target, tasks=8, piece=1 << 20)
    return done.join(chunks.check_files(s, files, d, target, tasks=8), "relative_path")


@query("r3_resumable_copy")
def r3b(s, d):
    """The same by two runs of a resumable copy, of which the first leaves out every third piece (no SQL)."""
    files, top = _own_files(s, d), store.mounted(shared_dir(s)) + f"/resumed-{uuid.uuid4().hex}"
    run = lambda stop: transfer.copy_resumable(files, store.mounted(d), f"{top}/files", f"{top}/state", tasks=8, piece=1 << 18, stop=stop)
    run(lambda path, start: start // (1 << 18) % 3 == 1)
    again = run(None)
    return again.files.join(planning.check_accounting(again.sent, again.planned, "relative_path"), "relative_path", "left")


@query("t4_pack_to_tar")
def t4(s, d):
    """The tables' own files, and the folders of a table that has many, as one archive (no SQL: files of a store)."""
    every = store.walk(s, d, tasks=8)[0]
    top = store.mounted(d)
    entries = every.select(F.lit(top.rsplit("/", 1)[1]).alias("package"), F.concat(F.lit(top.rsplit("/", 1)[1] + "/"), "relative_path").alias("relative_path"), "size", "is_dir", "is_symlink")
    return transfer.pack_to_tar(entries, top.rsplit("/", 1)[0], store.mounted(shared_dir(s)) + f"/tar-{uuid.uuid4().hex}", tasks=8)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
