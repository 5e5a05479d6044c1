"""Global order without a global task: running totals, page numbers of a tree walk and date packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.functions.columns import path_components, path_depth, path_name, path_parent
from haulage.functions.names import free
from haulage.functions.shared import cut
from haulage.operators import filters
from haulage.sources.inventory import prefixes


def running(df: DataFrame, order: list, totals: dict[str, Column | None]) -> DataFrame:
    """df with the sum of each weight over all rows before a row in `order` (None: the number of such rows).

    Rows are dealt out and sorted by range and written once, so that ties keep their place; only one total per
    partition passes the driver. Equal rows count in any one order.
    """
    at, part, *weights = free([df, *[df.sparkSession.range(0).toDF(n) for n in totals]], "_id", "_part", *[f"_w_{n}" for n in totals], *[f"_b_{n}" for n in totals])
    bases = dict(zip(totals, weights[len(totals) :]))
    weights = {n: c for (n, w), c in zip(totals.items(), weights) if w is not None}
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    spread = cut(spread.select("*", *[totals[n].cast("long").alias(c) for n, c in weights.items()]))
    spread = spread.withColumn(part, F.shiftright(at, 33))
    sums = [(F.coalesce(F.sum(weights[n]), F.lit(0)) if n in weights else F.count("*")).alias(bases[n]) for n in totals]
    parts = sorted(spread.groupBy(part).agg(*sums).collect())
    base, so_far = [], [0] * len(totals)
    for p in parts:
        base.append((p[0], *so_far))
        so_far = [a + b for a, b in zip(so_far, p[1:])]
    schema = f"`{part}` long, " + ", ".join(f"`{c}` long" for c in bases.values())
    both = spread.join(F.broadcast(df.sparkSession.createDataFrame(base, schema)), part)
    before = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    here = {n: F.coalesce(F.sum(weights[n]).over(before), F.lit(0)) if n in weights else F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) for n in totals}
    return both.select(*df.columns, *[(F.col(bases[n]) + c).alias(n) for n, c in here.items()])


def name_order(entries: DataFrame) -> DataFrame:
    """entries with `position` from 0 by (name, mtime_ns, relative_path): equal names keep their order in time."""
    named = entries.withColumn("name", path_name(F.col("relative_path")))
    return running(named, ["name", "mtime_ns", "relative_path"], {"position": None})


def number_pages(entries: DataFrame, max_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Numbers of a depth-first walk: (relative_path, page, ndx) and (dir_path, ndx_start, n_entries, gap_ndx).

    entries: relative_path, is_dir and, if filtered, visible (hidden directories are walked but not listed). A page
    lists a directory's files by name, then its visible subdirectories by name. After each page, also one without
    entries, a gap number follows, unless there are no subdirectories and no later visible sibling of the directory or
    of any above it (gap_ndx -1). Directories at max_depth count as files; pages without entries are not returned. No
    step groups by page but partial sums: the rows of one large directory are numbered in many tasks.
    """
    path = F.col("relative_path")
    deeper = path_depth(path) < max_depth if max_depth else F.lit(True)
    seen = F.coalesce(F.col("visible"), F.lit(True)) if "visible" in entries.columns else F.lit(True)
    own = entries.where(path_depth(path) <= max_depth) if max_depth else entries
    own = own.select("relative_path", (F.col("is_dir") & deeper).alias("is_sub"), seen.alias("visible"), path_parent(path).alias("page"), path_name(path).alias("name"))
    items, subs = own.where("NOT is_sub OR visible"), own.where("is_sub")
    last = subs.where("visible").groupBy("page").agg(F.max("name").alias("_last"))
    followed = subs.join(last, "page").where("name < _last").select(path.alias("_above"))
    lines = subs.select("relative_path", F.explode(F.concat(prefixes(path), F.array(path))).alias("_above"))
    later = lines.join(followed, "_above", "left_semi").select(path.alias("page")).distinct()
    listed = own.groupBy("page").agg(F.sum(F.when(~F.col("is_sub") | F.col("visible"), 1).otherwise(0)).alias("n_entries"), F.bool_or("is_sub").alias("_parent"))
    root = own.sparkSession.createDataFrame([("",)], "page string")
    dirs = subs.select(path.alias("page")).union(root).join(listed, "page", "left").join(later.withColumn("_later", F.lit(True)), "page", "left")
    gap = F.coalesce(F.col("_parent"), F.lit(False)) | F.coalesce(F.col("_later"), F.lit(False))
    dirs = dirs.select("page", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), gap.alias("_gap"), path_components(F.col("page")).alias("_c"))
    pages = running(dirs, ["_c"], {"_items": F.col("n_entries"), "_gaps": F.col("_gap")})
    numbered = running(items.withColumn("_c", path_components(F.col("page"))), ["_c", "is_sub", "name"], {"_at": None})
    rows = numbered.join(pages.select("page", "_gaps"), "page").select("relative_path", "page", (F.col("_at") + F.col("_gaps")).alias("ndx"))
    start = F.col("_items") + F.col("_gaps")
    out = pages.where("n_entries > 0").select(F.col("page").alias("dir_path"), start.alias("ndx_start"), "n_entries", F.when(F.col("_gap"), start + F.col("n_entries")).otherwise(F.lit(-1).cast("long")).alias("gap_ndx"))
    return rows, out


def page_totals(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """One row over number_pages' results: n_pages, n_numbered and max_ndx, the greatest number given out, gaps included
    (null if none)."""
    last = F.greatest("gap_ndx", F.col("ndx_start") + F.col("n_entries") - 1)
    both = pages.select(F.lit(1).alias("page"), last.alias("last"), F.lit(0).alias("row")).unionByName(rows.select(F.lit(0).alias("page"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("row")))
    return both.agg(F.coalesce(F.sum("page"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("row"), F.lit(0)).alias("n_numbered"), F.max("last").alias("max_ndx"))


def _dated(node, inputs: filters.Inputs) -> Column:
    """The truth of an expression of which only dir_date conditions can hold."""
    if isinstance(node, tuple):
        left, right = _dated(node[1], inputs), _dated(node[2], inputs)
        return left & right if node[0] == "and" else left | right
    return filters.dir_date_holds(node, inputs) if node.field == "dir_date" else F.lit(False)


def find_packages(dirs: DataFrame, match: str, package_depth: int = 0, max_depth: int = 0) -> DataFrame:
    """package: the topmost directories whose names meet the dir_date conditions of match, or with package_depth the
    directories exactly that far below them; none whose depth would pass max_depth. Ancestors are joined by equal
    paths, over directories only."""
    path = F.col("relative_path")
    own = dirs.where("is_dir").select("relative_path", F.lit(True).alias("is_dir")).distinct()
    hits = own.where(_dated(filters.parse(match), filters.Inputs(size=F.lit(None), mtime_ns=F.lit(None)))).select("relative_path")
    above = hits.select(path.alias("_above"))
    inner = hits.select("relative_path", F.explode(prefixes(path)).alias("_above")).join(above, "_above", "left_semi").select("relative_path").distinct()
    top = hits.join(inner, "relative_path", "left_anti")
    if max_depth:
        top = top.where(path_depth(path) + package_depth <= max_depth)
    if not package_depth:
        return top.select(path.alias("package"))
    parts = path_components(path)
    below = own.where(F.size(parts) > package_depth).select(path.alias("package"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - package_depth), "/").alias("relative_path"))
    return below.join(top, "relative_path", "left_semi").select("package")
