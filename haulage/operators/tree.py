"""Filters over a whole tree: directories that are pruned or wholly kept decide for everything below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.columns import path_depth, path_parent
from haulage.functions.names import free
from haulage.operators.filters import Inputs, should_skip
from haulage.sources.inventory import limit_depth, prefixes


def filter_tree(df: DataFrame, match: str | None = None, exclude: str | None = None, max_depth: int | None = None, now: int = 0) -> DataFrame:
    """Entries (relative_path, is_dir, size, mtime_ns, ...) that a walk from the root reports.

    A directory that is not to be continued hides all below it; one that is continued without checks keeps all below it
    unseen by either filter. The topmost such directory of a path decides, so no level-by-level walk is needed: only
    the distinct parents are expanded into their ancestors. Directories without a row of their own decide nothing. A null path
    is at the top; columns of any name stay.
    """
    seen = limit_depth(df, max_depth)
    verdict = should_skip(match, exclude, Inputs.of(df, now))
    own, above_it, go, told = free(df, "own_dir", "dir_above", "go", "verdict")
    deciding = seen.where("is_dir").select(F.col("relative_path").alias(above_it), verdict.alias(told)).where(f"NOT {told}.continue_scan OR NOT {told}.check_children").select(above_it, F.col(f"{told}.continue_scan").alias(go))
    parents = seen.select(path_parent(F.col("relative_path")).alias(own)).where(F.col(own) != "").distinct()
    chain = parents.select(own, F.explode(F.concat(prefixes(F.col(own)), F.array(own))).alias(above_it))
    above = chain.join(deciding, above_it).groupBy(own).agg(F.min_by(go, path_depth(F.col(above_it))).alias(go))
    placed = seen.withColumn(own, path_parent(F.col("relative_path"))).join(above, own, "left")
    return placed.where(F.coalesce(F.col(go), ~verdict["skip"])).select(df.columns)
