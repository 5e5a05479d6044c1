"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node, which hangs on none: then each component is a star."""
    if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a != z").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Large-star then small-star rounds until every component is a star; each round is a few shuffles of the edge table
    and halves the depth of the trees. Edges with a null end and self-loops are dropped, repeated
    edges count once; an empty table gives an empty result. A hub's neighbours arrive through joins of two
    exchanged sides, which AQE splits, and minima are pre-aggregated, so no task gathers a whole component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = cut(e.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct())
    for _ in range(max_rounds):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, e, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        kept = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), large, low)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out.cut_path = e.cut_path  # for drop_cuts
    return out
