"""Work dealt to tasks by what it weighs, not by how many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.names import free
from haulage.functions.shared import cut
from haulage.operators.order import running

#: What a row costs beside its bytes (opening and closing a file), in bytes.
OVERHEAD = 64 << 10


def pack(rows: DataFrame, size: Column, order: list[str], tasks: int, overhead: int = OVERHEAD) -> DataFrame:
    """rows in at most `tasks` partitions of nearly equal sums of size plus overhead, each sorted by order.

    Row k goes to the partition that the middle of its stretch of the running total falls in, so a partition differs from
    the mean by at most one row's weight: rows must be cut small enough before. Null sizes weigh the overhead alone, an
    empty table stays empty. Only one total per range partition and the number of tasks pass the driver.
    """
    weight, before, place = free(rows, "_weight", "_before", "_place")
    weighed = rows.withColumn(weight, F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)) + F.lit(overhead))
    summed = cut(running(weighed, order, {before: F.col(weight)}))
    total = summed.agg(F.sum(weight)).first()[0] or 1
    n = max(1, min(tasks, -(-total // max(1, overhead))))
    middle = (F.col(before) + F.col(weight) / 2) / F.lit(total)
    dealt = summed.withColumn(place, F.least(F.floor(middle * n).cast("int"), F.lit(n - 1)))
    return dealt.repartitionById(n, F.col(place)).sortWithinPartitions(*order).select(rows.columns)
