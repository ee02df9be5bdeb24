"""Running sums and row numbers over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import staged

#: Up to this many rows (counted first) one window does; beyond it the rows are sorted in ranges.
ONE_TASK = 100_000


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], one_task: int = ONE_TASK) -> DataFrame:
    """rows, staged if they aren't yet, with columns that sum the given values over all rows before a row in ``order``, which must tell all rows apart.

    The rows go to ranges of ``order``, in each of which a window sums. What stands before a range is a window over the
    ranges' totals, one row a partition. Null values count as zero. The number of a row is one more than a running sum of ones.
    """
    rows = rows if hasattr(rows, "_turnwise_path") else staged(rows, "rows")
    n = rows.count()
    rows = rows.withColumns({f"__of_{c}": F.coalesce(v, F.lit(0)) for c, v in sums.items()})
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    if n <= one_task:
        out = rows.withColumns({c: before(f"__of_{c}", upto(W.orderBy(*order))) for c in sums})
        return out.drop(*[f"__of_{c}" for c in sums])
    ranged = rows.repartitionByRange(max(2, -(-n // one_task)), *order).withColumn("__range", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    totals = ranged.groupBy("__range").agg(*[F.sum(f"__of_{c}").alias(f"__total_{c}") for c in sums])
    totals = totals.select("__range", *[before(f"__total_{c}", upto(W.orderBy("__range"))).alias(f"__before_{c}") for c in sums])
    inside = ranged.withColumns({c: before(f"__of_{c}", upto(W.partitionBy("__range").orderBy(*order))) for c in sums})
    out = inside.join(F.broadcast(totals), "__range")  # as many rows as partitions
    return out.withColumns({c: F.col(c) + F.col(f"__before_{c}") for c in sums}).drop("__range", *[x for c in sums for x in (f"__of_{c}", f"__before_{c}")])
