"""Distributed running totals (prefix sums) without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task. For
ranks, ROC/PR curves and rank-sum statistics we need cumulative counts over a
global order, so the prefix sum is done in three distributed steps:

1. range-partition on the order key (Spark samples the key and splits it into
   contiguous ranges) and tag each row with its partition id; the tagged frame
   is checkpointed so the assignment is fixed even if tasks are recomputed;
2. per-partition totals (one row per partition) → exclusive offsets with a
   window over at most ``n_partitions`` rows;
3. an in-partition running sum plus the broadcast offset.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], ascending: bool = True,
                   n_partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of ``c`` in ``order_col`` order.

    ``df`` should already be grouped to distinct order values (ties collapsed),
    which is how every caller uses it.
    """
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    ranged = df.repartitionByRange(n, order).withColumn("__pid", F.spark_partition_id())
    ranged = cut_lineage(ranged, spark)
    totals = ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}")
                                       for c in sum_cols])
    inside = Window.partitionBy("__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__pid")
    out = out.withColumns({f"{prefix}{c}": F.sum(c).over(inside) + F.col(f"__o_{c}") for c in sum_cols})
    return out.drop("__pid", *[f"__o_{c}" for c in sum_cols])
