"""Places in an order over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pinned import pin


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with ``rn``, their 1-based place in the order.

    Numbers are dealt by range partition: counts per partition are summed over
    the partitions only, and rows are numbered inside theirs, so no task holds
    the whole table.
    """
    ranged = pin(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return inside.join(F.broadcast(before), "_part").withColumn("rn", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def running(rows: DataFrame, n: str, *order: Column | str) -> DataFrame:
    """Rows with ``_upto``, the sum of ``n`` over all rows up to and with theirs; by range partition as above."""
    ranged = pin(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_in", F.sum(n).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return inside.join(F.broadcast(before), "_part").withColumn("_upto", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
