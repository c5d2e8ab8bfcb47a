"""Running totals and ranks in one global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut


def running_total(df: DataFrame, order: list[str], value: Column, out: str, name: str = "running") -> DataFrame:
    """``df`` with ``out``: sum of ``value`` over the rows before this one in ``order``.

    Rows are range-partitioned by ``order``, whose last columns should tell rows
    apart, so a hot leading key spreads over partitions. Each partition is summed
    alone and shifted by the totals of those before it (one row per partition).
    """
    placed = cut(
        df.withColumn("_value", value.cast("long")).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()),
        name,
    )
    totals = placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return summed.join(F.broadcast(shifts), "_part").withColumn(out, F.col("_own") + F.col("_shift")).drop("_part", "_value", "_own", "_shift")
