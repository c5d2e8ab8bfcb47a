"""Global ranks, running totals and top-k without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import cut


def bucketed_rank(df: DataFrame, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``out``: 1-based rank in the order of (bucket, order), where ``bucket`` is coarse and rises with the order.

    Buckets are counted, their counts summed up in order (one row each), and rows
    are ranked inside their bucket.
    """
    placed = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return placed.withColumn("_inside", inside).join(starts, "_bucket").withColumn(out, F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_start")


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """``out``: sum of ``value`` over this row and all before it in ``order``, which tells rows apart.

    Rows are range-partitioned and written once; every partition is summed alone
    and shifted by the totals of those before it (one row per partition).
    """
    named = [F.expr(f"_o{i}") for i in range(len(order))]
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)} | {"_v": value})
    placed = cut(keyed.repartitionByRange(*named).withColumn("_part", F.spark_partition_id()), "running")
    sums = placed.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy(*named).rowsBetween(Window.unboundedPreceding, 0))
    drop = ["_part", "_own", "_shift", "_v", *(f"_o{i}" for i in range(len(order)))]
    return placed.withColumn("_own", own).join(F.broadcast(shift), "_part").withColumn(out, F.col("_own") + F.col("_shift")).drop(*drop)


def top_per(df: DataFrame, key: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark prunes each map task's groups to ``k`` before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(out) <= k)


def even_stride(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows per key, evenly spread: those at floor(i * n / most)."""
    by = Window.partitionBy(*key)
    placed = df.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    # i is kept if it is floor(j * n / most) for some j: the least such j is ceil(i * most / n)
    j = F.floor((F.col("_i") * most + F.col("_n") - 1) / F.col("_n"))
    return placed.where((F.col("_n") <= most) | (F.floor(j * F.col("_n") / most) == F.col("_i"))).drop("_i", "_n")


def every_nth(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows per key: every ceil(n / most)-th, from the first."""
    by = Window.partitionBy(*key)
    placed = df.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    step = F.ceil(F.col("_n") / most)
    return placed.where(F.col("_i") % step == 0).drop("_i", "_n")
