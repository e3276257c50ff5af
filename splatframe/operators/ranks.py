"""Running numbers and totals over all rows, and exact percentiles, without a task that sees them all.

Rows are range-partitioned by the order, so a partition's number is part of their place. Sums inside partitions are
windows; what stands before a partition is a running total over one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatframe.operators.cut import cut

#: Groups whose sizes are sent to all tasks.
FEW = 10_000


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value (whole numbers or doubles) over the rows up to this one, in the order of columns.

    Rows that are equal in order get their sums in any order: name a key to settle it.
    """
    part, own = "__part", "__own"
    dealt = cut(df.withColumn(own, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.sum(own).alias("__total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = totals.select(part, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(own, inside).join(bases, part).withColumn(name, F.col("__base") + F.col(own)).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: the place of the row, from 1."""
    return running(df, order, F.lit(1).cast("long"), name)


def percentile(df: DataFrame, keys: list[str], column: str, share: float, name: str) -> DataFrame:
    """(keys, name): the linearly interpolated percentile of each group's values that aren't null, of any number."""
    values = df.select(*keys, F.col(column).cast("double").alias("__v")).filter("__v is not null")
    placed = cut(numbered(values, [*keys, "__v"], "__at"))
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    spot = F.lit(float(share)) * (F.col("__n") - 1)
    if keys:
        sizes = cut(sizes)
        few = sizes.limit(FEW + 1).count() <= FEW  # a shuffle by few keys would have few tasks
    near = placed.join(F.broadcast(sizes) if few else sizes, keys) if keys else placed.crossJoin(sizes)  # sizes is one row then
    at = F.col("__at") - F.col("__first")
    low = F.max(F.when(at == F.floor(spot), F.col("__v")))
    high = F.max(F.when(at == F.ceil(spot), F.col("__v")))
    part = F.max(spot - F.floor(spot))
    return near.filter((at == F.floor(spot)) | (at == F.ceil(spot))).groupBy(*keys).agg((low + (high - low) * part).alias(name))
