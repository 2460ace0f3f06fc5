"""Ordered work on groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into slices of its
order column, each slice is its own window, and only one row per slice is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def carried_last(
    df: DataFrame, keys: list[str], order: str, slice_column: str, value: Column, name: str
) -> DataFrame:
    """Add the latest non-null `value` before each row of its group.

    `slice_column` must rise with `order`; `order` must be unique within a group.
    """
    df = df.withColumn("_value", value)
    inside = Window.partitionBy(*keys, slice_column).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.where(F.col("_value").isNotNull())
        .groupBy(*keys, slice_column)
        .agg(F.max_by("_value", order).alias("_last"))
    )
    slices = (
        df.select(*keys, slice_column)
        .distinct()
        .join(carried, [*keys, slice_column], "left")
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(across))
        .drop("_last")
    )
    return (
        df.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(slices, [*keys, slice_column], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_value", "_inside", "_carried")
    )


def running_total(
    df: DataFrame, keys: list[str], order: str, slice_column: str, value: Column, name: str
) -> DataFrame:
    """Add the sum of `value` over the rows before each row of its group."""
    df = df.withColumn("_value", value)
    inside = Window.partitionBy(*keys, slice_column).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        df.groupBy(*keys, slice_column)
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_carried", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .drop("_total")
    )
    return (
        df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(slices, [*keys, slice_column])
        .withColumn(name, F.col("_inside") + F.col("_carried"))
        .drop("_value", "_inside", "_carried")
    )
