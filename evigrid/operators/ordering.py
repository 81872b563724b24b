"""Running sums and earlier values inside groups of any size: no group's order has to pass through one task.

Rows are dealt to ranges of (group, order); each range works on its own, and only one row for each group and range meets in a window.
The ranges are written once, as their borders come from a sample and would differ from one reading to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.sources.scratch import written


def _dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))


def _carried(dealt: DataFrame, group: list[str], own: Column, summary: Column, over_parts: Column) -> DataFrame:
    """dealt with _own, from the row's own range, and _before, from the group's ranges before it."""
    parts = dealt.groupBy(*group, "_part").agg(summary.alias("_of_part"))
    names = [f"_{i}" for i in range(len(group))]
    before = parts.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_part").alias("_p"), over_parts.alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)), F.col("_part") == F.col("_p"))
    return dealt.withColumn("_own", own).join(before, same).drop("_part", "_p", "_of_part", *names)


def _windows(group: list[str], order: list[str], last: int):
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    return inside, Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the row and its group's earlier rows; a null counts as 0. order has no ties inside a group."""
    value = F.coalesce(value, F.lit(0))
    inside, parts = _windows(group, order, 0)
    out = _carried(_dealt(rows, group, order), group, F.sum(value).over(inside), F.sum(value), F.coalesce(F.sum("_of_part").over(parts), F.lit(0)))
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def last_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the value of the nearest earlier row of the group that has one; null without such a row. order has no ties inside a group."""
    inside, parts = _windows(group, order, -1)
    latest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    out = _carried(_dealt(rows, group, order), group, F.last(value, True).over(inside), latest, F.last("_of_part", True).over(parts))
    return out.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before")
