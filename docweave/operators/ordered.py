"""Ordered state over long groups, by two-level windows.

A window over a whole group puts the group into one task. Here a group is cut into stretches of its order; windows
run within stretches, and what a stretch takes from those before it comes from a window over one row per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut_lineage

#: Values of the order column that one stretch spans.
STRETCH = 4096


def _stretched(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.coalesce(F.col(order), F.lit(0)) / STRETCH))


def running_sum(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows of the group up to this one."""
    rows = _stretched(df, order[0]).withColumn("_v", value.cast("long"))
    own = F.sum("_v").over(Window.partitionBy(group, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(group, "_stretch").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(group, "_stretch", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.withColumn("_own", own).join(base, [group, "_stretch"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_stretch", "_v", "_own", "_base")


def last_value(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null over all rows of the group up to this one."""
    rows = _stretched(df, order[0]).withColumn("_v", value)
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(group, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("_v is not null").groupBy(group, "_stretch").agg(F.max_by("_v", F.struct(*order)).alias("_e"))
    every = rows.select(group, "_stretch").distinct().join(ends, [group, "_stretch"], "left")
    carried = F.last("_e", ignorenulls=True).over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    base = every.select(group, "_stretch", carried.alias("_base"))
    return rows.withColumn("_own", own).join(base, [group, "_stretch"]).withColumn(name, F.coalesce("_own", "_base")).drop("_stretch", "_v", "_own", "_base")


def previous(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the value of the row before in the group's order."""
    rows = _stretched(df, order[0]).withColumn("_v", value)
    own = F.lag("_v").over(Window.partitionBy(group, "_stretch").orderBy(*order))
    first = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy(*order)) == 1
    ends = rows.groupBy(group, "_stretch").agg(F.max_by(F.struct("_v"), F.struct(*order)).alias("_e"))
    base = ends.select(group, "_stretch", F.lag("_e").over(Window.partitionBy(group).orderBy("_stretch")).alias("_base"))
    return rows.withColumn("_own", own).withColumn("_first", first).join(base, [group, "_stretch"]).withColumn(name, F.when(F.col("_first"), F.col("_base._v")).otherwise(F.col("_own"))).drop("_stretch", "_v", "_own", "_base", "_first")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, slices: int = 64) -> DataFrame:
    """df with the place of each row in its group's order, from 1; the order's columns must tell the rows of a group apart.

    For orders that aren't numbers: rows are sorted by range over all tasks, counted in each part, and a part's counts per
    group come from a window over one row per group and part.
    """
    spread = df.repartitionByRange(slices, *group, *order)
    rows = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    sums = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.withColumn("_own", own).join(base, same).withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base", "_p", *[f"_g{i}" for i in range(len(group))])
