"""Numbers of rows in the order of their group, without one task for a group: two-level prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.storage import written


def numbered(rows: DataFrame, group: list[str], order: list[str], number: str = "number", total: str | None = None, rank: str | None = None) -> DataFrame:
    """rows with number: the place from 0 of a row among those of its group, by order.

    total: how many rows the group has. rank: the place from 0 of the group among all groups. Rows are dealt out by ranges of
    (group, order) and stored; what is summed over is one row for each group of each range, so a group that holds most rows
    is numbered by as many tasks as it has ranges. Nulls are a group of their own and come first; rows that agree in group and
    order get different numbers, in no stated order. No rows give no rows.
    """
    at, part = F.col("_at"), F.shiftright("_at", 33)
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "placed").withColumn("_part", part)
    runs = placed.groupBy(*group, "_part").agg(F.min(at).alias("_from"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*group).orderBy("_part")
    runs = runs.withColumns({
        "_before": F.sum("_n").over(of_group) - F.col("_n"), "_all": F.sum("_n").over(of_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_first": F.min("_part").over(of_group),
    })
    if rank:
        starts = runs.where("_part = _first")
        inner = starts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_from")) - 1)
        by_part = starts.groupBy("_part").agg(F.count("*").alias("_g"))  # a row for each range
        by_part = by_part.select("_part", (F.sum("_g").over(Window.orderBy("_part")) - F.col("_g")).alias("_g"))
        inner = inner.join(by_part, "_part").select(*group, (F.col("_r") + F.col("_g")).alias("_rank"))
        runs = _matched(runs, inner, group)
    keep = ["_from", "_before", "_all"] + ["_rank"] * bool(rank)
    out = _matched(placed, runs.select(*group, "_part", *keep), [*group, "_part"])
    made = {number: at - F.col("_from") + F.col("_before")} | ({total: F.col("_all")} if total else {}) | ({rank: F.col("_rank").cast("long")} if rank else {})
    return out.withColumns(made).select(*rows.columns, *made)


def summed(rows: DataFrame, group: list[str], order: list[str], value: str, before: str = "before") -> DataFrame:
    """rows with before: the sum of value (null: 0) over the rows of the group that come earlier by order.

    As in numbered(), ranges of (group, order) are summed apart and the totals of ranges, one row for each group of each range,
    are summed in turn. Rows that agree in group and order get different places, in no stated order. No rows give no rows.
    """
    sized = F.coalesce(F.col(value), F.lit(0)).cast("long")
    placed = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    totals = placed.groupBy(*group, "_part").agg(F.sum(sized).alias("_sum"))
    totals = totals.withColumn("_start", F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("_inner", F.coalesce(F.sum(sized).over(within), F.lit(0)))
    return _matched(inner, totals, [*group, "_part"]).withColumn(before, F.col("_start") + F.col("_inner")).select(*rows.columns, before)


def _matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that may be null; keeps the columns of left and what right adds."""
    far = right.toDF(*(f"_r_{c}" if c in on else c for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return left.join(far, same).drop(*(f"_r_{c}" for c in on))
