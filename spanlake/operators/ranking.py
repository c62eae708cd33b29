"""Places of rows in their groups, without a task for each group.

Rows are dealt by ranges of (group, order) and written in that order; a row's place is its place in its range, less
where its group begins there, plus the group's rows in earlier ranges. A group of any size is spread over ranges, and
what is counted a second time is one row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.sources.shared import saved

_RANGE = 33  # monotonically increasing ids: bits of a row's place in its partition


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """df with each row's place in its group by ``order``, from 0. Group columns have no nulls; ties get places of their own. Runs at once."""
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = saved(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__range", F.shiftright("__at", _RANGE))
    heads = placed.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = heads.select(*group, "__range", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(shifts, [*group, "__range"]).withColumn(out, F.col("__at") + F.col("__shift")).select(*df.columns, out)
