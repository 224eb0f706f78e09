"""Numbers and running values over a whole table in a given order, without one global window.

The table is dealt to ranges of the order, each range is sorted and numbered where it lies, and only one
row per range (its count, its total, its first value) is combined in a single task. So the order may
span billions of rows that all belong to one group. Rows that are equal in the order may also share a
range boundary: a last, arbitrary key can be handed over to spread them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_AT, _PART = "_at", "_part"
_ROWS_OF_A_RANGE = (1 << 33) - 1


def ranged(df: DataFrame, order: list[str | Column], label: str = "ranged") -> DataFrame:
    """`df` sorted over range partitions and written, with `_part` (the range) and `_at` (the place in it)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn(_AT, F.monotonically_increasing_id())
    rows = rows.withColumn(_PART, F.shiftright(_AT, 33).cast("int")).withColumn(
        _AT, F.col(_AT).bitwiseAND(F.lit(_ROWS_OF_A_RANGE))
    )
    return materialize(rows, label)


def _before(parts: DataFrame, column: str, out: str) -> DataFrame:
    """The sum of `column` over all earlier ranges; one row per range, so one small task."""
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(_PART, F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias(out))


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", label: str = "numbered") -> DataFrame:
    """`df` with the number of each row, from 0, in the given order."""
    rows = ranged(df, order, label)
    starts = _before(rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n")), "_n", "_start")
    # One row per range partition: as many as the shuffle has, whatever the table's size.
    joined = rows.join(F.broadcast(starts), _PART)
    return joined.withColumn(name, F.col("_start") + F.col(_AT)).drop(_PART, _AT, "_start")


def running_sum(df: DataFrame, order: list[str | Column], value: str, name: str, label: str = "running") -> DataFrame:
    """`df` with the sum of `value` over all rows before each row in the given order."""
    rows = ranged(df, order, label)
    starts = _before(rows.groupBy(_PART).agg(F.sum(value).alias("_n")), "_n", "_start")
    within = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        summed.join(F.broadcast(starts), _PART)
        .withColumn(name, F.col("_start") + F.col("_own"))
        .drop(_PART, _AT, "_start", "_own")
    )


def running_max(df: DataFrame, order: list[str | Column], value: str, name: str, label: str = "running") -> DataFrame:
    """`df` with the largest `value` among each row and all rows before it in the given order; null where there is none."""
    rows = ranged(df, order, label)
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(_PART).agg(F.max(value).alias("_n")).select(_PART, F.max("_n").over(earlier).alias("_start"))
    within = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_own", F.max(value).over(within))
        .join(F.broadcast(starts), _PART)
        .withColumn(name, F.greatest("_start", "_own"))
        .drop(_PART, _AT, "_start", "_own")
    )
