"""Joins of points with intervals, by buckets instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(
    points: DataFrame, intervals: DataFrame, *, point: str, start: str, end: str, width: float, keys: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join where start <= point < end, and on ``keys``.

    Intervals are repeated for each bucket of ``width`` that they touch, points
    have one bucket, so the join is an equality on the bucket with the interval
    as a residual. ``width`` should be about an interval's length.
    """

    def bucket(x: Column) -> Column:
        return F.floor(x / F.lit(float(width))).cast("long")

    spread = F.explode(F.sequence(bucket(F.col(start)), bucket(F.greatest(F.col(end), F.col(start)))))
    right = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", spread)
    left = points.withColumn("_bucket", bucket(F.col(point)))
    keys = keys or []
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys, "_bucket", start, end)
    on = [left[k] == right[k] for k in [*keys, "_bucket"]] + [right[start] <= left[point], left[point] < right[end]]
    joined = left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    for k in [*keys, "_bucket"]:
        joined = joined.drop(right[k])
    return joined.drop("_bucket")


def first_interval(
    points: DataFrame, intervals: DataFrame, *, point: str, start: str, end: str, index: str, label: str, width: float,
    id_col: str, keys: list[str] | None = None,
) -> DataFrame:
    """Add ``label`` of the interval of the least ``index`` that holds the point, or null."""
    found = interval_join(points.select(*(keys or []), id_col, point), intervals, point=point, start=start, end=end, width=width, keys=keys)
    best = found.groupBy(*(keys or []), id_col).agg(F.min_by(label, index).alias(label))
    return points.join(best, [*(keys or []), id_col], "left")


def as_of(left: DataFrame, right: DataFrame, *, keys: list[str], at: str, right_at: str, value: str, ties: str) -> DataFrame:
    """Add the last ``value`` of ``right`` at or before each row, by one sort instead of a range join."""
    from pyspark.sql import Window

    a = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.col(ties).alias("_ties"))
    both = a.withColumn("_ties", F.lit(None).cast(right.schema[ties].dataType)).unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_ties").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return filled.drop("_at", "_side", "_value", "_ties")
