"""Gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, *, by: Sequence[str], order: Sequence[str | Column], new: Column, name: str = "island") -> DataFrame:
    """Number the runs of each group; ``new`` says whether a row begins one (it may use lag over the order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum("_new").over(running)).drop("_new")


def gap_islands(df: DataFrame, *, by: Sequence[str], at: str, ties: str, most: float, name: str = "island") -> DataFrame:
    """Runs whose neighbours are at most ``most`` apart."""
    w = Window.partitionBy(*by).orderBy(at, ties)
    return islands(df, by=by, order=[at, ties], new=F.col(at) - F.lag(at).over(w) > most, name=name)


def active_runs(frames: DataFrame, *, by: Sequence[str], frame: str, active: Column) -> DataFrame:
    """[first, last] of each run of consecutive frames that are active."""
    w = Window.partitionBy(*by).orderBy(frame)
    loud = frames.where(active).withColumn("_run", F.col(frame) - F.row_number().over(w))
    return loud.groupBy(*by, "_run").agg(F.min(frame).alias("first"), F.max(frame).alias("last")).drop("_run")


def cut_long(df: DataFrame, *, start: str, end: str, most: int | Column, least: int | Column) -> DataFrame:
    """Cut [start, end) in steps of ``most``; pieces shorter than ``least`` go."""
    most = F.lit(most) if isinstance(most, int) else most
    steps = F.sequence(F.col(start), F.greatest(F.col(end) - 1, F.col(start)), most)
    cut = df.withColumn("_s", F.explode(steps))
    cut = cut.withColumns({start: F.col("_s"), end: F.least(F.col(end), F.col("_s") + most)}).drop("_s")
    return cut.where(F.col(end) - F.col(start) >= least)
