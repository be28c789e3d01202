"""Stable ranks and the round-robin deal.

Every order ends with a column ``ord`` (or what ``ties`` names), since a
DataFrame has no order of its own to fall back on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_rank(df: DataFrame, name: str, by: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Add ``name``, 1, 2, ... within ``by`` in ``order``, which must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def block_rank(df: DataFrame, name: str, *, by: Sequence[str], block: Column | str, order: Sequence[str | Column]) -> DataFrame:
    """``stable_rank`` of large groups: rows rank within blocks, and the counts of the blocks before are added.

    ``block`` never falls along the order (a day of a timestamp, say), so no
    task sorts more than a block of a group.
    """
    by = list(by)
    df = df.withColumn("_block", F.col(block) if isinstance(block, str) else block)
    sizes = df.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    for c in by:
        bases = bases.withColumnRenamed(c, f"_by_{c}")
    within = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_block").eqNullSafe(F.col("_b"))]
    ranked = df.withColumn("_within", within).join(bases, same)
    return ranked.withColumn(name, (F.col("_base") + F.col("_within")).cast("long")).drop("_block", "_b", "_base", "_within", *[f"_by_{c}" for c in by])


def with_halo(df: DataFrame, *, index: str, size: int, halo: int) -> DataFrame:
    """Add ``chunk``, ``size`` places of ``index`` each, and ``own``; rows up to ``halo`` places outside a chunk are repeated in it.

    Windows over (group, chunk) then see all neighbours of the rows that a chunk owns.
    """
    first, last = (F.floor((F.col(index) + k) / size).cast("long") for k in (-halo, halo))
    spread = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("own", F.col("chunk") == F.floor(F.col(index) / size))


def keep_top(df: DataFrame, n: int | Column, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first n of each group."""
    return stable_rank(df, "_rank", by, order).where(F.col("_rank") <= n).drop("_rank")


def above_floor(df: DataFrame, share: float, by: Sequence[str], score: str = "score") -> DataFrame:
    """Rows of at least ``share`` of their group's best score, which is aggregated before it meets them: no task gets a group's rows."""
    best = df.groupBy(*by).agg(F.max(score).alias("_best"))
    return df.join(best, list(by)).where(F.col(score) >= share * F.col("_best")).drop("_best")


def deal_ranks(
    df: DataFrame, *, group: Sequence[str], queue: str, queue_order: str | Column, score: str, ties: str, count: int | Column, among: Column | None = None
) -> DataFrame:
    """Add ``deal_rank``: where a row comes if in each group one row of each queue is dealt in turn, best first.

    A cycle takes the best not yet dealt of every queue that has one, so the deal
    is the order by (rank in the queue, queue). Rows that can't be among the first
    ``count``, or aren't ``among`` those that are dealt, have none; without
    ``among`` they go.
    """
    keys = list(group) if among is None else [*group, "_among"]
    rows = df if among is None else df.withColumn("_among", among)
    ranked = stable_rank(rows, "_cycle", [*keys, queue], [F.desc(score), ties])
    ranked = ranked.where(F.col("_cycle") <= count) if among is None else ranked
    ranked = stable_rank(ranked, "deal_rank", keys, ["_cycle", queue_order, F.desc(score), ties])
    if among is not None:
        ranked = ranked.withColumn("deal_rank", F.when(F.col("_among") & (F.col("deal_rank") <= count), F.col("deal_rank"))).drop("_among")
    return ranked.drop("_cycle")


def deal(
    df: DataFrame, *, group: Sequence[str], queue: str, queue_order: str | Column, score: str, ties: str, count: int | Column
) -> DataFrame:
    """The first ``count`` rows of each group by ``deal_ranks``."""
    return deal_ranks(df, group=group, queue=queue, queue_order=queue_order, score=score, ties=ties, count=count).where(F.col("deal_rank") <= count)


def pair_in_order(
    empty: DataFrame, rest: DataFrame, empty_order: Sequence, rest_order: Sequence, by: Sequence[str] = (), blocks: tuple | None = None
) -> DataFrame:
    """The k-th of ``empty`` gets the k-th of ``rest``, within ``by``; what has no partner goes.

    ``blocks``, a column for each side that never falls along its order, ranks
    large groups, or everything where ``by`` is empty, block by block.
    """
    by = list(by)
    a = block_rank(empty, "_k", by=by, block=blocks[0], order=empty_order) if blocks else stable_rank(empty, "_k", by, empty_order)
    b = block_rank(rest, "_k", by=by, block=blocks[1], order=rest_order) if blocks else stable_rank(rest, "_k", by, rest_order)
    return a.join(b, [*by, "_k"]).drop("_k")
