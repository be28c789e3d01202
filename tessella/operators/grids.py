"""Grids of beats, loops on them, and what is measured along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import PITCHES
from tessella.functions.signal import EPS, pearson

#: Key profiles from C, by mode (Krumhansl).
PROFILES = {
    "maj": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    "min": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
}


def one_shots(onsets: DataFrame, *, by: Sequence[str], at: str, ties: str, longest, least) -> DataFrame:
    """[start, end) from each onset to the next, ``longest`` at most and at least ``least`` long."""
    following = F.lead(at).over(Window.partitionBy(*by).orderBy(at, ties))
    end = F.least(F.coalesce(following, F.col(at) + longest), F.col(at) + longest)
    return onsets.withColumns({"start": F.col(at), "end": end}).where(F.col("end") - F.col("start") >= least)


def grid_loops(grid: DataFrame, *, start: str, lengths: dict, limit: str, bars: str = "bars") -> DataFrame:
    """A loop of each length from each place of the grid that ends by ``limit``; ``lengths``, numbers or columns, is by bars."""
    every = F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(n).cast("long").alias("n")) for b, n in lengths.items()])
    loops = grid.withColumn("_loop", F.explode(every))
    loops = loops.withColumns({"end": F.col(start) + F.col("_loop.n"), bars: F.col("_loop.b")})
    return loops.where(F.col("end") <= F.col(limit)).drop("_loop")


def prefix_energy(df: DataFrame, *, by: Sequence[str], order: str, energy: str, block: str | None = None) -> DataFrame:
    """Add the energy of all rows ``before`` and ``until`` a row, so any window's is a difference.

    With ``block``, a column that never falls along the order, sums run within
    blocks, and those of the blocks before are added.
    """
    w = Window.partitionBy(*by, *([block] if block else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumn("until", F.sum(energy).over(w))
    if block:
        sizes = df.groupBy(*by, block).agg(F.sum(energy).alias("_e"))
        before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        bases = sizes.select(*by, block, F.coalesce(F.sum("_e").over(before), F.lit(0.0)).alias("_base"))
        sums = sums.join(bases, [*by, block]).withColumn("until", F.col("_base") + F.col("until")).drop("_base")
    return sums.withColumn("before", F.col("until") - F.col(energy))


def bar_phase(beats: DataFrame, *, by: Sequence[str], beat: str, cues: Sequence[str], bar: int = 4) -> DataFrame:
    """The phase of the bar where the cues' z-scores are highest on average; the first of equals."""
    w = Window.partitionBy(*by)
    score = sum(((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + EPS) for c in cues), F.lit(0.0))
    phases = beats.withColumn("_score", score).groupBy(*by, F.pmod(F.col(beat), F.lit(bar)).alias("phase")).agg(F.avg("_score").alias("strength"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("strength"), "phase"))
    return phases.withColumn("_n", best).where("_n = 1").drop("_n")


def full_fold(fold: DataFrame, by: Sequence[str], pitch_class: str, energy: str) -> DataFrame:
    """All twelve pitch classes of each group, absent ones with 0."""
    every = fold.select(*by).distinct().withColumn(pitch_class, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return every.join(fold, [*by, pitch_class], "left").withColumn(energy, F.coalesce(energy, F.lit(0.0)))


def detect_key(fold: DataFrame, *, by: Sequence[str], pitch_class: str, energy: str) -> DataFrame:
    """tonic, mode, score (Pearson) and confidence of the best of the 24 key templates.

    Templates are an array literal, so each of the 12 rows of a group grows to
    24 and one aggregation correlates them; no template table is joined.
    """
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*map(F.lit, w)).alias("w")) for m, w in PROFILES.items()])
    rows = full_fold(fold, by, pitch_class, energy)
    rows = rows.withColumn("tonic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("_m", F.explode(modes))
    place = (F.pmod(F.col(pitch_class) - F.col("tonic"), F.lit(12)) + 1).cast("int")
    rows = rows.withColumn("_w", F.element_at(F.col("_m.w"), place))
    scored = rows.groupBy(*by, "tonic", F.col("_m.mode").alias("mode")).agg(pearson(energy, "_w").alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("tonic"), F.desc("mode"))
    scored = scored.withColumns({"_n": F.row_number().over(w), "_second": F.lead("score").over(w)}).where("_n = 1")
    sure = F.least(F.lit(1.0), F.greatest(F.col("score") - F.col("_second"), F.lit(0.0)) + 0.5 * F.greatest(F.col("score"), F.lit(0.0)))
    return scored.select(*by, "tonic", "mode", F.round("score", 4).alias("score"), F.round(sure, 3).alias("confidence"))


def name_chord(fold: DataFrame, *, by: Sequence[str], pitch_class: str, energy: str) -> DataFrame:
    """The triad whose template is nearest in cosine: chord and score; the first of equals."""
    kinds = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(q).alias("q"), F.array(F.lit(r), F.lit((r + t) % 12), F.lit((r + 7) % 12)).alias("tones"), F.lit(PITCHES[r] + q).alias("chord")) for r in range(12) for q, t in (("maj", 4), ("min", 3))])
    rows = fold.withColumn("_t", F.explode(kinds))
    inside = F.when(F.array_contains("_t.tones", F.col(pitch_class).cast("int")), F.col(energy)).otherwise(F.lit(0.0))
    length = F.sqrt(F.sum(F.col(energy) * F.col(energy))) * F.sqrt(F.lit(3.0))
    scored = rows.groupBy(*by, "_t.root", "_t.q", "_t.chord").agg(F.try_divide(F.sum(inside), length).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "root", "q")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*by, "chord", "score")


def overlapping_chunks(df: DataFrame, *, index: str, size: int, stride: int) -> DataFrame:
    """Repeat each row for every chunk it is in: adds ``chunk`` and ``at``, its place there."""
    last = F.floor(F.col(index) / stride).cast("long")
    back = -(-size // stride) - 1
    df = df.withColumn("chunk", F.explode(F.sequence(F.greatest(last - back, F.lit(0).cast("long")), last)))
    return df.withColumn("at", F.col(index) - F.col("chunk") * stride).where(F.col("at") < size).withColumn("_size", F.lit(size))


def overlap_add(chunks: DataFrame, *, by: Sequence[str], index: str, value: str) -> DataFrame:
    """Put chunks together by triangular weights, divided by the weights' sum."""
    weight = F.least(F.col("at") + 1, F.col("_size") - F.col("at")) / (F.col("_size") / 2)
    return chunks.withColumn("_w", weight).groupBy(*by, index).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))
