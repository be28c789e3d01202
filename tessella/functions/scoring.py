"""Scores of slices, from features that kernels or aggregations have found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import EPS, as_column, clip

#: Parts of a score and their weights.
WEIGHTS = {"isolation": 0.30, "clarity": 0.20, "loudness": 0.15, "loopability": 0.20, "uniqueness": 0.15}
#: Levels in dBFS between which loudness rises, and the share of clipped samples allowed.
MIN_RMS_DBFS, FULL_RMS_DBFS, MAX_CLIPPED = -50.0, -18.0, 0.001


def loudness(level_db, clipped_share, floor: float = MIN_RMS_DBFS, most_clipped: float = MAX_CLIPPED) -> Column:
    level, clipped = as_column(level_db), as_column(clipped_share)
    good = clip((level - floor) / (FULL_RMS_DBFS - floor))
    return F.when((level < floor) | (clipped > most_clipped), F.lit(0.0)).otherwise(good)


def one_shot_clarity(attack_peak, mean_level, tail_mean, peak) -> Column:
    rise = clip((as_column(attack_peak) / (as_column(mean_level) + EPS) - 1.0) / 2.0)
    return 0.5 * rise + 0.5 * clip(1.0 - 2.0 * as_column(tail_mean) / (as_column(peak) + EPS))


def loop_clarity(beat_mean, beat_deviation) -> Column:
    """1 less the variation of the beats' mean levels."""
    return clip(1.0 - as_column(beat_deviation) / (as_column(beat_mean) + EPS))


def seam(head_rms, tail_rms, timbre_cosine) -> Column:
    """How well a loop's end runs into its start."""
    level = F.exp(-F.abs(F.log((as_column(tail_rms) + EPS) / (as_column(head_rms) + EPS))))
    return clip(0.5 * level + 0.5 * F.greatest(as_column(timbre_cosine), F.lit(0.0)))


def isolation(own_energy, all_energy) -> Column:
    return F.when(as_column(all_energy) > EPS, as_column(own_energy) / as_column(all_energy)).otherwise(F.lit(0.0))


def weighted(parts: dict[str, Column | str], weights: dict[str, float]) -> Column:
    """Weighted mean of the parts that aren't null; 0 if loudness is exactly 0 or nothing has weight."""
    used = {k: as_column(parts[k]) for k in parts if weights.get(k, 0) > 0}
    top, below = F.lit(0.0), F.lit(0.0)
    for k, value in used.items():
        top = top + F.coalesce(value * weights[k], F.lit(0.0))
        below = below + F.when(value.isNotNull(), F.lit(weights[k])).otherwise(F.lit(0.0))
    score = F.when(below == 0, F.lit(0.0)).otherwise(top / below)
    if "loudness" in parts:
        score = F.when(as_column(parts["loudness"]) == 0.0, F.lit(0.0)).otherwise(score)
    return score


def final_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Round the five parts, and add the score of the rounded ones."""
    rows = rows.withColumns({p: F.round(p, 4) for p in WEIGHTS})
    return rows.withColumn("score", F.round(weighted({p: p for p in WEIGHTS}, weights), 4))


def drum_category(n_samples, low_share, high_share, centroid_hz, flatness) -> Column:
    """kick, snare, hat or perc from band features of a hit's beginning."""
    n, low, high, centre, flat = map(as_column, (n_samples, low_share, high_share, centroid_hz, flatness))
    return (
        F.when(n < 64, "perc")
        .when((low > 0.45) & (centre < 1000), "kick")
        .when((high > 0.5) | (centre > 6000), "hat")
        .when((flat > 0.15) & (centre > 800), "snare")
        .otherwise("perc")
    )
