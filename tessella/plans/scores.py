"""Scores of candidates: isolation, clarity, loudness, loopability, uniqueness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scoring, signal
from tessella.operators import clusters
from tessella.operators import frames as fr
from tessella.plans.candidates import mono_blocks


def _energies(key, windows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Energy of windows in one stem, as differences of a running sum over the blocks that they reach."""
    energy = np.zeros(len(windows))
    if len(blocks):
        base, x = fr.put_together(blocks, "x")
        until = np.concatenate(([0.0], np.cumsum(x**2)))
        a, b = (np.clip(windows[c].to_numpy(np.int64) - base, 0, len(x)) for c in ("start", "end"))
        energy = until[np.maximum(a, b)] - until[a]
    return pd.DataFrame({"song_id": windows["song_id"], "id": windows["id"], "own": windows["own"] == key[1], "energy": energy})


def isolation(found: DataFrame, blocks: DataFrame, size: int = fr.BLOCK) -> DataFrame:
    """song_id, id, isolation: a window's energy in its own stem against that in all stems."""
    stems = blocks.where("block_idx = 0").select("song_id", "stem")
    windows = found.select("song_id", "id", F.col("stem").alias("own"), "start", "end").join(stems, "song_id")
    told = fr.with_audio(windows, mono_blocks(blocks), _energies, "song_id string, id string, own boolean, energy double", margin=0, size=size)
    mine = F.sum(F.when(F.col("own"), F.col("energy")).otherwise(0.0))
    return told.groupBy("song_id", "id").agg(scoring.isolation(mine, F.sum("energy")).alias("isolation"))


def score(found: DataFrame, blocks: DataFrame, cfg: dict) -> DataFrame:
    """Add the five parts, score, cluster and representative to every candidate."""
    s = cfg["scoring"]
    clarity = (
        F.when(F.col("kind") == "one_shot", scoring.one_shot_clarity("attack_peak", "env_mean", "tail_mean", "env_peak"))
        .when(F.col("kind") == "loop", scoring.loop_clarity("beat_mean", "beat_dev"))
        .otherwise(F.col("active"))
    )
    loop = F.when(F.col("kind") == "loop", F.when(F.col("edge") < 256, F.lit(0.0)).otherwise(scoring.seam("head_rms", "tail_rms", "seam_cos")))
    rows = found.join(isolation(found, blocks), ["song_id", "id"]).withColumns(
        {"clarity": clarity, "loudness": scoring.loudness(signal.decibels("level"), "clipped", s["min_rms_dbfs"], s["max_clipped_fraction"]), "loopability": loop}
    )
    before = {k: v for k, v in s["weights"].items() if k != "uniqueness"}
    rows = rows.withColumn("prelim", scoring.weighted({k: k for k in before}, before))
    keep = ["song_id", "id", "stem", "kind", "category", "start", "end", "bars", "beats", "ord", "rate", "isolation", "clarity", "loudness", "loopability", "prelim", "timbre"]
    rows = clusters.leaders(rows.select(*keep), group=["song_id", "stem", "category"], vector="timbre", score="prelim", ties="ord", threshold=s["duplicate_similarity"])
    rows = clusters.numbered(rows, group=["stem", "category"], by=["song_id"], ties="ord")
    rows = rows.withColumn("uniqueness", F.when(F.col("representative"), 1.0).otherwise(signal.clip(1.0 - F.col("similarity"))))
    return scoring.final_score(rows, s["weights"]).drop("prelim", "leader", "similarity")
