"""Tempo, beats, bars, key and sections of songs, from frame features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dsp, labels
from tessella.operators import frames as fr
from tessella.operators import grids, intervals, ranking


@dataclass
class Analysis:
    """songs: song_id, duration_s, bpm, key, key_short, key_confidence, time_signature; the others by song_id and idx."""

    songs: DataFrame
    beats: DataFrame
    downbeats: DataFrame
    sections: DataFrame


#: Frames whose windows are correlated in one task.
TEMPO_CHUNK = 4096


def _correlated(key, chunk: pd.DataFrame) -> pd.DataFrame:
    """The sums of a chunk's windows by lag; at the song's ends the strengths fall to zero over half a window."""
    chunk = chunk.sort_values("frame")
    facts, own = chunk.iloc[0], chunk.loc[chunk["own"], "frame"]
    size, n = dsp.tempo_window(int(facts["rate"])), int(facts["n"])
    half = size // 2
    places = np.arange(own.min() - half, own.max() + half + 1)
    strengths = np.zeros(len(places))
    strengths[chunk["frame"].to_numpy() - places[0]] = chunk["onset"].to_numpy()
    strengths = np.where(places < 0, facts["first"] * (places + half) / half, np.where(places >= n, facts["last"] * (half - 1 - (places - n)) / half, strengths))
    return pd.DataFrame({"song_id": [facts["song_id"]], "rate": [facts["rate"]], "n": [n], "sums": [dsp.correlations(strengths[: len(own) + size - 1], size)]})


def tempos(onsets: DataFrame, start: float = 120.0) -> DataFrame:
    """song_id, bpm of (song_id, frame, onset, rate): mean autocorrelation over windows of 8 s around each frame, with a log-normal prior.

    Sums by chunk and lag first, over any number of tasks a song, then by song.
    """
    ends = onsets.groupBy("song_id").agg(F.count("*").alias("n"), F.min_by("onset", "frame").alias("first"), F.max_by("onset", "frame").alias("last"))
    half = F.floor(F.floor(8 * F.col("rate") / dsp.HOP) / 2)
    spread = ranking.with_halo(onsets, index="frame", size=TEMPO_CHUNK, halo=half).where("chunk >= 0").join(ends, "song_id")
    spread = spread.where(F.col("chunk") * TEMPO_CHUNK < F.col("n")).select("song_id", "rate", "n", "first", "last", "chunk", "own", "frame", "onset")
    parts = spread.groupBy("song_id", "chunk").applyInPandas(_correlated, "song_id string, rate int, n long, sums array<double>")
    sums = parts.select("song_id", "rate", "n", F.posexplode("sums").alias("lag", "s")).groupBy("song_id", "rate", "n", "lag").agg(F.sum("s").alias("s"))
    sums = sums.where("lag > 0").withColumn("bpm", 60 * F.col("rate") / (dsp.HOP * F.col("lag"))).where("bpm < 320")
    prior = F.pow(F.log2("bpm") - F.log2(F.lit(start)), F.lit(2.0))
    score = F.log1p(1e6 * F.greatest(F.col("s") / F.col("n"), F.lit(0.0))) - 0.5 * prior
    return sums.groupBy("song_id").agg(F.min_by("bpm", F.struct(-score, "lag")).alias("bpm"))


def _track(group: pd.DataFrame) -> pd.DataFrame:
    """Beat times of one song, from its onset strengths in order."""
    group = group.sort_values("frame")
    rate, bpm = int(group["rate"].iloc[0]), float(group["bpm"].iloc[0])
    beats = dsp.beat_frames(group["onset"].to_numpy(), rate, bpm) * dsp.HOP / rate
    return pd.DataFrame({"song_id": group["song_id"].iloc[0], "bpm": bpm, "t_s": beats})


def track_beats(frames: DataFrame, songs: DataFrame, low: float = 70, high: float = 180) -> DataFrame:
    """song_id, idx, t_s, bpm: beats folded into the tempo range, and the tempo of their grid.

    The chain of beats depends on its order, so one song is one task; what
    follows is windows over all songs. Songs without two beats get 120 a minute.
    """
    rate = songs.select("song_id", "rate")
    raw = frames.select("song_id", "frame", "onset").join(rate, "song_id")
    raw = raw.join(tempos(raw), "song_id").groupBy("song_id").applyInPandas(_track, "song_id string, bpm double, t_s double")
    found = folded(raw, low, high)
    return found.unionByName(fallback_beats(songs.join(found.select("song_id").distinct(), "song_id", "left_anti").where("duration_s > 0")))


def folded(raw: DataFrame, low: float, high: float) -> DataFrame:
    """song_id, idx, t_s, bpm of the beats (song_id, t_s, bpm) of songs that have two: midpoints in between while the tempo is below
    ``low``, every other beat while it is above ``high``; the tempo is that of a line through the beats, or the folded one of four or fewer."""
    counted = raw.withColumn("_n", F.count("*").over(Window.partitionBy("song_id"))).where("_n >= 2")
    up = F.greatest(F.ceil(F.log2(F.lit(float(low)) / F.col("bpm"))), F.lit(0)).cast("int")
    down = F.greatest(F.ceil(F.log2(F.col("bpm") * F.pow(F.lit(2.0), F.col("up")) / F.lit(float(high)))), F.lit(0)).cast("int")
    counted = counted.withColumn("up", up).withColumn("down", down)
    w = Window.partitionBy("song_id").orderBy("t_s")
    parts = F.pow(F.lit(2.0), F.col("up"))
    after = F.lead("t_s").over(w)
    counted = counted.withColumn("_after", after).withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(F.col("_after").isNull(), 0).otherwise((parts - 1).cast("int")))))
    split = counted.withColumn("t_s", F.when(F.col("_j") == 0, F.col("t_s")).otherwise(F.col("t_s") + (F.col("_after") - F.col("t_s")) * F.col("_j") / parts))
    split = split.withColumn("_i", F.row_number().over(w) - 1).where(F.pmod(F.col("_i").cast("double"), F.pow(F.lit(2.0), F.col("down"))) == 0)
    split = split.withColumn("idx", F.row_number().over(w) - 1)
    tempo = split.groupBy("song_id").agg(
        F.count("*").alias("n"), F.regr_slope("t_s", F.col("idx").cast("double")).alias("period"), F.first(F.col("bpm") * parts / F.pow(F.lit(2.0), F.col("down"))).alias("folded")
    )
    tempo = tempo.select("song_id", F.when((F.col("n") > 4) & (F.col("period") > 0), 60 / F.col("period")).otherwise(F.col("folded")).alias("bpm"))
    return split.select("song_id", "idx", "t_s").join(tempo, "song_id")


def fallback_beats(songs: DataFrame) -> DataFrame:
    """song_id, idx, t_s, bpm: 120 beats a minute to the end of each song."""
    last = F.greatest(F.ceil(F.col("duration_s") / 0.5).cast("int") - 1, F.lit(0))
    beats = songs.select("song_id", F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    return beats.select("song_id", "idx", (F.col("idx") * 0.5).alias("t_s"), F.lit(120.0).alias("bpm"))


def long_sections(found: DataFrame, least_s: float = 0.5) -> DataFrame:
    """Sections longer than ``least_s``, their times rounded."""
    found = found.withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})
    return found.where(F.col("end_s") - F.col("start_s") > least_s)


def beat_means(frames: DataFrame, beats: DataFrame, arrays: dict[str, int], scalars: list[str] = ()) -> DataFrame:
    """Means of features from one beat to the next; segment 0 lies before the first beat."""
    b = beats.select("song_id", F.col("t_s").alias("beat_s"), (F.col("idx") + 1).alias("segment"))
    told = intervals.as_of(frames, b, keys=["song_id"], at="t_s", right_at="beat_s", value="segment", ties="segment")
    told = told.withColumn("segment", F.coalesce("segment", F.lit(0)))
    means = [F.avg(F.col(c)[i]).alias(f"{c}_{i}") for c, n in arrays.items() for i in range(n)]
    rows = told.groupBy("song_id", "segment").agg(*means, *[F.avg(c).alias(c) for c in scalars])
    packed = [F.array(*[F.col(f"{c}_{i}") for i in range(n)]).alias(c) for c, n in arrays.items()]
    return rows.select("song_id", "segment", *packed, *scalars)


def find_downbeats(frames: DataFrame, beats: DataFrame, synced: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, idx, t_s: the beats of the phase with most low onsets and changes of harmony."""
    from tessella.functions.signal import cosine

    before = F.lag("chroma").over(Window.partitionBy("song_id").orderBy("segment"))
    change = synced.withColumn("change", F.coalesce(1 - cosine("chroma", before), F.lit(0.0))).select("song_id", (F.col("segment") - 1).alias("idx"), "change")
    rated = beats.join(songs.select("song_id", "rate"), "song_id")
    rated = rated.withColumn("frame", F.round(F.col("t_s") * F.col("rate") / dsp.HOP).cast("int"))
    cued = rated.join(frames.select("song_id", "frame", "low_onset"), ["song_id", "frame"], "left").join(change, ["song_id", "idx"], "left")
    cued = cued.fillna(0.0, ["low_onset", "change"])
    phase = grids.bar_phase(cued, by=["song_id"], beat="idx", cues=["low_onset", "change"]).select("song_id", "phase")
    counts = beats.groupBy("song_id").agg(F.count("*").alias("n"))
    kept = beats.join(phase, "song_id").join(counts, "song_id")
    kept = kept.where(F.when(F.col("n") < 8, F.col("idx") == 0).otherwise(F.pmod("idx", F.lit(4)) == F.col("phase")))
    return kept.select("song_id", F.row_number().over(Window.partitionBy("song_id").orderBy("idx")).alias("idx"), "t_s")


def find_key(frames: DataFrame) -> DataFrame:
    """song_id, key, key_short, key_confidence; nulls where there is no tone."""
    means = frames.groupBy("song_id").agg(*[F.avg(F.col("chroma")[i]).alias(f"c{i}") for i in range(12)])
    fold = means.select("song_id", F.posexplode(F.array(*[F.col(f"c{i}") for i in range(12)])).alias("pc", "energy"))
    fold = fold.withColumn("pc", F.col("pc").cast("long"))
    found = grids.detect_key(fold, by=["song_id"], pitch_class="pc", energy="energy")
    name = F.element_at(F.array(*[F.lit(p) for p in labels.PITCHES]), (F.col("tonic") + 1).cast("int"))
    loud = fold.groupBy("song_id").agg((F.max("energy") > 1e-6).alias("_tone"))
    found = found.join(loud, "song_id").where("_tone and score is not null")
    return found.select(
        "song_id", F.concat(name, F.when(F.col("mode") == "maj", " major").otherwise(" minor")).alias("key"),
        F.concat(name, "mode").alias("key_short"), F.col("confidence").alias("key_confidence"),
    )


def _sectioned(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of like segments of one song, lettered by likeness to the first of each letter."""
    group = group.sort_values("segment")
    chroma, mfcc = (np.stack(group[c]).astype(np.float64) for c in ("chroma", "mfcc"))
    chroma /= np.maximum(np.abs(chroma).max(axis=1, keepdims=True), 1e-10)
    mfcc /= np.maximum(np.abs(mfcc).max(axis=0, keepdims=True), 1e-10)
    rows, end = np.hstack((chroma, mfcc)), float(group["duration_s"].iloc[0])
    k = min(int(np.clip(round(end / 20), 2, 10)), len(rows))
    firsts = dsp.contiguous_ward(rows, k)
    leaders: list[np.ndarray] = []
    out = []
    for i, a in enumerate(firsts):
        b = firsts[i + 1] if i + 1 < len(firsts) else len(rows)
        mean = rows[a:b].mean(axis=0)
        like = [float(mean @ x / (np.linalg.norm(mean) * np.linalg.norm(x) + 1e-10)) for x in leaders]
        name = next((j for j, v in enumerate(like) if v > 0.9), len(leaders))
        if name == len(leaders):
            leaders.append(mean)
        start = 0.0 if a == 0 else float(group["start_s"].iloc[a])
        out.append((chr(65 + name), start, end if b == len(rows) else float(group["start_s"].iloc[b])))
    return pd.DataFrame([(group["song_id"].iloc[0], *x) for x in out], columns=["song_id", "label", "start_s", "end_s"])


def find_sections(synced: DataFrame, beats: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, idx, label, start_s, end_s; one section where a song has under 16 beats or 20 s."""
    starts = beats.select("song_id", (F.col("idx") + 1).alias("segment"), F.col("t_s").alias("start_s"))
    counts = beats.groupBy("song_id").agg(F.count("*").alias("n"))
    rows = synced.join(starts, ["song_id", "segment"], "left").join(songs.select("song_id", "duration_s"), "song_id").join(counts, "song_id", "left")
    long = rows.where("n >= 16 and duration_s >= 20").fillna(0.0, ["start_s"])
    found = long.groupBy("song_id").applyInPandas(_sectioned, "song_id string, label string, start_s double, end_s double")
    rest = songs.join(long.select("song_id").distinct(), "song_id", "left_anti")
    found = found.unionByName(rest.select("song_id", F.lit("A").alias("label"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")))
    order = F.row_number().over(Window.partitionBy("song_id").orderBy("start_s"))
    return long_sections(found).select("song_id", order.alias("idx"), "label", "start_s", "end_s")


def song_facts(blocks: DataFrame) -> DataFrame:
    """song_id, rate, duration_s."""
    return blocks.where("block_idx = 0").groupBy("song_id").agg(F.max("rate").alias("rate"), F.max(F.col("total") / F.col("rate")).alias("duration_s"))


def analyse(mix_frames: DataFrame, songs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], low: float = 70, high: float = 180) -> Analysis:
    """All facts of each song from the frames of its mix; ``songs`` is ``song_facts``, ``keep`` stores a stage."""
    songs = keep(songs, "song_facts")
    framed = keep(fr.onset_strength(fr.onset_strength(mix_frames), "low", "low_onset").drop("mel", "low"), "onsets")
    beats = keep(track_beats(framed, songs, low, high), "beats")
    cepstra = fr.cepstra(mix_frames).select("song_id", "frame", F.slice("mfcc", 1, 13).alias("mfcc"))
    both = framed.select("song_id", "frame", "t_s", "chroma").join(cepstra, ["song_id", "frame"])
    synced = keep(beat_means(both, beats, {"chroma": 12, "mfcc": 13}), "beat_means")
    tempo = beats.groupBy("song_id").agg(F.round(F.first("bpm"), 2).alias("bpm"))
    facts = songs.join(tempo, "song_id", "left").join(find_key(framed), "song_id", "left").select(
        "song_id", "rate", F.round("duration_s", 3).alias("duration_s"), "bpm", "key", "key_short",
        F.coalesce("key_confidence", F.lit(0.0)).alias("key_confidence"), F.lit("4/4").alias("time_signature"),
    )
    told = beats.select("song_id", "idx", F.round("t_s", 4).alias("t_s"))
    down = find_downbeats(framed, beats, synced, songs).withColumn("t_s", F.round("t_s", 4))
    return Analysis(keep(facts, "analysis"), told, keep(down, "downbeats"), keep(find_sections(synced, beats, songs), "sections"))
