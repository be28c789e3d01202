"""Rendering slices, finding their notes, splitting songs, and writing files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import dsp, labels, pitch, signal
from tessella.operators import frames as fr
from tessella.operators import grids
from tessella.plans.candidates import mono_blocks
from tessella.sources import files, wav


def render_slice(x: np.ndarray, rate: int, start: int, end: int, render: dict, window_ms: float) -> np.ndarray:
    """Snap to zero crossings (loops keep their length), reverse, fade, normalise: in that order."""
    mono, reach = x.mean(axis=0), int(rate * window_ms / 1000)
    first = dsp.nearest_crossing(mono, start, reach)
    last = first + end - start if render["playback"] == "loop" else dsp.nearest_crossing(mono, end, reach)
    s = x[:, first : min(max(last, first), x.shape[1])].astype(np.float64)
    if render["reverse"]:
        s = s[:, ::-1]
    s = dsp.faded(s, *(int(rate * render[k] / 1000) for k in ("fade_in_ms", "fade_out_ms")))
    return s if render["normalize_dbfs"] is None else dsp.peak_normalised(s, render["normalize_dbfs"])


def _rendered(window_ms: float, bits: int):
    def run(key, slices: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if slices.empty or blocks.empty:
            return pd.DataFrame(columns=["song_id", "id", "file", "content"])
        (base, left), (_, right) = (fr.put_together(blocks, c, np.float32) for c in ("left", "right"))
        rate, x, rows = int(blocks["rate"].iloc[0]), np.stack((left, right)), []
        for s in slices.itertuples(index=False):
            settings = {"playback": s.playback, "reverse": s.reverse, "fade_in_ms": s.fade_in_ms, "fade_out_ms": s.fade_out_ms, "normalize_dbfs": None if pd.isna(s.normalize_dbfs) else s.normalize_dbfs}
            rows.append((s.song_id, s.id, s.file, wav.encode(render_slice(x, rate, s.start - base, s.end - base, settings, window_ms), rate, bits)))
        return pd.DataFrame(rows, columns=["song_id", "id", "file", "content"])

    return run


def render(slices: DataFrame, blocks: DataFrame, cfg: dict) -> DataFrame:
    """song_id, id, file, content (a WAV file) of every slice."""
    flat = slices.select("song_id", "stem", "id", "file", "start", "end", "render.*")
    made = _rendered(cfg["render"]["zero_crossing_window_ms"], cfg["ingest"]["bit_depth"])
    return fr.with_audio(flat, blocks, made, "song_id string, id string, file string, content binary")


#: By kind of stem, the lowest and highest pitch in Hz and the seconds of a frame.
VOICES = {True: (30.0, 400.0, 4096 / 22050), False: (80.0, 1000.0, 2048 / 22050)}


def _tones(key, slices: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Pitch in Hz of bass notes and chops, all of a stem decoded in step; mean chroma of stabs."""
    if slices.empty or blocks.empty:
        return pd.DataFrame(columns=["song_id", "id", "hz", "chroma"])
    base, x = fr.put_together(blocks, "x")
    rate, rows = int(blocks["rate"].iloc[0]), []
    sung = slices[slices["category"].isin(("bass_note", "vox_chop")) & (slices["end"] - slices["start"] > 0.05 * rate)]
    for bass, own in sung.groupby(sung["stem"] == "bass"):
        low, high, frame_s = VOICES[bool(bass)]
        found = pitch.pitches([x[a - base : b - base] for a, b in zip(own["start"], own["end"], strict=True)], rate, low, high, frame_s)
        rows += [(song, i, hz, None) for song, i, hz in zip(own["song_id"], own["id"], found, strict=True)]
    for s in slices[slices["category"] == "stab"].itertuples(index=False):
        y = x[s.start - base : s.end - base]
        if len(y) > 2048:
            padded = np.pad(y, 2048)
            power = np.abs(dsp.spectra(padded, np.arange(0, len(y), dsp.HOP), 4096)) ** 2
            tones = power @ dsp.chroma_filters(rate, 4096).T
            peak = tones.max(axis=1, keepdims=True)
            rows.append((s.song_id, s.id, None, (tones / np.where(peak > 0, peak, 1)).mean(axis=0)))
    return pd.DataFrame(rows, columns=["song_id", "id", "hz", "chroma"])


def find_notes(found: DataFrame, kept: DataFrame, blocks: DataFrame) -> DataFrame:
    """song_id, id, note: pitches and chords of the slices that are kept, and of no others."""
    chosen = found.join(kept.select("song_id", F.col("slice_id").alias("id")), ["song_id", "id"], "left_semi").where(F.col("category").isin("bass_note", "vox_chop", "stab"))
    flat = chosen.select("song_id", "stem", "id", "category", "start", "end")
    told = fr.with_audio(flat, mono_blocks(blocks), _tones, "song_id string, id string, hz double, chroma array<double>", margin=0)
    notes = told.where("hz is not null and not isnan(hz)").select("song_id", "id", labels.note_name("hz").alias("note"))
    fold = told.where("chroma is not null").select("song_id", "id", F.posexplode("chroma").alias("pc", "energy")).withColumn("pc", F.col("pc").cast("long"))
    silent = fold.groupBy("song_id", "id").agg(F.max("energy").alias("top")).where("top < 1e-6")
    chords = grids.name_chord(fold.join(silent, ["song_id", "id"], "left_anti"), by=["song_id", "id"], pitch_class="pc", energy="energy")
    return notes.unionByName(chords.select("song_id", "id", F.col("chord").alias("note")))


def subtract_stem(mix: DataFrame, vocals: DataFrame) -> DataFrame:
    """Blocks of the instrumental: the mix without the vocals, block by block."""
    v = vocals.select("song_id", "block_idx", F.col("left").alias("_l"), F.col("right").alias("_r"))
    rest = mix.join(v, ["song_id", "block_idx"])
    both = {"left": signal.subtract("left", "_l"), "right": signal.subtract("right", "_r"), "stem": F.lit("instrumental")}
    return rest.withColumns(both).drop("_l", "_r").select(*mix.columns)


def split_blocks(blocks: DataFrame, facts: DataFrame, *, rate: int | None = None, normalise: bool = False) -> DataFrame:
    """Blocks of every stem with ``file``, named by song, part and tag; at another rate, and at a peak of -1 dB, if asked for."""
    made = fr.resampled_blocks(blocks, rate) if rate else blocks
    if normalise:
        peak = F.greatest(*[F.array_max(F.transform(c, F.abs)) for c in ("left", "right")])
        peaks = made.groupBy("song_id", "stem").agg(F.coalesce(F.max(peak), F.lit(0.0)).alias("_peak"))
        gain = F.when(F.col("_peak") < 1e-6, 1.0).otherwise(F.lit(10 ** (-1 / 20)) / F.col("_peak"))
        made = made.join(peaks, ["song_id", "stem"]).withColumn("_gain", gain)
        made = made.withColumns({c: F.transform(c, lambda v: (v * F.col("_gain")).cast("float")) for c in ("left", "right")}).drop("_peak", "_gain")
    part = F.when(F.col("stem") == "vocals", "acapella").otherwise(F.col("stem"))
    name = F.concat(labels.sanitised_song("song_id"), F.lit("_"), part, labels.suffix("bpm", "key_short"), F.lit(".wav"))
    return made.join(facts.select("song_id", "bpm", "key_short"), "song_id").withColumn("file", name).drop("bpm", "key_short")


def write_split(blocks: DataFrame, facts: DataFrame, folder: str, *, format: str = "wav", bits: int = 24, rate: int | None = None, normalise: bool = False) -> DataFrame:
    """Write a file for every stem to folder/song_id, block by block; returns path, length, modificationTime of what is there."""
    if format != "wav":
        raise wav.WavError(f"{format} isn't written here, only WAV")
    named = split_blocks(blocks, facts, rate=rate, normalise=normalise)
    wav.write_songs(named.withColumn("file", F.concat("song_id", F.lit("/"), "file")), folder, bits=bits)
    return files.listed(blocks.sparkSession, folder)


def split_documents(
    songs: DataFrame, files: DataFrame, *, rate: int, bits: int | None, format: str = "wav", normalised: bool = False, vocal_model: str | None = None, stems: DataFrame | None = None
) -> DataFrame:
    """song_id, split: one JSON document a song, of (song_id, song, bpm, key) and of (song_id, part, file) of its pair and its stems."""

    def named(df: DataFrame | None, name: str) -> DataFrame:
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "file"))))
        return df.groupBy("song_id").agg(entries.alias(name))

    none = F.create_map().cast("map<string,string>")
    told = songs.join(named(files, "files"), "song_id", "left")
    told = told.join(named(stems, "stems"), "song_id", "left") if stems is not None else told.withColumn("stems", none)
    facts = {"format": format, "sample_rate": rate, "bit_depth": None if format == "mp3" else bits, "normalized": normalised, "vocal_model": vocal_model}
    fields = ["song", "bpm", "key", *[F.lit(v).alias(k) for k, v in facts.items()], F.coalesce("files", none).alias("files"), F.coalesce("stems", none).alias("stems"), F.lit("work.wav").alias("original")]
    return told.select("song_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("split"))


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Write each row's content to folder/song_id/file; returns path, length, modificationTime of what is there.

    For sounds and documents of a moderate size, a row each; whole stems are
    written block by block by ``write_split``.
    """
    rows = made.select(F.concat("song_id", F.lit("/"), "file").alias("file"), F.lit(0).alias("part"), F.octet_length("content").alias("size"), "content")
    files.write_parts(rows, folder)
    return files.listed(made.sparkSession, folder)
