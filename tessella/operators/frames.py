"""Frames over sample blocks: each block is framed in its own task, with its neighbours' edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import constant_q, dsp, signal

FEATURES = "song_id string, stem string, frame int, t_s double, rms double, mel array<float>, low array<float>, chroma array<float>"
HALO = 2048
#: Samples of a block.
BLOCK = 1 << 17


def with_audio(windows: DataFrame, blocks: DataFrame, run, schema: str, *, margin: int = HALO, size: int = BLOCK) -> DataFrame:
    """``run(key, windows, blocks)`` on windows and the blocks that they, and ``margin`` samples on both sides, touch.

    Windows of a stem that begin in one block share a task, which holds the few
    blocks that the longest of them reaches, however long the stem is.
    """
    by = ["song_id", "stem"]
    first = F.floor(F.greatest(F.col("start") - margin, F.lit(0)) / size).cast("int")
    last = F.floor((F.greatest("start", "end") + margin) / size).cast("int")
    w = windows.withColumns({"first_block": first, "_last": last})
    reach = w.groupBy(*by, "first_block").agg(F.max("_last").alias("_last"))
    # The blocks' side has names of its own, as the windows may come from the same blocks.
    wanted = reach.select(F.col("song_id").alias("_song"), F.col("stem").alias("_stem"), F.col("first_block").alias("_first"), F.explode(F.sequence("first_block", "_last")).alias("_block"))
    own = blocks.toDF(*[f"b_{c}" for c in blocks.columns])
    same = (F.col("_song") == F.col("b_song_id")) & (F.col("_stem") == F.col("b_stem")) & (F.col("_block") == F.col("b_block_idx"))
    audio = wanted.join(own, same).drop("_block").groupBy("_song", "_stem", "_first")

    def renamed(key, windows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return run(key, windows, blocks.rename(columns={c: c.removeprefix("b_") for c in blocks.columns}))

    return w.drop("_last").groupBy(*by, "first_block").cogroup(audio).applyInPandas(renamed, schema)


def _converted(to_rate: int):
    def run(key, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("at")
        facts, k = parts.iloc[0], int(key[2])
        total = dsp.resampled_length(int(facts["total"]), int(facts["rate"]), to_rate)
        first, last = k * BLOCK, min((k + 1) * BLOCK, total)
        x = np.stack([np.concatenate([np.asarray(v, np.float32) for v in parts[c]]) for c in ("left", "right")])
        left, right = dsp.resampled_part(x, int(facts["at"]), first, last, int(facts["rate"]), to_rate)
        return pd.DataFrame({"song_id": key[0], "stem": key[1], "block_idx": k, "start_sample": first, "n": last - first, "total": total, "rate": to_rate, "left": [left], "right": [right]})

    return run


def resampled_blocks(blocks: DataFrame, to_rate: int) -> DataFrame:
    """Blocks at another rate: those of each stem's conversion at once, each made in a task from the samples that it needs.

    A block goes, cut to what is needed, to the blocks of the new rate that it reaches.
    """
    kinds = blocks.select("song_id", "stem", "block_idx", "start_sample", "n", "total", "rate", "left", "right")
    own, to = F.col("rate").cast("long"), F.lit(to_rate).cast("long")
    half = F.ceil(24 / (0.97 * F.least(F.lit(1.0), to / own))).cast("long")
    rows = kinds.where(F.col("rate") != to_rate).withColumns({"_half": half, "_total": F.rint(F.col("total") * to / own).cast("long")})
    most = F.greatest(F.ceil(F.col("_total") / BLOCK) - 1, F.lit(0))
    first = F.floor(F.greatest(F.col("start_sample") - F.col("_half") - 1, F.lit(0)) * to / own / BLOCK)
    last = F.floor((F.col("start_sample") + F.col("n") + F.col("_half")) * to / own / BLOCK)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.least(first, most), F.least(last, most))))
    end = F.least((F.col("_k") + 1) * BLOCK, F.col("_total"))
    low = F.greatest(F.floor(F.col("_k") * BLOCK * own / to) - F.col("_half") - 1, F.col("start_sample"))
    high = F.least(F.floor(end * own / to) + F.col("_half") + 2, F.col("start_sample") + F.col("n"))
    rows = rows.withColumns({"at": low, "_high": high}).where("_high > at or total = 0")
    cut = {c: F.slice(c, (F.col("at") - F.col("start_sample") + 1).cast("int"), F.greatest(F.col("_high") - F.col("at"), F.lit(0)).cast("int")) for c in ("left", "right")}
    made = rows.withColumns(cut).select("song_id", "stem", "_k", "at", "total", "rate", "left", "right").groupBy("song_id", "stem", "_k")
    made = made.applyInPandas(_converted(to_rate), kinds.schema)
    return kinds.where(F.col("rate") == to_rate).unionByName(made)


def put_together(blocks: pd.DataFrame, column: str, kind=np.float64) -> tuple[int, np.ndarray]:
    """The place of the first sample, and the samples, of blocks in a row."""
    blocks = blocks.sort_values("block_idx")
    return int(blocks["start_sample"].iloc[0]), np.concatenate([np.asarray(v, kind) for v in blocks[column]])


def with_edges(blocks: DataFrame, halo: int | Column = HALO) -> DataFrame:
    """Mono samples of each block with the last of the block before and the first of the one behind."""
    mono = blocks.select("song_id", "stem", "block_idx", "start_sample", "n", "total", "rate", signal.to_mono("left", "right").alias("x"))
    w = Window.partitionBy("song_id", "stem").orderBy("block_idx")
    halo = F.lit(halo)
    tail = F.slice("x", F.greatest(F.col("n") - halo + 1, F.lit(1)), halo)
    head = F.slice("x", F.lit(1), halo)
    return mono.withColumns({"before": F.lag(tail).over(w), "after": F.lead(head).over(w)})


def _edge(rate: int, constant: bool) -> int:
    """Samples around a block that its frames need, and a few more."""
    return max(HALO, constant_q.reach(rate)) if constant else HALO


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.astype(np.float32).reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))


def _features(constant: bool):
    def run(batches):
        for batch in batches:
            columns = {c: batch[c].to_pylist() for c in ("song_id", "stem", "start_sample", "n", "total", "rate")}
            for i in range(len(batch)):
                song, stem, start, n, total, rate = (columns[c][i] for c in columns)
                own, before, after = (np.asarray(batch[c][i].values if batch[c][i].is_valid else [], np.float64) for c in ("x", "before", "after"))
                edge = _edge(rate, constant)
                before, after = before[max(0, len(before) - edge) :], after[:edge]
                x = np.zeros(edge + n + edge + 2)
                x[edge - len(before) : edge] = before
                x[edge : edge + n] = own
                x[edge + n : edge + n + len(after)] = after
                last = total // dsp.HOP + 1 if start + n >= total else -(-(start + n) // dsp.HOP)
                frames = np.arange(-(-start // dsp.HOP), last)
                if not len(frames):
                    continue
                centre = frames * dsp.HOP - start + edge
                power = np.abs(dsp.spectra(x, centre - 1024, 2048)) ** 2
                if constant:
                    tones = constant_q.chroma(x, start - edge, frames, rate)
                else:
                    tones = np.abs(dsp.spectra(x, centre - 2048, 4096)) ** 2 @ dsp.chroma_filters(rate, 4096).T
                    peak = tones.max(axis=1, keepdims=True)
                    tones = tones / np.where(peak > 0, peak, 1)
                values = x[(centre - 1024)[:, None] + np.arange(2048)]
                m = len(frames)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([song] * m), pa.array([stem] * m), pa.array(frames, pa.int32()), pa.array(frames * dsp.HOP / rate),
                        pa.array(np.sqrt((values**2).mean(axis=1))), _lists(dsp.decibels(power @ dsp.mel_filters(rate, 2048).T)),
                        _lists(dsp.decibels(power @ dsp.mel_filters(rate, 2048, 64, 8000.0)[:8].T)), _lists(tones),
                    ],
                    names=["song_id", "stem", "frame", "t_s", "rms", "mel", "low", "chroma"],
                )

    return run


def features(blocks: DataFrame, *, constant: bool = False) -> DataFrame:
    """Level, mel and low-band decibels (80 dB below the loudest at least) and chroma of every frame.

    Chroma is from short spectra, or with ``constant`` from kernels that are
    long enough for low notes, for which a block gets more of its neighbours.
    """
    halo: int | Column = HALO
    if constant:
        rates = (8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000)
        halo = F.lit(_edge(96000, True))
        for rate in reversed(rates):
            halo = F.when(F.col("rate") == rate, _edge(rate, True)).otherwise(halo)
    raw = with_edges(blocks, halo).mapInArrow(_features(constant), FEATURES)
    tops = raw.groupBy("song_id", "stem").agg(F.max(F.array_max("mel")).alias("_mel"), F.max(F.array_max("low")).alias("_low"))
    raw = raw.join(tops, ["song_id", "stem"])

    def floored(bands: str, top: str):
        return F.transform(bands, lambda v: F.greatest(v, (F.col(top) - 80).cast("float")))

    return raw.withColumns({"mel": floored("mel", "_mel"), "low": floored("low", "_low")}).drop("_mel", "_low")


def onset_strength(frames: DataFrame, bands: str = "mel", name: str = "onset") -> DataFrame:
    """Add the mean rise of the bands in decibels from one frame to the next, told two frames later."""
    w = Window.partitionBy("song_id", "stem").orderBy("frame")
    rise = F.zip_with(bands, F.lag(bands).over(w), lambda a, b: F.greatest(a - b, F.lit(0.0).cast("float")))
    frames = frames.withColumn("_rise", signal.total(rise) / F.size(bands))
    return frames.withColumn(name, F.coalesce(F.lag("_rise", 2).over(w), F.lit(0.0))).drop("_rise")


def _cepstra(batches):
    for batch in batches:
        mel = batch["mel"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        got = (mel @ dsp.cosines(20, mel.shape[1]).T).astype(np.float32)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), 20).cast(pa.list_(pa.float32()))
        names = ["song_id", "stem", "frame"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], rows], names=[*names, "mfcc"])


def cepstra(frames: DataFrame) -> DataFrame:
    """song_id, stem, frame, mfcc (20 coefficients) of every frame."""
    kinds = "song_id string, stem string, frame int, mfcc array<float>"
    return frames.select("song_id", "stem", "frame", "mel").mapInArrow(_cepstra, kinds)
