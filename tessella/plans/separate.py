"""Separation of a mix into stems, and when an earlier separation can be used again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.sources.wav import BLOCKS
from tessella.workers import prepare

SEPARATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SIZE, HOP = 2048, 1024
#: Samples of a block's neighbours that its masks and overlaps need.
EDGE = 20 * HOP


def separator(name: str):
    """Register a function from mix blocks to stem blocks."""

    def add(f):
        SEPARATORS[name] = f
        return f

    return add


def get(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in SEPARATORS:
        raise KeyError(f"no separator {name}; there are {', '.join(sorted(SEPARATORS))}")
    return SEPARATORS[name]


def _restored(spectrum: np.ndarray, n: int) -> np.ndarray:
    """Weighted overlap-add of frames that begin HOP apart."""
    frames = np.fft.irfft(spectrum, SIZE, axis=1) * dsp.hann(SIZE)
    out, weight = np.zeros(n), np.zeros(n)
    for i, frame in enumerate(frames):
        out[i * HOP : i * HOP + SIZE] += frame
        weight[i * HOP : i * HOP + SIZE] += dsp.hann(SIZE) ** 2
    return np.where(weight > 1e-8, out / np.where(weight > 1e-8, weight, 1), 0)


def _separated(batches):
    names = ("song_id", "block_idx", "start_sample", "n", "total", "rate")
    for batch in batches:
        facts = {c: batch[c].to_pylist() for c in names}
        for i in range(len(batch)):
            song, block, start, n, total, rate = (facts[c][i] for c in names)
            channels = []
            for side in ("left", "right"):
                x = np.zeros(EDGE + n + EDGE + SIZE)
                for name, at in ((f"{side}_before", None), (side, EDGE), (f"{side}_after", EDGE + n)):
                    if batch[name][i].is_valid:
                        values = np.asarray(batch[name][i].values, np.float64)
                        at = EDGE - len(values) if at is None else at
                        x[at : at + len(values)] = values
                channels.append(x)
            first = max(-EDGE, -start) // HOP  # frames whose centres lie in the song
            last = min(n + EDGE, total - start) // HOP
            starts = np.arange(first, last + 1) * HOP + EDGE - SIZE // 2
            starts = starts[starts >= 0]
            mask = dsp.soft_masks(np.abs(dsp.spectra((channels[0] + channels[1]) / 2, starts, SIZE)))
            low = np.clip((250 - np.fft.rfftfreq(SIZE, 1 / rate)) / 130, 0, 1)
            stems: dict[str, list] = {"drums": [], "bass": [], "other": []}
            for x in channels:
                spectrum = dsp.spectra(x, starts, SIZE)
                here = slice(EDGE - starts[0], EDGE - starts[0] + n)
                size = len(starts) * HOP + SIZE + n
                drums, bass = (_restored(spectrum * gain, size)[here] for gain in (1 - mask, mask * low))
                for name, y in (("drums", drums), ("bass", bass), ("other", x[EDGE : EDGE + n] - drums - bass)):
                    stems[name].append(y.astype(np.float32))
            for name, (left, right) in stems.items():
                columns = [pa.array([song]), pa.array([name]), pa.array([block], pa.int32()), pa.array([start]), pa.array([n], pa.int32()), pa.array([total]), pa.array([rate], pa.int32()), pa.array([left], pa.list_(pa.float32())), pa.array([right], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


@separator("quick")
def quick(mix: DataFrame) -> DataFrame:
    """drums, bass and other by medians of the spectrum, block by block; they add up to the mix."""
    prepare(mix.sparkSession)
    w = Window.partitionBy("song_id").orderBy("block_idx")
    edges = {}
    for side in ("left", "right"):
        edges[f"{side}_before"] = F.lag(F.slice(side, F.greatest(F.col("n") - EDGE + 1, F.lit(1)), EDGE)).over(w)
        edges[f"{side}_after"] = F.lead(F.slice(side, 1, EDGE)).over(w)
    return mix.withColumns(edges).mapInArrow(_separated, BLOCKS)


@dataclass(frozen=True)
class Plan:
    """What a song's next separation does."""

    vocal_model: bool  # split into vocals and instrumental by the vocal model
    pair_from_stems: bool  # or take the pair from a four-stem separation
    stems_on: str | None  # 'mix' or 'instrumental', or None if no stems are made


def plan(mode: str, *, fast: bool = False, hq_vocals: bool = False, include_stems: bool = False, pair_source: str | None = None, pair_exists: bool = False, stems_from: str | None = None, stems_exist: bool = False) -> Plan:
    """Decide what to run and what of an earlier separation to use again."""
    wants_model = (mode == "split" and not fast) or (mode == "kit" and hq_vocals)
    need_stems = mode == "kit" or include_stems
    source = pair_source if pair_exists and not (wants_model and pair_source != "vocal_model") else None
    have = stems_from if stems_from and stems_exist else None
    run_model = from_stems = False
    if (mode == "split" or wants_model) and source is None:
        if wants_model:
            run_model, source, have = True, "vocal_model", None
        else:
            from_stems, source, have = True, "stems", "mix"
    wanted = "instrumental" if source == "vocal_model" else "mix"
    return Plan(run_model, from_stems, wanted if need_stems and have != wanted else None)


def satisfied(mode: str, **state) -> bool:
    """Whether the stage can be skipped."""
    p = plan(mode, **state)
    return not (p.vocal_model or p.pair_from_stems or p.stems_on)
