"""Separation by a model that takes chunks of a fixed length: from blocks to overlapping chunks, and back by overlap-add.

A model hears ``length`` samples at a time, of a signal with the song's mean
taken off and divided by its deviation. Chunks begin every three quarters of
that; the last ones stand in the middle of their input, what lies outside the
song being zeros. Each chunk's output counts with triangular weights. Blocks are
cut to what a chunk needs before they are shuffled, a chunk is a task's group of
a few pieces, and what it gives goes to the blocks that it covers in pieces of
its own; no task holds more of a song than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import signal
from tessella.operators.frames import BLOCK
from tessella.sources.wav import BLOCKS
from tessella.workers import prepare

#: A model takes float32 (2, length) and gives (2, length) of each of its sources.
Model = Callable[[np.ndarray], dict[str, np.ndarray]]
_FACTS = "song_id string, rate int, total long, mean double, deviation double"
_PIECES = f"{_FACTS}, stem string, block_idx long, at long, chunk long, left array<float>, right array<float>"


def levels(blocks: DataFrame) -> DataFrame:
    """song_id, rate, total, mean, deviation (unbiased; 1 of a signal without any) of each song's mono signal.

    Each block has its own mean and sum of squares around it, which add up.
    """
    mono = blocks.select("song_id", "rate", "total", "n", signal.to_mono("left", "right").alias("x"))
    mono = mono.withColumn("m", signal.total("x") / F.greatest("n", F.lit(1)))
    around = F.transform("x", lambda v: (v - F.col("m")) * (v - F.col("m")))
    mono = mono.withColumn("s", signal.total(around))
    w = Window.partitionBy("song_id")
    mono = mono.select("song_id", "rate", "total", "n", "m", "s", (F.sum(F.col("m") * F.col("n")).over(w) / F.greatest(F.sum("n").over(w), F.lit(1))).alias("mean"))
    apart = F.col("m") - F.col("mean")
    told = mono.groupBy("song_id", "rate", "total", "mean").agg(F.sum(F.col("s") + F.col("n") * apart * apart).alias("_s"))
    deviation = F.sqrt(F.col("_s") / F.greatest(F.col("total") - 1, F.lit(1)))
    return told.select("song_id", "rate", "total", "mean", F.when(deviation > 0, deviation).otherwise(1.0).alias("deviation"))


def weights(length: int) -> np.ndarray:
    """A triangle with its top of 1 in the middle, nowhere 0."""
    rise = np.arange(1, length // 2 + 1)
    fall = np.arange(length - length // 2, 0, -1)
    return np.concatenate((rise, fall)) / fall[0]


def into_chunks(blocks: DataFrame, length: int, stride: int) -> DataFrame:
    """song_id, chunk, ``at`` and the samples of each block that lie in a chunk's input, for every chunk."""
    s, n, total = F.col("start_sample"), F.col("n"), F.col("total")
    last = F.greatest(F.ceil(total / stride) - 1, F.lit(0))
    # A chunk's input begins half of what it lacks before the chunk, which is less than its length.
    first_k = F.greatest(F.floor((s - length) / stride), F.lit(0))
    rows = blocks.where("n > 0").withColumn("chunk", F.explode(F.sequence(F.least(first_k, last), F.least(F.floor((s + n + length) / stride), last))))
    begin = F.col("chunk") * stride
    begin = begin - F.floor(F.greatest(begin + length - total, F.lit(0)) / 2)
    rows = rows.withColumns({"begin": begin.cast("long")}).withColumns({"at": F.greatest("begin", s), "_end": F.least(F.col("begin") + length, s + n)}).where("at < _end")
    cut = {c: F.slice(c, (F.col("at") - s + 1).cast("int"), (F.col("_end") - F.col("at")).cast("int")) for c in ("left", "right")}
    return rows.withColumns(cut).select("song_id", "chunk", "begin", "at", "left", "right")


def _heard(model: Model, sources: Sequence[str], length: int, stride: int):
    shape = weights(length)

    def run(key, pieces: pd.DataFrame) -> pd.DataFrame:
        facts = pieces.iloc[0]
        chunk, begin, total = int(facts["chunk"]), int(facts["begin"]), int(facts["total"])
        x = np.zeros((2, length))
        for p in pieces.itertuples(index=False):
            for row, part in zip(x, (p.left, p.right), strict=True):
                row[p.at - begin : p.at - begin + len(part)] = (np.asarray(part, np.float64) - facts["mean"]) / facts["deviation"]
        got = model(x.astype(np.float32))
        first, rows = chunk * stride, []
        last = min(first + length, total)
        for name in sources:
            y = np.asarray(got[name], np.float64)[:, first - begin : last - begin] * shape[: last - first]
            for k in range(first // BLOCK, (last - 1) // BLOCK + 1):
                a, b = max(first, k * BLOCK), min(last, (k + 1) * BLOCK)
                rows.append((*(facts[c] for c in ("song_id", "rate", "total", "mean", "deviation")), name, k, a, chunk, *y[:, a - first : b - first].astype(np.float32)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _added(length: int, stride: int):
    shape = weights(length)

    def run(key, pieces: pd.DataFrame) -> pd.DataFrame:
        facts, k = pieces.iloc[0], int(key[2])
        start, total = k * BLOCK, int(facts["total"])
        n = min(BLOCK, total - start)
        sums, weight = np.zeros((2, n)), np.zeros(n)
        for p in pieces.sort_values("chunk").itertuples(index=False):
            own = slice(p.at - start, p.at - start + len(p.left))
            sums[:, own] += np.stack((p.left, p.right))
            weight[own] += shape[p.at - p.chunk * stride :][: len(p.left)]
        left, right = (sums / weight * facts["deviation"] + facts["mean"]).astype(np.float32)
        return pd.DataFrame({"song_id": key[0], "stem": key[1], "block_idx": k, "start_sample": start, "n": n, "total": total, "rate": int(facts["rate"]), "left": [left], "right": [right]})

    return run


def separate(mix: DataFrame, model: Model, sources: Sequence[str], length: int) -> DataFrame:
    """Blocks of each source of every song; a song without samples has none."""
    prepare(mix.sparkSession)
    stride = max(1, length * 3 // 4)
    pieces = into_chunks(mix, length, stride).join(levels(mix), "song_id")
    heard = pieces.groupBy("song_id", "chunk").applyInPandas(_heard(model, sources, length, stride), _PIECES)
    return heard.groupBy("song_id", "stem", "block_idx").applyInPandas(_added(length, stride), BLOCKS)


def as_separator(model: Model, sources: Sequence[str], length: int) -> Callable[[DataFrame], DataFrame]:
    """What ``separate.separator`` registers, of a model."""
    return lambda mix: separate(mix, model, sources, length)
