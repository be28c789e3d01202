"""Constant-Q chroma: notes, blocks, rates."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.functions import constant_q, dsp
from tessella.operators import frames as fr
from tessella.sources import wav
from tests import songs


def note(midi, rate, seconds=2.0):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * k * songs.hz(midi) * t) / k for k in (1, 2))


def middle(x, rate):
    frames = np.array([len(x) // 2 // dsp.HOP])
    return constant_q.chroma(x, 0, frames, rate)[0]


@pytest.mark.parametrize("rate", [22050, 44100, 48000, 96000])
def test_every_note_falls_in_its_class(rate):
    for midi in range(28, 96):
        tones = middle(note(midi, rate), rate)
        assert tones.argmax() == midi % 12 and tones[(midi + 1) % 12] < 0.5 and tones[(midi - 1) % 12] < 0.5


def test_low_notes_that_short_spectra_mix_up():
    wrong = 0
    for midi in range(28, 40):  # E1 to D#2
        x = np.sin(2 * np.pi * songs.hz(midi) * np.arange(88200) / 44100)
        assert middle(x, 44100).argmax() == midi % 12
        power = np.abs(dsp.spectra(x, np.array([40000]), 4096)) ** 2
        wrong += int((power @ dsp.chroma_filters(44100, 4096).T)[0].argmax()) != midi % 12
    assert wrong >= 3


def test_silence_low_rates_and_high_ones():
    assert (constant_q.chroma(np.zeros(5000), 0, np.arange(5), 44100) == 0).all()
    assert constant_q.layout(44100) == (4, 7) and constant_q.layout(8000)[1] == 6 and constant_q.layout(100) == (1, 0)
    assert constant_q.chroma(np.ones(100), 0, np.array([0]), 100).shape == (1, 12)
    assert middle(note(69, 8000), 8000).argmax() == 9
    with pytest.raises(ValueError, match="up to"):
        constant_q.layout(192_000)


@pytest.mark.parametrize("rate", [44100, 45000])
def test_chroma_does_not_depend_on_blocks(spark, tmp_path, monkeypatch, rate):
    x = sum(songs.stems(bars=5).values()).astype(np.float32)
    for name, size in (("blocks", wav.BLOCK), ("whole", 1 << 21)):
        monkeypatch.setattr(wav, "BLOCK", size)
        pq.write_table(pa.Table.from_batches(wav.blocks_of("s", "mix", rate, np.stack((x, x)))), tmp_path / f"{name}.parquet")
    got, want = (fr.features(spark.read.schema(wav.BLOCKS).parquet(str(tmp_path / f"{n}.parquet")), constant=True).orderBy("frame").toPandas() for n in ("blocks", "whole"))
    assert got.frame.tolist() == want.frame.tolist() == list(range(len(x) // 512 + 1))
    for c in ("chroma", "mel", "low"):
        assert np.allclose(np.stack(got[c]), np.stack(want[c]), atol=2e-3)
    at_once = constant_q.chroma(np.concatenate((np.zeros(200_000), x.astype(np.float64), np.zeros(200_000))), -200_000, got.frame.to_numpy(), rate)
    assert np.allclose(np.stack(got["chroma"]), at_once, atol=1e-5)
