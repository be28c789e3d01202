"""Kernels against closed forms and published tolerances."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dsp, scoring
from tessella.operators import frames as fr
from tessella.plans import analysis
from tessella.sources import wav
from tests import songs

T = np.arange(44100) / 44100


def test_zero_crossing():
    x = np.array([-1, -1, -1, 1, 1, 1, 1, -1.0])
    assert dsp.nearest_crossing(x, 1, 3) == 3 and dsp.nearest_crossing(x, 6, 3) == 7
    assert dsp.nearest_crossing(np.ones(5), 2, 2) == 2 and dsp.nearest_crossing(np.ones(0), 0, 2) == 0


def test_resampling():
    y = dsp.resampled(np.sin(2 * np.pi * 440 * T)[None], 44100, 48000)[0]
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / 48000)
    assert len(y) == 48000 and np.abs(y - want)[200:-200].max() < 2e-3
    assert dsp.resampled(np.ones((2, 100), np.float32), 44100, 22050).shape == (2, 50)


@pytest.mark.parametrize("bits,error", [(16, 1e-4), (24, 1e-6), (32, 1e-7)])
def test_wav_round_trip(bits, error):
    x = np.stack((np.sin(T[:999]), np.cos(T[:999]) * 0.3))
    rate, back = wav.decode(wav.encode(x, 48000, bits))
    assert rate == 48000 and back.shape == x.shape and np.abs(back - x).max() < error
    with pytest.raises(wav.WavError):
        wav.decode(b"RIFF0000WAVE")


def test_wav_odd_chunks():
    raw = wav.encode(np.zeros((1, 3)), 8000, 24)
    extra = raw[:12] + b"LIST\x03\0\0\0abc\0" + raw[12:]
    assert wav.decode(extra)[1].shape == (1, 3)


def test_filters():
    mel = dsp.mel_filters(44100, 2048)
    assert mel.shape == (128, 1025) and (mel >= 0).all() and (mel.sum(axis=1) > 0).all()
    assert np.allclose(dsp.cosines(20, 128) @ dsp.cosines(20, 128).T, np.eye(20))
    for midi, name in ((69, 9), (60, 0), (65, 5)):
        power = np.abs(dsp.spectra(np.sin(2 * np.pi * songs.hz(midi) * T), np.array([0]), 4096)) ** 2
        assert int((power @ dsp.chroma_filters(44100, 4096).T).argmax()) == name


def plain_tempo(onsets, rate):
    """Of a whole song at once."""
    size = dsp.tempo_window(rate)
    half = size // 2
    ramp = np.arange(half) / half
    padded = np.concatenate((onsets[0] * ramp, onsets, onsets[-1] * ramp[::-1]))
    sums = dsp.correlations(padded[: len(onsets) + size - 1], size)
    bpm = 60 * rate / (512 * np.arange(1, size))
    score = np.log1p(1e6 * np.maximum(0, sums[1:] / len(onsets))) - 0.5 * (np.log2(bpm) - np.log2(120)) ** 2
    return bpm[np.where(bpm < 320, score, -np.inf).argmax()]


def test_tempo_by_chunks_is_that_of_the_song(spark, monkeypatch):
    rng = np.random.default_rng(3)
    clicks = np.zeros(2000)
    clicks[np.round(np.arange(0, 2000 - 43, 43.066)).astype(int)] = 1.0
    made = {"clicks": (clicks, 44100), "noise": (rng.random(3001), 44100), "short": (rng.random(30), 44100), "slow": (np.roll(clicks, 7) + 0.1 * rng.random(2000), 22050), "none": (np.zeros(900), 44100), "one": (np.ones(1), 48000)}
    rows = [(song, i, float(v), rate) for song, (x, rate) in made.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "song_id string, frame int, onset double, rate int")
    want = {song: plain_tempo(*x) for song, x in made.items()}
    for chunk in (64, 500, 4096):
        monkeypatch.setattr(analysis, "TEMPO_CHUNK", chunk)
        got = {r.song_id: r.bpm for r in analysis.tempos(table).collect()}
        assert got == pytest.approx(want, rel=1e-12)
    assert abs(got["clicks"] - 120) < 1


def plain_chain(local, period, tightness):
    total, back, begun = [], [], False
    for i, v in enumerate(local):
        steps = [s for s in range(round(period / 2), 2 * period + 1) if s <= i]
        scores = [total[i - s] - tightness * np.log(s / period) ** 2 for s in steps]
        begun = begun or v >= 0.01 * max(local)
        total.append(v + max(scores, default=0))
        back.append(i - steps[int(np.argmax(scores))] if scores and begun else -1)
    return total, back


def test_beats():
    clicks = np.zeros(2000)
    clicks[np.round(np.arange(0, 2000 - 43, 43.066)).astype(int)] = 1.0
    beats = dsp.beat_frames(clicks, 44100, 120.2)
    assert len(beats) > 40 and np.abs(np.diff(beats) - 43).max() <= 1
    assert len(dsp.beat_frames(np.zeros(50), 44100, 120)) == 0
    local = np.random.default_rng(4).random(600)
    local[:20] = 0
    for period in (7, 40, 400):
        total, back = dsp.chained(local, period, 100.0)
        want = plain_chain(local.tolist(), period, 100.0)
        assert np.allclose(total, want[0]) and back.tolist() == want[1]
    assert dsp.local_maxima(np.array([3, 1, 2, 2, 1, 5])).tolist() == [2, 5]


def plain_ward(rows, k):
    runs = [[r] for r in rows]
    while len(runs) > k:
        costs = [len(a) * len(b) / (len(a) + len(b)) * np.square(np.mean(a, 0) - np.mean(b, 0)).sum() for a, b in zip(runs[:-1], runs[1:], strict=True)]
        i = int(np.argmin(costs))
        runs[i : i + 2] = [runs[i] + runs[i + 1]]
    return np.cumsum([0, *map(len, runs)])[:-1].tolist()


def test_ward():
    rows = np.array([[0, 0], [0.1, 0], [5, 5], [5, 5.2], [9, 0], [9.1, 0]])
    assert dsp.contiguous_ward(rows, 3).tolist() == [0, 2, 4]
    assert dsp.contiguous_ward(np.zeros((5, 2)), 2).tolist() == [0, 4]  # of equal pairs the first
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 5), (40, 7), (200, 10)):
        x = rng.standard_normal((n, 3))
        assert dsp.contiguous_ward(x, k).tolist() == plain_ward(x, k)
    began = time.perf_counter()
    assert len(dsp.contiguous_ward(rng.standard_normal((100_000, 25)), 10)) == 10 and time.perf_counter() - began < 30


def test_fades_and_peak():
    y = dsp.faded(np.ones((2, 10)), 3, 2)
    assert y[0].tolist() == [0, 0.5, 1, 1, 1, 1, 1, 1, 1, 0]
    assert abs(np.abs(dsp.peak_normalised(np.array([[0.5, -0.2]]), -6.0)).max() - 10 ** (-6 / 20)) < 1e-9
    assert dsp.peak_normalised(np.zeros((1, 3)), -1.0).sum() == 0


def test_drum_classes(spark):
    rng = np.random.default_rng(1)
    sounds = {"kick": songs.kick(), "snare": songs.snare(rng), "hat": songs.hat(rng), "perc": songs.tone(900, 0.1, 2, 30)}
    rows = []
    for name, x in sounds.items():
        hit = x[: int(0.08 * 44100)]
        n = max(2048, len(hit))
        power, hz = np.abs(np.fft.rfft(hit * np.hanning(len(hit)), n)) ** 2, np.fft.rfftfreq(n, 1 / 44100)
        band = np.sqrt(power[(hz > 200) & (hz < 10000)]) + 1e-12
        rows.append((name, len(hit), *(float(v) for v in (power[hz < 150].sum() / power.sum(), power[hz > 5000].sum() / power.sum(), (power * hz).sum() / power.sum(), np.exp(np.log(band).mean()) / band.mean()))))
    df = spark.createDataFrame(rows, "name string, n int, low double, high double, centre double, flat double")
    got = df.withColumn("got", scoring.drum_category("n", "low", "high", "centre", "flat")).collect()
    assert {r.name: r.got for r in got} == {k: k for k in sounds}


def test_frames_do_not_depend_on_blocks(spark, tmp_path, monkeypatch):
    x = {"a": {"drums": songs.stems(bars=4)["drums"]}}
    _, blocks = songs.frames_of(spark, x, str(tmp_path))
    (tmp_path / "whole").mkdir()
    monkeypatch.setattr(wav, "BLOCK", 1 << 21)
    _, whole = songs.frames_of(spark, x, str(tmp_path / "whole"))
    got, want = (fr.features(b).orderBy("frame").toPandas() for b in (blocks, whole))
    assert len(got) == len(want) == len(x["a"]["drums"]) // 512 + 1
    for c in ("mel", "low", "chroma"):
        assert np.allclose(np.stack(got[c]), np.stack(want[c]), atol=1e-3)
    env = fr.onset_strength(fr.features(blocks)).agg(F.min("onset"), F.max("onset")).first()
    assert env[0] == 0 and env[1] > 1


def test_ingest(spark, tmp_path):
    (tmp_path / "songs").mkdir()
    tone = np.sin(2 * np.pi * 220 * np.arange(22050) / 22050)[None]
    (tmp_path / "songs" / "tone.wav").write_bytes(wav.encode(tone, 22050, 16))
    (tmp_path / "songs" / "note.txt").write_bytes(b"no")
    (tmp_path / "songs" / "song.mp3").write_bytes(b"no")
    listed = {r.path.rsplit("/", 1)[1]: r.error for r in wav.list_songs(spark, str(tmp_path / "songs"), rights_confirmed=True).collect()}
    assert listed == {"tone.wav": None, "note.txt": "not an audio file", "song.mp3": "only WAV is decoded here"}
    found = wav.read_songs(spark, str(tmp_path / "songs"), rights_confirmed=True).collect()
    assert [(r.song_id, r.stem, r.total, r.rate, r.n) for r in found] == [("tone", "mix", 44100, 44100, 44100)]
    assert wav.read_songs(spark, str(tmp_path / "songs"), rights_confirmed=False).count() == 0
    assert wav.read_songs(spark, str(tmp_path / "songs"), rights_confirmed=True, max_s=0.5).count() == 0
