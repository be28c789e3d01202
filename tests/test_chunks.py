"""The chunk loop against a loop over the whole signal."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.plans import chunks, separate
from tessella.sources import wav


def bent(x):
    """A model that isn't linear in its place: what comes out depends on where in the chunk a sample stands."""
    ramp = np.linspace(0.5, 1.5, x.shape[1], dtype=np.float32)
    return {"a": x * ramp, "b": np.tanh(x)}


def plain(x, model, length):
    """The published loop: chunks, triangular weights, the song's mean and deviation."""
    n, mono = x.shape[1], x.mean(axis=0, dtype=np.float64)
    mean, deviation = mono.mean(), mono.std(ddof=1) if n > 1 else 0.0
    deviation = deviation or 1.0
    out, weight = {}, np.zeros(n)
    shape = np.minimum(np.arange(1, length + 1), np.arange(length, 0, -1)) / (length - length // 2)
    if length % 2:
        half = length // 2
        shape = np.array([i + 1 if i < half else length - i for i in range(length)]) / (length - half)
    for first in range(0, n, max(1, length * 3 // 4)):
        size = min(length, n - first)
        shift = (length - size) // 2
        heard = np.zeros((2, length), np.float32)
        for i in range(length):
            j = first - shift + i
            if 0 <= j < n:
                heard[:, i] = (x[:, j] - mean) / deviation
        for name, y in model(heard).items():
            out.setdefault(name, np.zeros((2, n)))[:, first : first + size] += shape[:size] * y[:, shift : shift + size]
        weight[first : first + size] += shape[:size]
    return {name: y / weight * deviation + mean for name, y in out.items()}


@pytest.fixture
def songs(monkeypatch, tmp_path):
    for module in (wav, chunks):
        monkeypatch.setattr(module, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    made = {"long": 3 * rng.standard_normal((2, 4321)) + 0.5, "even": rng.standard_normal((2, 3000)), "short": rng.standard_normal((2, 40)), "one": np.full((2, 1), 0.25), "flat": np.full((2, 1500), 0.75), "none": np.zeros((2, 0))}
    made = {k: v.astype(np.float32) for k, v in made.items()}
    for song, x in made.items():
        pq.write_table(pa.Table.from_batches(wav.blocks_of(song, "mix", 44100, x)), tmp_path / f"{song}.parquet")
    return made, str(tmp_path)


def stems(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r.block_idx):
        assert r.start_sample == r.block_idx * 1000 and r.n == len(r.left) == min(1000, r.total - r.start_sample) and r.rate == 44100
        out.setdefault((r.song_id, r.stem), []).append(np.stack((r.left, r.right)))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


@pytest.mark.parametrize("length", [600, 999, 1000, 2500])
def test_chunks_against_the_loop(spark, songs, length):
    made, path = songs
    got = stems(chunks.separate(spark.read.schema(wav.BLOCKS).parquet(path), bent, ("a", "b"), length))
    want = {(song, name): y for song, x in made.items() if x.shape[1] for name, y in plain(x, bent, length).items()}
    assert set(got) == set(want)
    assert all(got[k].shape == want[k].shape and np.abs(got[k] - want[k]).max() < 2e-6 for k in want)


def test_an_identity_gives_the_mix_back(spark, songs):
    made, path = songs
    separate.separator("same")(chunks.as_separator(lambda x: {"mix": x, "not kept": x}, ("mix",), 700))
    got = stems(separate.get("same")(spark.read.schema(wav.BLOCKS).parquet(path)))
    assert set(got) == {(song, "mix") for song in made if song != "none"}
    assert all(np.abs(got[song, "mix"] - x).max() < 1e-6 for song, x in made.items() if song != "none")
    del separate.SEPARATORS["same"]


def test_levels_do_not_depend_on_the_mean(spark, tmp_path):
    x = (np.random.default_rng(2).standard_normal((2, 300_000)) * 1e-3 + 0.9).astype(np.float32)
    pq.write_table(pa.Table.from_batches(wav.blocks_of("s", "mix", 44100, x)), tmp_path / "s.parquet")
    r = chunks.levels(spark.read.schema(wav.BLOCKS).parquet(str(tmp_path))).first()
    mono = x.astype(np.float64).mean(axis=0)
    assert abs(r.mean - mono.mean()) < 1e-8 and abs(r.deviation / mono.std(ddof=1) - 1) < 1e-4
