"""Reading and writing WAV files by blocks, and conversion of rates by parts."""

import hashlib
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.operators import frames as fr
from tessella.sources import files, wav


def signal(n, seed=1):
    return (np.random.default_rng(seed).standard_normal((2, n)) * 0.2).astype(np.float32)


RATES = [(88200, 44100), (22050, 44100), (96000, 44100), (48000, 44100), (44100, 48000), (8000, 44101)]


@pytest.mark.parametrize("own,to", RATES)
def test_parts_are_the_whole(own, to):
    x = signal(40_000)
    n = dsp.resampled_length(x.shape[1], own, to)
    whole, rng = dsp.resampled(x, own, to), np.random.default_rng(2)
    cuts = [0, *sorted(rng.integers(0, n, 4).tolist()), n]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = dsp.samples_needed(a, b, x.shape[1], own, to)
        parts.append(dsp.resampled_part(x[:, low:high], low, a, b, own, to))
    assert whole.shape == (2, n) and np.abs(np.concatenate(parts, axis=1) - whole).max() < 1e-7


@pytest.mark.parametrize("own,to", RATES[:5])
def test_tones_keep_their_pitch_and_memory_its_bound(own, to):
    seconds = 4
    t = np.arange(seconds * own) / own
    x = np.stack((np.sin(2 * np.pi * 440 * t), np.cos(2 * np.pi * 1000 * t))).astype(np.float32)
    tracemalloc.start()
    y = dsp.resampled(x, own, to)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.arange(y.shape[1]) / to
    want = np.stack((np.sin(2 * np.pi * 440 * s), np.cos(2 * np.pi * 1000 * s)))
    assert np.abs(y - want)[:, 300:-300].max() < 2e-3
    assert peak - y.nbytes < 30 << 20  # for any length: the conversion holds one part of the outputs


@pytest.mark.parametrize("own,to", RATES[:4])
def test_blocks_at_another_rate(spark, tmp_path, own, to):
    for song, n in (("a", 3 * wav.BLOCK + 17), ("b", 5), ("c", 0)):
        pq.write_table(pa.Table.from_batches(wav.blocks_of(song, "mix", own, signal(n))), tmp_path / f"{song}.parquet")
    pq.write_table(pa.Table.from_batches(wav.blocks_of("d", "mix", to, signal(99))), tmp_path / "d.parquet")
    got = fr.resampled_blocks(spark.read.schema(wav.BLOCKS).parquet(str(tmp_path)), to).orderBy("song_id", "block_idx").collect()
    for song, n in (("a", 3 * wav.BLOCK + 17), ("b", 5), ("c", 0), ("d", 99)):
        want = signal(n) if song == "d" else dsp.resampled(signal(n), own, to)
        rows = [r for r in got if r.song_id == song]
        assert [(r.block_idx, r.start_sample, r.n, r.total, r.rate) for r in rows] == [(k, k * wav.BLOCK, min(wav.BLOCK, want.shape[1] - k * wav.BLOCK), want.shape[1], to) for k in range(max(1, -(-want.shape[1] // wav.BLOCK)))]
        for c, channel in zip(("left", "right"), want, strict=True):
            assert np.abs(np.concatenate([np.array(r[c], np.float32) for r in rows]) - channel).max(initial=0) < 1e-7


def folder_of_songs(tmp_path):
    own = tmp_path / "in put%20"
    own.mkdir()
    long = signal(20 * wav.BLOCK + 5)
    (own / "long ö.wav").write_bytes(wav.encode(long, 44100, 24))
    (own / "half.wav").write_bytes(wav.encode(long[:1, : 3 * wav.BLOCK], 22050, 16))
    (own / "none.wav").write_bytes(wav.encode(long[:, :0], 44100, 32))
    six = np.repeat(long[:1, :1000], 6, axis=0)
    (own / "six.wav").write_bytes(wav.encode(six, 44100, 32))
    return own, long


def test_a_song_is_read_by_several_tasks(spark, tmp_path):
    own, long = folder_of_songs(tmp_path)
    found = wav.read_songs(spark, str(own), rights_confirmed=True)
    rows = found.withColumn("task", F.spark_partition_id()).orderBy("song_id", "block_idx").collect()
    tasks = {s: len({r.task for r in rows if r.song_id == s}) for s in ("long ö", "half")}
    assert tasks["long ö"] >= 2
    for song in ("long ö", "half", "none", "six"):
        rate, x = wav.decode((own / f"{song}.wav").read_bytes())
        want = [b.to_pylist()[0] for b in wav.blocks_of(song, "mix", 44100, dsp.resampled(x, rate, 44100))]
        got = [r for r in rows if r.song_id == song]
        facts = ("song_id", "stem", "block_idx", "start_sample", "n", "total", "rate")
        assert [[r[c] for c in facts] for r in got] == [[w[c] for c in facts] for w in want]
        assert all(np.abs(np.array(r[c]) - np.array(w[c])).max(initial=0) < 1e-7 for r, w in zip(got, want, strict=True) for c in ("left", "right"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_large_and_odd_files_have_rows(spark, tmp_path):
    own, _ = folder_of_songs(tmp_path)
    with (own / "huge.wav").open("wb") as f:
        f.truncate(3 << 30)  # sparse; Spark's reader of whole files refuses more than 2 GB
    with (own / "hours.wav").open("wb") as f:
        f.write(wav.head_of(600_000_000, 2, 44100, 24))
        f.truncate(44 + 3_600_000_000)
    (own / "chunks.wav").write_bytes(b"RIFF\0\0\0\0WAVE" + b"JUNK\0\0\0\0" * 5000)
    late = wav.encode(np.zeros((1, 3)), 8000, 24)
    (own / "late.wav").write_bytes(late[:12] + b"LIST\x03\0\0\0abc\0" + late[12:])
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.list_songs(spark, str(own), rights_confirmed=True).collect()}
    assert rows["huge.wav"].error == rows["hours.wav"].error == "too large" and "can't be decoded" in rows["chunks.wav"].error
    assert rows["late.wav"].error is None and (rows["late.wav"].frames, rows["late.wav"].rate) == (3, 8000)
    assert rows["half.wav"].sha256 == hashlib.sha256((own / "half.wav").read_bytes()).hexdigest()
    assert wav.read_songs(spark, str(own), rights_confirmed=True).select("song_id").distinct().count() == 5
    # With a higher limit, only the blocks of such a file are ever read.
    more = {r.path.rsplit("/", 1)[1]: r for r in wav.list_songs(spark, str(own), rights_confirmed=True, most_bytes=1 << 40, max_s=1e6, hashes=False).collect()}
    assert more["hours.wav"].error is None and more["hours.wav"].frames == 600_000_000 and "not a WAV file" in more["huge.wav"].error
    files_only = wav.read_songs(spark, str(own / "hours.wav"), rights_confirmed=True, most_bytes=1 << 40, max_s=1e6).select("block_idx", "n", "total")
    assert files_only.where("block_idx in (0, 4577)").count() == 2 and files_only.agg(F.sum("n")).first()[0] == 600_000_000


def test_a_file_that_cannot_be_opened_has_an_error(tmp_path):
    row = {"song_id": "gone", "stem": "mix", "path": f"file:{tmp_path}/gone.wav", "length": 64, "error": None}
    [batch] = wav._probed(600, True)([pa.RecordBatch.from_pylist([row])])
    assert "can't be opened" in batch["error"][0].as_py() and batch["frames"][0].as_py() is None


def test_written_files_are_the_blocks(spark, tmp_path):
    own, _ = folder_of_songs(tmp_path)
    read = wav.decode((own / "long ö.wav").read_bytes())[1]
    blocks = wav.read_songs(spark, str(own), rights_confirmed=True).withColumn("file", F.concat(F.lit("a/b/"), "song_id", F.lit(".wav")))
    for bits, error in ((16, 1e-4), (24, 1e-6), (32, 1e-9)):
        out = tmp_path / f"out{bits}"
        wav.write_songs(blocks, out.as_uri(), bits=bits)
        assert sorted(p.name for p in (out / "a" / "b").iterdir()) == ["half.wav", "long ö.wav", "none.wav", "six.wav"] and len(list(out.iterdir())) == 1
        rate, x = wav.decode((out / "a" / "b" / "long ö.wav").read_bytes())
        assert rate == 44100 and np.abs(x - (read if bits == 32 else np.clip(read, -1, 1))).max() < error
        assert wav.decode((out / "a" / "b" / "none.wav").read_bytes())[1].shape == (2, 0)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"f{i}", k, 8, b"abcd") for i in range(40) for k in range(2)]
    good = spark.createDataFrame(rows, "file string, part int, size int, content binary")
    files.write_parts(good, out.as_uri())
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {f"f{i}": b"abcdabcd" for i in range(40)}
    lost = good.where("file <> 'f7' or part = 0").withColumn("file", F.concat(F.lit("new/"), "file"))
    with pytest.raises(Exception, match="would have 4 bytes instead of 8"):
        files.write_parts(lost, out.as_uri())
    assert len(list(out.iterdir())) == 40
    files.write_parts(good.withColumn("content", F.lit(b"wxyz")), out.as_uri())
    assert {p.read_bytes() for p in out.iterdir()} == {b"wxyzwxyz"}
    files.write_parts(good.where("false"), out.as_uri())
    assert len(list(out.iterdir())) == 40


def test_more_than_a_file_can_say():
    with pytest.raises(wav.WavError, match="more than a WAV file"):
        wav.head_of(1 << 30, 2, 44100, 24)
    assert struct.unpack_from("<I", wav.head_of(3, 1, 8000, 24), 4)[0] == 36 + 10
