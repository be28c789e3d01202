"""WAV files as tables of sample blocks, and back.

``list_songs`` takes the files' names and sizes from Spark's listing and reads
their headers in tasks. ``read_songs`` then deals out ranges of blocks: a task
seeks to the samples of a block, with the few around it that a change of rate
needs, and decodes these alone. So several tasks share a song, none holds more
than a block, and files of any size can be listed. Planning stays in tasks as
well, since a driver that opened every file would be the slowest part of it.
From there on a song is rows of ``BLOCK`` samples, and ``write_songs`` puts
rows back into files block by block.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.operators.frames import BLOCK
from tessella.sources import files
from tessella.workers import prepare

#: What counts as an audio file, and the largest one taken.
SUFFIXES = ("wav", "wave", "aif", "aiff", "flac", "mp3", "m4a", "aac", "ogg", "opus")
MOST_BYTES = 300 << 20
BLOCKS = "song_id string, stem string, block_idx int, start_sample long, n int, total long, rate int, left array<float>, right array<float>"
LISTED = "song_id string, stem string, path string, length long, sha256 string, duration_s double, error string, tag int, channels int, rate int, bits int, at long, frames long"
#: Blocks that one row of a reading plan covers, and tasks that read at most.
RANGE_BLOCKS = 8
MOST_TASKS = 10_000
#: Bytes read for each task, about.
TASK_BYTES = 32 << 20
#: Chunks that are looked at until samples have been found.
MOST_CHUNKS = 1000


class WavError(ValueError):
    pass


def read_header(file, length: int) -> tuple[int, int, int, int, int, int]:
    """(format tag, channels, rate, bits, place of the samples, their whole bytes) of an open WAV file, by seeking from chunk to chunk."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise WavError("not a WAV file")
    at, kind, body = 12, None, None
    for _ in range(MOST_CHUNKS):
        if at + 8 > length or (kind and body):
            break
        file.seek(at)
        raw = file.read(48)
        name, size = raw[:4], struct.unpack_from("<I", raw, 4)[0]
        if name == b"fmt " and len(raw) >= 24:
            kind = struct.unpack_from("<HHIIHH", raw, 8)
            if kind[0] == 0xFFFE and len(raw) >= 34:
                kind = (struct.unpack_from("<H", raw, 32)[0], *kind[1:])
        elif name == b"data":
            body = (at + 8, min(size, length - at - 8))
        at += 8 + size + (size & 1)
    if kind is None or body is None:
        raise WavError("no format or no data")
    tag, channels, rate, _, _, bits = kind
    if (tag, bits) not in ((3, 32), (1, 16), (1, 24), (1, 32)):
        raise WavError(f"format {tag} of {bits} bits is not read")
    if not channels or not rate:
        raise WavError("no channels or no rate")
    step = channels * bits // 8
    return tag, channels, rate, bits, body[0], body[1] // step * step


def samples(body: bytes, tag: int, bits: int, channels: int) -> np.ndarray:
    """float32 samples by channel of PCM 16, 24 or 32 or float 32."""
    if tag == 3:
        x = np.frombuffer(body, "<f4")
    elif bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / np.float32(2**31)
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / np.float32(2 ** (bits - 1))
    return np.ascontiguousarray(x.astype(np.float32).reshape(-1, channels).T)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, float32 samples by channel) of a whole file."""
    tag, channels, rate, bits, at, size = read_header(io.BytesIO(raw), len(raw))
    return rate, samples(raw[at : at + size], tag, bits, channels)


def silence(rate: int, seconds: float = 0.05) -> np.ndarray:
    """What stands on an empty pad: 50 ms of stereo zeros."""
    return np.zeros((2, round(rate * seconds)), np.float32)


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved samples of (channels, samples); ``bits`` 16 or 24 are PCM, 32 is float."""
    flat = np.ascontiguousarray(x.T, np.float64).reshape(-1)
    if bits == 32:
        return flat.astype("<f4").tobytes()
    whole = np.rint(np.clip(flat, -1, 1) * (2 ** (bits - 1) - 1)).astype("<i4")
    return whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def head_of(total: int, channels: int, rate: int, bits: int) -> bytes:
    """What stands before the samples of a file of ``total`` frames."""
    step = channels * bits // 8
    size = total * step
    if 36 + size + (size & 1) >= 1 << 32:
        raise WavError(f"{size} bytes of samples are more than a WAV file can say")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + (size & 1), b"WAVE", b"fmt ", 16, 3 if bits == 32 else 1, channels, rate, rate * step, step, bits, b"data", size)


def encode(x: np.ndarray, rate: int, bits: int = 24) -> bytes:
    """A whole WAV file of (channels, samples)."""
    body = pcm(x, bits)
    return head_of(x.shape[1], x.shape[0], rate, bits) + body + b"\0" * (len(body) & 1)


def _batch(song: str, stem: str, rate: int, k: int, total: int, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    columns = [[song], [stem], pa.array([k], pa.int32()), [k * BLOCK], pa.array([len(left)], pa.int32()), [total], pa.array([rate], pa.int32()), pa.array([left], pa.list_(pa.float32())), pa.array([right], pa.list_(pa.float32()))]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["song_id", "stem", "block_idx", "start_sample", "n", "total", "rate", "left", "right"])


def blocks_of(song: str, stem: str, rate: int, x: np.ndarray):
    """Arrow batches of a signal's blocks; mono is doubled, more than two channels are left aside."""
    left, right = x[0], x[min(1, len(x) - 1)]
    for k in range(max(1, -(-len(left) // BLOCK))):
        yield _batch(song, stem, rate, k, len(left), *(y[k * BLOCK : (k + 1) * BLOCK] for y in (left, right)))


def _probed(max_s: float, hashes: bool):
    """Facts of each file from its header, and its digest if asked for; what can't be read has an error."""
    names = ("tag", "channels", "rate", "bits", "at", "frames")

    def facts_of(path: str, length: int) -> tuple[dict, str | None]:
        store, place = files.store_of(path)
        with store.open_input_file(place) as file:
            tag, channels, rate, bits, at, size = read_header(file, length)
            digest = None
            if hashes:
                file.seek(0)
                whole = hashlib.sha256()
                while part := file.read(1 << 20):
                    whole.update(part)
                digest = whole.hexdigest()
        return dict(zip(names, (tag, channels, rate, bits, at, size // (channels * bits // 8)), strict=True)), digest

    def run(batches):
        for batch in batches:
            errors, seconds, digests, told = batch["error"].to_pylist(), [], [], []
            for i, (path, length) in enumerate(zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True)):
                facts, digest, s = dict.fromkeys(names), None, None
                if errors[i] is None:
                    try:
                        facts, digest = facts_of(path, length)
                        s = round(facts["frames"] / facts["rate"], 3)
                        if s > max_s:
                            errors[i] = f"{s / 60:.1f} minutes long; the limit is {max_s / 60:.0f}"
                    except WavError as e:
                        errors[i] = f"can't be decoded: {e}"
                    except (OSError, pa.ArrowException) as e:
                        errors[i] = f"can't be opened: {str(e)[:200]}"
                told.append(facts)
                seconds.append(s)
                digests.append(digest)
            rest = [c for c in batch.schema.names if c != "error"]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            made = [pa.array([f[c] for f in told], kind) for c, kind in zip(names, kinds, strict=True)]
            columns = [*[batch[c] for c in rest], pa.array(digests, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string()), *made]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "sha256", "duration_s", "error", *names])

    return run


def facts(
    found: DataFrame, *, rights_confirmed: bool, stem_from_name: bool = False, max_s: float = 600, most_bytes: int = MOST_BYTES, hashes: bool = True
) -> DataFrame:
    """``LISTED`` of (path, length), of a table or a stream: nothing but headers is read, unless digests are asked for."""
    prepare(found.sparkSession)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    error = (
        F.when(F.lit(not rights_confirmed), "rights are not confirmed")
        .when(~suffix.isin(*SUFFIXES), "not an audio file")
        .when(F.col("length") > most_bytes, "too large")
        .when(~suffix.isin("wav", "wave"), "only WAV is decoded here")
    )
    song = F.element_at(F.split("path", "/"), -2) if stem_from_name else stem
    rows = found.select(song.alias("song_id"), (stem if stem_from_name else F.lit("mix")).alias("stem"), "path", "length", error.alias("error"))
    return rows.mapInArrow(_probed(max_s, hashes), LISTED)


def list_songs(
    spark: SparkSession, path: str, *, rights_confirmed: bool, stem_from_name: bool = False, max_s: float = 600, most_bytes: int = MOST_BYTES, hashes: bool = True
) -> DataFrame:
    """song_id, stem, path, length, sha256, duration_s, ``error`` (null if the file can be taken), and where which samples lie, of each file.

    With ``stem_from_name`` a file is <song>/<stem>.wav, else a whole mix. A file
    that is damaged, too long or too large has a row that says so, and none of the
    others suffers; one without a single byte has none, as Spark's listing leaves
    it out.
    """
    return facts(files.listed(spark, path), rights_confirmed=rights_confirmed, stem_from_name=stem_from_name, max_s=max_s, most_bytes=most_bytes, hashes=hashes)


def _read(rate: int):
    """The blocks of ranges of files, a block at a time."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, place = files.store_of(r["path"])
                step, total = r["channels"] * r["bits"] // 8, dsp.resampled_length(r["frames"], r["rate"], rate)
                with store.open_input_file(place) as file:
                    for k in range(r["first"], r["first"] + r["blocks"]):
                        first, last = k * BLOCK, min((k + 1) * BLOCK, total)
                        low, high = dsp.samples_needed(first, last, r["frames"], r["rate"], rate)
                        file.seek(r["at"] + low * step)
                        body = file.read((high - low) * step)
                        if len(body) != (high - low) * step:
                            raise WavError(f"{r['path']} has become shorter while it was read")
                        x = samples(body, r["tag"], r["bits"], r["channels"])[[0, min(1, r["channels"] - 1)]]
                        yield _batch(r["song_id"], r["stem"], rate, k, total, *dsp.resampled_part(x, low, first, last, r["rate"], rate))

    return run


def read_songs(
    spark: SparkSession, path: str, *, rights_confirmed: bool, rate: int = 44100, max_s: float = 600, stem_from_name: bool = False, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """Blocks of every file that can be taken, at one rate; ``list_songs`` says why others can't."""
    songs = list_songs(spark, path, rights_confirmed=rights_confirmed, stem_from_name=stem_from_name, max_s=max_s, most_bytes=most_bytes, hashes=False)
    blocks = F.greatest(F.ceil(F.rint(F.col("frames") * rate / F.col("rate")) / BLOCK), F.lit(1)).cast("int")
    ranges = songs.where("error is null").withColumn("_blocks", blocks)
    ranges = ranges.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1, F.lit(RANGE_BLOCKS))))
    ranges = ranges.withColumn("blocks", F.least(F.lit(RANGE_BLOCKS), F.col("_blocks") - F.col("first")))
    # By sizes of the listing alone: ranges are small rows, which the adaptive plan would put together in one task.
    told = files.listed(spark, path).agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, math.ceil(told / TASK_BYTES)))
    return ranges.select("song_id", "stem", "path", "tag", "channels", "rate", "bits", "at", "frames", "first", "blocks").repartition(tasks).mapInArrow(_read(rate), BLOCKS)


def _parts(bits: int):
    def run(batches):
        for batch in batches:
            facts = [batch[c].to_pylist() for c in ("file", "block_idx", "total", "rate")]
            for i, (file, k, total, rate) in enumerate(zip(*facts, strict=True)):
                body = pcm(np.stack([batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("left", "right")]), bits)
                head = head_of(total, 2, rate, bits)
                content = head + body if k == 0 else body
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([len(head) + total * 2 * bits // 8]), pa.array([content], pa.binary())], names=["file", "part", "size", "content"])

    return run


def write_songs(blocks: DataFrame, folder: str, *, bits: int = 24) -> None:
    """Write blocks with a column ``file`` to WAV files of stereo; a file whose blocks don't add up to its ``total`` is an error."""
    prepare(blocks.sparkSession)
    parts = blocks.select("file", "block_idx", "total", "rate", "left", "right").mapInArrow(_parts(bits), "file string, part long, size long, content binary")
    files.write_parts(parts, folder)
