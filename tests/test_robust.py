"""Damaged inputs, broken-off runs, large groups and long windows."""

import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import queries
from tessella.functions import labels
from tessella.operators import frames as fr
from tessella.operators import grids, ranking
from tessella.plans import candidates, export, jobs, songs
from tessella.sources import wav


def tone(seconds, rate=8000, hz=220):
    return np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)[None]


def test_a_bad_file_has_a_row_and_hurts_no_other(spark, tmp_path):
    good = wav.encode(tone(1), 8000, 16)
    files = {"good.wav": good, "cut.wav": good[:30], "empty.wav": b"", "none.wav": b"RIFFxxxxJUNK", "odd.wav": good[:34] + b"\x07\x00" + good[36:], "long.wav": wav.encode(tone(5), 8000, 16)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    listed = {r.path.rsplit("/", 1)[1]: r for r in wav.list_songs(spark, str(tmp_path), rights_confirmed=True, max_s=3).collect()}
    assert listed["good.wav"].error is None and listed["good.wav"].duration_s == 1.0 and listed["good.wav"].rate == 8000
    assert all("can't be decoded" in listed[n].error for n in ("cut.wav", "none.wav", "odd.wav"))
    assert "empty.wav" not in listed  # Spark's reader has no row for a file without bytes
    assert "the limit is" in listed["long.wav"].error and listed["long.wav"].duration_s == 5.0
    found = wav.read_songs(spark, str(tmp_path), rights_confirmed=True, rate=8000, max_s=3).select("song_id", "total").collect()
    assert [tuple(r) for r in found] == [("good", 8000)]
    assert wav.decode(wav.encode(wav.silence(48000), 48000))[1].shape == (2, 2400)


def test_stages_that_were_broken_off_or_set_otherwise_run_again(spark, tmp_path):
    folder = str(tmp_path / "stages")
    keep = songs.keeper(spark, folder, "a")
    assert keep(spark.range(10), "x").count() == 10
    assert keep(spark.range(99), "x").count() == 10  # what is there is read
    assert songs.keeper(spark, folder, "b")(spark.range(7), "x").count() == 7
    [kept] = [p for p in (tmp_path / "stages").iterdir() if spark.read.parquet(f"{p}/x").count() == 10]
    os.remove(kept / "x" / "_SUCCESS")
    for part in (kept / "x").glob("part-*"):
        os.remove(part)
    assert keep(spark.range(12), "x").count() == 12
    shutil.rmtree(folder)


def name_of(n):
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def test_letters_of_any_number(spark):
    some = [0, -3, 1, 26, 27, 702, 703, 18278, 18279, 10**9, 2**40]
    df = spark.createDataFrame([(n,) for n in some] + [(None,)], "n long")
    assert {r.n: r.x for r in df.select("n", labels.letters("n").alias("x")).collect()} == {**{n: name_of(n) for n in some}, None: None}


def test_loops_beyond_two_letters(spark, tmp_path):
    """The 703rd loop of a brand and those after it have three letters, as in the reference; q35's SQL has a sign and a letter there."""
    spark.range(1, 731).selectExpr("id AS p_partkey", "'b' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: (r.label, r.file) for r in queries.q35_slice_labels(spark, str(tmp_path)).collect()}
    assert got == {n: (f"Drum loop {name_of(n)} (2 bar)", f"Drums_Loop_{name_of(n)}_2bar_120bpm_Fmin") for n in range(1, 731)}
    assert got[702][0] == "Drum loop ZZ (2 bar)" and got[703][0] == "Drum loop AAA (2 bar)"


@pytest.mark.parametrize("by", [["g"], []])
def test_block_rank_is_a_rank(spark, by):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else None, int(rng.integers(0, 50)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(5)
    got = ranking.block_rank(df, "k", by=by, block=F.floor(F.col("t") / 10), order=["t", "i"]).toPandas()
    want = ranking.stable_rank(df, "k", by, ["t", "i"]).toPandas()
    assert got.sort_values("i").k.tolist() == want.sort_values("i").k.tolist() and list(got.columns) == ["g", "t", "i", "k"]


def test_windows_over_chunks_see_all_neighbours(spark):
    df = spark.range(1, 101).withColumn("x", (F.col("id") * 7) % 31)
    spread = ranking.with_halo(df, index="id", size=16, halo=3)
    w = Window.partitionBy("chunk").orderBy("id").rowsBetween(-3, 3)
    got = {r.id: r.s for r in spread.withColumn("s", F.sum("x").over(w)).where("own").collect()}
    x = {i: i * 7 % 31 for i in range(1, 101)}
    assert got == {i: sum(x.get(j, 0) for j in range(i - 3, i + 4)) for i in x}


def test_prefix_energy_by_blocks(spark):
    df = spark.range(1, 60).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("e"), F.floor(F.col("id") / 9).alias("b"), F.lit("s").alias("g"))
    plain = grids.prefix_energy(df, by=["g"], order="i", energy="e").select("i", "before", "until")
    blocks = grids.prefix_energy(df, by=["g"], order="i", energy="e", block="b").select("i", "before", "until")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blocks.collect()))


def test_windows_get_the_blocks_that_they_reach_and_no_others(spark):
    size = 100
    blocks = spark.range(50).select(F.lit("s").alias("song_id"), F.lit("d").alias("stem"), F.col("id").cast("int").alias("block_idx"), (F.col("id") * size).alias("start_sample"), F.sequence(F.col("id") * size, F.col("id") * size + size - 1).alias("x"))
    windows = [(int(a), int(a + n)) for a, n in ((0, 10), (95, 30), (130, 350), (4990, 10), (250, 0))]
    df = spark.createDataFrame([("s", "d", a, b) for a, b in windows], "song_id string, stem string, start long, end long")

    def run(key, w, b):
        base, x = fr.put_together(b, "x")
        return pd.DataFrame({"start": w["start"], "end": w["end"], "n": len(b), "good": [bool((x[s - base : e - base] == np.arange(s, e)).all() and e - base <= len(x)) for s, e in zip(w["start"], w["end"], strict=True)]})

    got = fr.with_audio(df, blocks, run, "start long, end long, n int, good boolean", margin=5, size=size).collect()
    assert len(got) == 5 and all(r.good and r.n <= 6 for r in got)


def test_measures_of_a_window_against_plain_sums():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(5000)
    levels = candidates.Loudness(x)
    env = levels.envelope(100, 3000)
    assert np.allclose(env, [np.sqrt((x[a : a + 512] ** 2).mean()) for a in range(100, 3000 - 511, 256)])
    assert np.isclose(levels.power(7, 4000), (x[7:4000] ** 2).mean()) and levels.rms(5, 5) == 0
    assert np.allclose(candidates.beat_levels(env, 3.0), [p.mean() for p in np.array_split(env, 3)])
    assert len(candidates.beat_levels(env, float("nan"))) == 4 and len(candidates.beat_levels(env[:2], 8.0)) == 2
    hit = np.concatenate((np.ones(700), np.full(5000, 1e-4)))
    assert candidates.trimmed(hit, 50) == (700 // 256 + 2) * 256 and candidates.trimmed(hit[:300], 50) == 300
    assert candidates.trimmed(np.zeros(1000), 50) == 1000


def test_changed_sources_and_forced_jobs_lose_their_stages(spark):
    stages = spark.createDataFrame([(s, "ingest", "done") for s in "abcd"], "song_id string, stage string, status string")
    before = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "song_id string, source string")
    now = spark.createDataFrame([("a", "x", False), ("b", "y", False), ("c", "x", True), ("d", "z", False)], "song_id string, source string, force boolean")
    assert sorted(r.song_id for r in jobs.still_valid(stages, before, now).collect()) == ["a", "d"]


def test_export_has_every_file(spark):
    plan = spark.createDataFrame([("s", "Bank_A/01_Kick.wav", "k"), ("s", "Bank_A/02_Empty.wav", None)], "song_id string, path string, slice_id string")
    sound = spark.createDataFrame([("s", "k", bytearray(wav.encode(np.vstack([tone(0.5)] * 2), 8000, 24)))], "song_id string, id string, content binary")
    texts = spark.createDataFrame([("s", "One\ntwo ö\n")], "song_id string, text string")
    got = {r.file: bytes(r.content) for r in export.export_files(plan, sound, texts, rate=16000).collect()}
    assert set(got) == {"Bank_A/01_Kick.wav", "Bank_A/02_Empty.wav", "README.txt"}
    rate, x = wav.decode(got["Bank_A/01_Kick.wav"])
    assert rate == 16000 and x.shape == (2, 8000)
    assert wav.decode(got["Bank_A/02_Empty.wav"])[1].shape == (2, 800)
    assert got["README.txt"].decode() == "One\ntwo ö\n"


def test_readme(spark):
    slices = spark.createDataFrame([("s", "k", "Kick 1", 1), ("s", "v", "A label that is longer than a cell has room for", 2)], "song_id string, id string, label string, kept_ord int")
    pads = spark.createDataFrame([("s", i, "k" if i == 1 else "v" if i == 18 else None) for i in range(1, 33)] + [("none", 1, None)], "song_id string, pad int, slice_id string")
    facts = spark.createDataFrame([("s", "My song Kit", 120.04, "F minor"), ("none", "ö", None, None)], "song_id string, kit_name string, bpm double, key string")
    got = {r.song_id: r.text.split("\n") for r in export.readmes(export.export_plan(pads, slices), slices, facts, rate=44100, bits=32).collect()}
    lines = got["s"]
    assert lines[:7] == ["My song Kit", "=" * 11, "", "Tempo: 120.0 BPM    Key: F minor", "Audio: 32-bit float WAV, 44.1 kHz, stereo", "Pad order: top row first (file 01 is the top-left pad)", ""]
    empty = [f"{n:02d} (empty)".ljust(24) for n in range(1, 17)]
    assert lines[7:9] == ["Bank A (as laid out on the pads):", ""] and lines[9] == "  " + " | ".join(empty[:4])
    assert lines[12] == "  " + " | ".join(["13 Kick 1".ljust(24), *empty[13:]]) and lines[13] == ""
    assert lines[14].startswith("Bank B") and lines[19] == "  " + " | ".join([empty[12], "14 A label that is longer than a cell"[:24], *empty[14:]])
    assert lines[20] == "" and lines[21] == "How to load it" and lines[-1] == ""
    assert got["none"][:2] == ["ö", "="] and got["none"][3] == "Tempo: unknown    Key: unknown" and got["none"][12].count(" " * 24) == 3
    turned = export.readmes(export.export_plan(pads, slices, top_first=False), slices, facts, top_first=False).where("song_id = 's'").first().text
    assert "01 Kick 1" in turned and "bottom-left" in turned and "24-bit WAV, 48 kHz" in turned


PLAN = "song_id string, mode string, only string, start_at string, force boolean, source string, previous string, satisfied boolean"


def test_run_plans(spark):
    every = ["ingest", "separate", "analyze", "pick", "render"]
    done = {"new": [], "all": every, "some": every[:3], "split": [*every[:3], "split"]}
    status = spark.createDataFrame([(s, x, "done") for s, own in done.items() for x in own] + [("some", "pick", "failed")], "song_id string, stage string, status string")
    cases = [
        (("new", "kit", None, None, False, "a", None, True), [], every, None),
        (("new", "kit", None, None, False, None, None, True), [], [], "no input"),
        (("all", "kit", None, None, False, None, "a", True), [], [], None),
        (("all", "kit", None, None, True, "a", "a", True), every, every, None),
        (("all", "kit", None, None, False, "b", "a", True), every, every, None),
        (("all", "kit", "pick", None, False, None, "a", True), ["pick", "render"], ["pick"], None),
        (("all", "kit", None, "analyze", False, None, "a", True), every[2:], every[2:], None),
        (("all", "kit", None, None, False, None, "a", False), ["separate", "pick", "render"], ["separate", "pick", "render"], None),
        (("all", "split", None, None, False, None, "a", False), ["separate"], ["separate", "split"], None),
        (("some", "kit", "render", None, False, None, "a", True), [], [], "can't run render before pick"),
        (("new", "kit", "pick", None, False, None, None, True), [], [], "can't run pick before ingest, separate, analyze"),
        (("split", "split", "render", None, False, None, "a", True), [], [], "the split mode has no stage render"),
        (("split", "dance", None, None, False, None, "a", True), [], [], "unknown mode dance"),
        (("split", "kit", None, "pick", False, None, "a", False), ["separate", "split"], ["separate", "pick", "render"], None),
    ]
    for request, dropped, stages, error in cases:
        [r] = jobs.run_plans(spark.createDataFrame([request], PLAN), status).collect()
        assert (r.dropped, r.stages, r.error) == (sorted(dropped), stages, error), request


def test_stage_runs_and_options(spark):
    import datetime

    t = [datetime.datetime(2024, 1, 1, 0, 0, k) for k in range(20)]
    rows = [("s", "pick", "running", t[0], None), ("s", "pick", "failed", t[3], "no"), ("s", "pick", "running", t[5], None), ("s", "pick", "done", t[9], None), ("s", "render", "running", t[9], None), ("s", "split", "done", t[4], None), ("s", "ingest", "done", t[1], None), ("s", "ingest", "running", t[2], None)]
    got = {r.stage: (r.status, r.seconds, r.error) for r in jobs.stage_runs(spark.createDataFrame(rows, "song_id string, stage string, status string, at timestamp, error string")).collect()}
    assert got == {"pick": ("done", 4.0, None), "render": ("running", None, None), "split": ("done", None, None), "ingest": ("running", None, None)}
    forms = [(None, None, None, None, None, None, None), ("drums=10,vocals=6", "htdemucs_ft.v-2", "wav", True, False, None, True), ("drums=3", "a/b", "ogg", False, True, True, False), ("drums=8,,vocals=8", " ", "", None, None, None, None), ("x=16,y", "größe", "mp3", None, None, None, None)]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(forms)], "i int, pads string, model string, format string, hq_vocals boolean, fast boolean, normalize boolean, include_stems boolean")
    got = [(r.options, r.errors) for r in jobs.checked_options(df).orderBy("i").collect()]
    assert got[0] == ({}, []) and got[1] == ({"pads": "drums=10,vocals=6", "model": "htdemucs_ft.v-2", "format": "wav", "hq_vocals": "true", "include_stems": "true"}, [])
    assert got[2][1] == ["pad split: 3 pads; there are 16, 32 or 64", "unknown model name", "format must be wav, flac or mp3"]
    assert got[3][1] == ["pad split: expected stem=count, got ''"] and "model" not in got[3][0] and got[4][1] == ["pad split: expected stem=count, got 'y'"]
