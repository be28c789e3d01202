"""Kit documents, zips, exports, views and job records."""

import json
import zipfile

from pyspark.sql import functions as F

from tessella.plans import export, views
from tessella.sources import kits

DOC = {
    "schema_version": 1, "kit_name": "Song Kit", "analysis": {"bpm": 92.04, "key_short": "Fmin", "duration_s": None},
    "pads": [{"pad": i + 1, "bank": "A", "midi_note": 36 + i, "slice_id": None if i == 5 else f"drums-{i:04d}"} for i in range(16)],
    "slices": [{"id": f"drums-{i:04d}", "stem": "drums", "label": f"Kick {i} (a)", "file": f"slices/k{i}.wav", "source_start_s": 0.0, "source_end_s": 1.0 + i, "score": 0.5} for i in range(19)],
}


def song(df):
    return df.withColumn("song_id", F.lit("one"))


def test_documents_and_zips(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "kit.json").write_text(json.dumps(DOC))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "kit.json").write_text('{"pads": 3}')
    (tmp_path / "a" / "b" / "old" / "x").mkdir(parents=True)
    (tmp_path / "a" / "b" / "old" / "x" / "kit.json").write_text(json.dumps(DOC))  # a nearer one counts
    found = kits.read_kit_files(spark, str(tmp_path))
    assert sorted((r.kit is None) for r in found.collect()) == [False, True]
    good = found.where("kit is not null")
    assert kits.pads_of(good).count() == 16 and kits.slices_of(good).count() == 19
    with zipfile.ZipFile(tmp_path / "kit.zip", "w") as z:
        for name in ("__MACOSX/kit.json", "deep/down/kit.json", "kit/kit.json"):
            z.writestr(name, json.dumps(DOC | {"kit_name": name}))
        z.writestr("kit/slices/k0.wav", b"abc")
    read, files = kits.read_kit_zips(spark, str(tmp_path))
    assert read.first().kit.kit_name == "kit/kit.json" and [(r.file, bytes(r.content)) for r in files.collect()] == [("slices/k0.wav", b"abc")]
    zipped = kits.zip_files(spark.createDataFrame([("one", "b.wav", b"2"), ("one", "a.wav", b"1")], "song_id string, file string, content binary")).first()
    (tmp_path / "out.zip").write_bytes(zipped.content)
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.namelist() == ["a.wav", "b.wav"] and z.read("b.wav") == b"2" and z.getinfo("a.wav").compress_type == zipfile.ZIP_STORED


def test_export_and_views(spark, tmp_path):
    (tmp_path / "kit.json").write_text(json.dumps(DOC))
    good = kits.read_kit_files(spark, str(tmp_path))
    pads, slices = song(kits.pads_of(good)), song(kits.slices_of(good))
    plan = export.export_plan(pads, slices, extras=True)
    paths = {r.pad: r.path for r in plan.collect() if r.pad}
    assert [paths[i] for i in (1, 4, 13, 16)] == ["Bank_A/13_Kick_0_a.wav", "Bank_A/16_Kick_3_a.wav", "Bank_A/01_Kick_12_a.wav", "Bank_A/04_Kick_15_a.wav"]
    assert paths[6] == "Bank_A/10_Empty.wav" and {r.path for r in plan.where("pad is null").collect()} == {f"Extras/Kick_{i}_a.wav" for i in (5, 16, 17, 18)}
    text = export.pad_maps(plan, slices).first()["map"].split("\n")
    assert len(text) == 4 and text[0].startswith("  01 Kick 12 (a)") and text[3][26:].startswith(" | 14 Kick 1 (a) ") and "10 (empty)" in text[2]
    lines = {r.pad: r.line for r in export.summary_lines(pads, slices).collect()}
    assert lines[6] == " 6  (empty)" and lines[1].split() == ["1", "Kick", "0", "(a)", "1.00", "s", "0.50"]
    name = spark.range(1).select(export.folder_name(F.lit("Song (x) Kit"), F.lit(92.04), F.lit("Fmin")).alias("n")).first().n
    assert name == "Song x Kit - 92bpm Fmin"
    lanes = views.lanes(slices, pads).orderBy("place").collect()
    assert lanes[0].id == "drums-0018" and lanes[-1].on_pads == [1] and lanes[0].on_pads is None
    facts = spark.createDataFrame([("one", None)], "song_id string, duration_s double")
    assert views.durations(facts, slices).first().duration_s == 19.0
    assert views.bank_page(pads, 0).count() == 16 and views.bank_page(pads, 1).count() == 0


def test_jobs(spark, tmp_path):
    for name, text in (("a", '{"id": "a", "status": "running", "created": 2.0}'), ("b", "{broken"), ("c", '{"id": "c", "status": "done"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "status.json").write_text(text)
    assert {(r.id, r.status) for r in kits.read_jobs(spark, str(tmp_path)).collect()} == {("a", "failed"), ("c", "done")}
    status = spark.createDataFrame([("j", "ingest", "done"), ("j", "separate", "running")], "job string, stage string, status string")
    assert {(r.stage, r.state) for r in views.progress(status, ("ingest", "separate", "pick")).collect()} == {("ingest", "done"), ("separate", "active"), ("pick", "todo")}
    steps = spark.createDataFrame([("j", "a", 10.0), ("j", "b", 20.0), ("k", "a", -90000.0)], "job string, step string, at_s double")
    assert [(r.job, r.step) for r in views.last_steps(steps, 30.0).collect()] == [("j", "b")]
    names = ["analysis.json", "slices/a.wav", "split/x.mp3", "slices/../kit.json", "kit.json", "slices/a.mp3"]
    files = spark.createDataFrame([(n,) for n in names], "f string").where(views.allowed_file(F.col("f")))
    assert [r.f for r in files.collect()] == names[:3]
