"""Kits of synthetic songs, end to end."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import dsp
from tessella.operators import frames as fr
from tessella.plans import analysis, kit, render, separate, songs as song_plans
from tessella.sources import wav
from tests import songs


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    parts = {"one": songs.stems(), "up": songs.stems(up=2, seed=9)}
    folder = tmp_path_factory.mktemp("songs")
    mix, stems = songs.frames_of(spark, parts, str(folder))
    return parts, mix, stems, song_plans.make_kits(mix, stems, config.load(), f"{folder}/stages")


def by_song(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.song_id, []).append(r)
    return out


def test_analysis(made):
    kits = made[3]
    facts = {r.song_id: r for r in kits.analysis.songs.collect()}
    assert all(abs(r.bpm - 120) < 0.5 and abs(r.duration_s - 32) < 0.01 for r in facts.values())
    assert facts["one"].key == "F minor" and facts["one"].key_short == "Fmin"
    assert facts["up"].key == "G minor"
    beats = sorted(r.t_s for r in by_song(kits.analysis.beats)["one"])
    assert np.allclose(np.diff(beats), 0.5, atol=0.03)
    down = np.array(sorted(r.t_s for r in by_song(kits.analysis.downbeats)["one"]))
    assert np.allclose(np.diff(down), 2, atol=0.05) and (np.abs(down / 2 - np.round(down / 2)) * 2 < 0.06).all()
    sections = sorted(by_song(kits.analysis.sections)["one"], key=lambda r: r.idx)
    assert sections[0].start_s == 0 and abs(sections[-1].end_s - 32) < 0.1


def test_candidates_and_scores(made):
    rows = made[3].candidates.toPandas()
    one = rows[rows.song_id == "one"]
    assert set(one.stem) == {"drums", "bass", "other", "vocals"}
    assert {"kick", "snare", "hat", "drum_loop"} <= set(one[one.stem == "drums"].category)
    loops = one[one.category == "drum_loop"]
    assert ((loops.end - loops.start - loops.bars * 4 * 0.5 * songs.RATE).abs() <= 3 * 50).all()
    assert one.score.between(0, 1).all() and one.ord.is_unique and one.id.is_unique
    assert (one.sort_values("ord").start.groupby(one.stem).apply(lambda s: s.is_monotonic_increasing)).all()
    kicks = one[one.category == "kick"]
    assert kicks.cluster.nunique() < len(kicks) / 3


def test_kit(made):
    _, _, stems, kits = made
    pads = by_song(kits.pads)["one"]
    assert len(pads) == 16 and sorted(p.midi_note for p in pads) == list(range(36, 52))
    ids = [p.slice_id for p in sorted(pads, key=lambda p: p.pad)]
    assert None not in ids and len(set(ids)) == 16
    slices = {r.id: r for r in by_song(kits.slices)["one"]}
    assert [slices[i].stem for i in ids] == ["drums"] * 6 + ["vocals"] * 4 + ["bass"] * 3 + ["other"] * 3
    assert [slices[i].category for i in ids[:3]] == ["kick", "snare", "hat"]
    assert len({r.label for r in slices.values()}) == len(slices)
    assert all(r.file.endswith("_120bpm_Fmin.wav") for r in slices.values())
    notes = {r.note for r in slices.values() if r.category == "bass_note" and r.note}
    assert notes and notes <= {"F2", "Bb2", "C3"}
    document = json.loads({r.song_id: r.kit for r in kits.documents().collect()}["one"])
    assert len(document["pads"]) == 16 and document["analysis"]["key_short"] == "Fmin"
    assert [s["id"] for s in document["slices"]][:16] == ids
    assert kit.pad_slices(kit.swap_pad(kits.pads, "one", 1, None), kits.slices).where("song_id = 'one' and pad = 1 and slice_id is null").count() == 1


def test_render(made, tmp_path):
    _, _, stems, kits = made
    slices = kits.slices.where("song_id = 'one'")
    files = render.render(slices, stems, config.load()).persist()
    facts = {r.file: r for r in slices.collect()}
    for r in files.collect():
        rate, x = wav.decode(bytes(r.content))
        s = facts[r.file]
        assert rate == songs.RATE and abs(20 * np.log10(np.abs(x).max()) + 1) < 0.05
        want = s.end - s.start
        assert x.shape[1] == want if s.kind == "loop" else abs(x.shape[1] - want) <= 0.0041 * rate
        assert np.abs(x[:, 0]).max() < 1e-4
    told = render.write_files(files, tmp_path.as_uri()).collect()
    assert len(told) == len(facts) and {r.path.split("/one/", 1)[1] for r in told} == set(facts)
    assert all((tmp_path / "one" / r.file).read_bytes() == bytes(r.content) for r in files.collect())


def test_split_and_separation(made, spark, tmp_path, monkeypatch):
    _, mix, stems, kits = made
    vocals = stems.where("stem = 'vocals'")
    rest = render.subtract_stem(mix, vocals)
    a, v, i = (df.where("song_id = 'one' and block_idx = 3").first().left for df in (mix, vocals, rest))
    assert np.abs(np.array(v) + np.array(i) - np.array(a)).max() < 1e-5
    told = render.write_split(rest.where("song_id = 'one'"), kits.analysis.songs, (tmp_path / "out").as_uri(), rate=22050, normalise=True).collect()
    assert [r.path.rsplit("/", 2)[1:] for r in told] == [["one", "one_instrumental_120bpm_Fmin.wav"]]
    rate, x = wav.decode((tmp_path / "out" / "one" / "one_instrumental_120bpm_Fmin.wav").read_bytes())
    at_once = np.stack([np.concatenate([np.array(r[c], np.float32) for r in sorted(rest.where("song_id = 'one'").collect(), key=lambda r: r.block_idx)]) for c in ("left", "right")])
    want = dsp.peak_normalised(dsp.resampled(at_once, songs.RATE, 22050), -1.0)
    assert rate == 22050 and x.shape == (2, 32 * 22050) and np.abs(x - want).max() < 2e-6
    with pytest.raises(wav.WavError):
        render.write_split(rest, kits.analysis.songs, tmp_path.as_uri(), format="mp3")
    found = separate.get("quick")(mix.where("song_id = 'one'"))
    total = found.groupBy("block_idx").pivot("stem", ["drums", "bass", "other"]).agg(F.first("left")).join(mix.where("song_id = 'one'"), "block_idx").collect()
    for r in total:
        assert np.abs(np.array(r.drums) + np.array(r.bass) + np.array(r.other) - np.array(r.left)).max() < 1e-5
    drums = np.concatenate([np.array(r.drums) for r in sorted(total, key=lambda r: r.block_idx)])
    true = made[0]["one"]
    hz = np.fft.rfftfreq(len(drums), 1 / songs.RATE)
    high = [np.square(np.abs(np.fft.rfft(x)))[hz > 4000].sum() for x in (drums, true["drums"])]
    assert 0.5 < high[0] / high[1] < 1.5  # hats and snares
    bass = np.concatenate([np.array(r.bass) for r in sorted(total, key=lambda r: r.block_idx)])
    power = np.square(np.abs(np.fft.rfft(bass)))
    assert power[hz < 260].sum() > 0.95 * power.sum()
    # Blocks with their neighbours' edges give what the whole song in one block gives.
    monkeypatch.setattr(wav, "BLOCK", 1 << 21)
    whole, _ = songs.frames_of(spark, {"one": true}, str(tmp_path))
    at_once = np.array(separate.get("quick")(whole).where("stem = 'drums'").first().left)
    assert np.abs(at_once - drums).max() < 1e-4
    with pytest.raises(KeyError):
        separate.get("nothing")


def test_short_and_silent_songs(spark, tmp_path):
    parts = {"quiet": {"drums": np.zeros(44100), "bass": np.zeros(44100)}, "short": {"drums": songs.kick(), "bass": songs.kick() * 0}}
    mix, stems = songs.frames_of(spark, parts, str(tmp_path))
    kits = song_plans.make_kits(mix, stems, config.load(), str(tmp_path / "stages"))
    facts = {r.song_id: r for r in kits.analysis.songs.collect()}
    assert facts["quiet"].bpm == 120 and facts["quiet"].key is None
    assert [(r.label, r.start_s, r.end_s) for r in kits.analysis.sections.where("song_id = 'quiet'").collect()] == [("A", 0.0, 1.0)]
    assert kits.pads.where("song_id = 'quiet' and slice_id is not null").count() == 0
    assert fr.features(mix).where("song_id = 'short'").count() == len(songs.kick()) // 512 + 1
    assert analysis.song_facts(mix).count() == 2
