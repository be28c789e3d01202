"""The job table and the inbox as streams: order, refusals, replays and restarts."""

import datetime
import random
import shutil

import numpy as np
import pytest

from tessella.sources import wav
from tessella.streaming import inbox, job_table

T0 = datetime.datetime(2024, 1, 1)


def event(job, at, kind, **more):
    full = {"name": None, "mode": None, "stage": None, "status": None, "error": None, "options": None, "facts": None} | more
    return (job, T0 + datetime.timedelta(seconds=at), at, kind, *(full[c] for c in ("name", "mode", "stage", "status", "error", "options", "facts")))


def test_requests_in_order(spark, tmp_path):
    table = job_table.JobTable(spark, str(tmp_path / "jobs"))
    sink = table.sink()

    def send(number, *events):
        sink(spark.createDataFrame(list(events), job_table.EVENTS).repartition(3), number)

    send(0, event("a", 2, "continue", mode="kit"), event("a", 1, "submit", name="song", mode="split", options={"fast": "1", "format": "wav"}), event(None, 3, "submit"), event("x", 4, "delete"))
    assert {(r.job, r.seq): r.code for r in table.answers().collect()} == {("a", 1): 200, ("a", 2): 409, (None, 3): 404, ("x", 4): 404}
    send(1, event("a", 5, "start"), event("a", 6, "delete"), event("a", 7, "mark", stage="ingest"), event("a", 8, "finish", facts={"bpm": "120"}), event("b", 9, "submit", name="other"), event("a", 10, "submit"))
    [a] = table.jobs().where("job = 'a'").collect()
    assert (a.status, a.mode, a.stages, a.facts, a.started) == ("done", "split", {"ingest": "done"}, {"bpm": "120"}, T0 + datetime.timedelta(seconds=5))
    send(2, event("a", 11, "continue", mode="kit", options={"format": "mp3", "pads": "16"}), event("b", 12, "start"), event("b", 13, "finish", error="broken"), event("b", 14, "delete"), event("b", 15, "mark"), event("c", 16, "dance"), event("b", 17, "submit", name="again"))
    [a] = table.jobs().where("job = 'a'").collect()
    assert (a.status, a.mode, a.stages, a.started, a.options) == ("queued", "kit", {}, None, {"fast": "1", "format": "mp3", "pads": "16"})
    assert [r.name for r in table.jobs().where("job = 'b'").collect()] == ["again"]
    codes = {r.seq: r.code for r in table.answers().collect()}
    assert [codes[i] for i in (6, 10, 11, 13, 14, 15, 16, 17)] == [409, 409, 200, 200, 200, 404, 404, 200]


def rows_of(table):
    return sorted(map(repr, table.jobs(deleted=False).collect())), sorted(map(repr, table.answers().collect()))


def test_replayed_batches_change_nothing(spark, tmp_path):
    rng = random.Random(1)
    kinds = ["submit", "continue", "delete", "start", "finish", "mark", "update"]
    batches = [[event(rng.choice("abcde"), 100 * b + i, rng.choice(kinds), name=f"n{b}", stage=rng.choice(["ingest", "pick"]), options={rng.choice("xyz"): str(i)}, facts={rng.choice("uv"): str(b)}) for i in range(12)] for b in range(7)]
    table = job_table.JobTable(spark, str(tmp_path / "jobs"), every=3)
    state, answers = {}, []
    for number, events in enumerate(batches):
        for _ in range(2 if number % 2 else 1):  # every other batch comes twice
            table.sink()(spark.createDataFrame(events, job_table.EVENTS), number)
        for e in sorted((dict(zip([c.split()[0] for c in job_table.EVENTS.split(", ")], e, strict=True)) for e in events), key=lambda e: e["seq"]):
            state[e["job"]], code, _ = job_table.step(state.get(e["job"]), e)
            answers.append((e["seq"], code))
    want = sorted((r["job"], r["status"], sorted(r["options"].items()), sorted(r["stages"].items()), sorted(r["facts"].items())) for r in state.values() if r and not r["gone"])
    got = sorted((r.job, r.status, sorted(r.options.items()), sorted(r.stages.items()), sorted(r.facts.items())) for r in table.jobs().collect())
    assert got == want and sorted((r.seq, r.code) for r in table.answers().collect()) == sorted(answers)
    before = rows_of(table)
    table.sink()(spark.createDataFrame(batches[6], job_table.EVENTS), 6)
    assert rows_of(table) == before
    # What was put together has replaced the first batches.
    assert table._numbers("whole") == [3, 6] and min(table._numbers("changes")) == 4


def test_a_stream_of_requests(spark, tmp_path):
    table = job_table.JobTable(spark, str(tmp_path / "jobs"))
    source = tmp_path / "requests"

    def run():
        stream = spark.readStream.schema(job_table.EVENTS).json(str(source))
        query = stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    spark.createDataFrame([event("a", 1, "submit", name="one"), event("a", 2, "start")], job_table.EVENTS).write.json(str(source))
    run()
    assert [r.status for r in table.jobs().collect()] == ["running"]
    spark.createDataFrame([event("a", 3, "finish")], job_table.EVENTS).write.mode("append").json(str(source))
    run()
    run()
    assert [r.status for r in table.jobs().collect()] == ["done"] and table.answers().count() == 3


@pytest.mark.parametrize("within", ["1 day", "1 second"])
def test_a_file_that_comes_twice_is_one_song(spark, tmp_path, within):
    box, table, check = tmp_path / "in", str(tmp_path / "songs"), str(tmp_path / "check")
    box.mkdir()

    def sound(seed):
        return wav.encode(np.random.default_rng(seed).standard_normal((2, 500)) * 0.1, 44100, 16)

    def run():
        inbox.take_in(spark, str(box), table, check, rights_confirmed=True, within=within).awaitTermination(120)
        return sorted(r.song_id for r in inbox.songs(spark, table).where("error is null").collect())

    assert inbox.songs(spark, table).count() == 0
    (box / "one.wav").write_bytes(sound(1))
    (box / "one again.wav").write_bytes(sound(1))
    (box / "two.wav").write_bytes(sound(2))
    (box / "bad.wav").write_bytes(b"no sound")
    first = run()
    assert len(first) == 2 and "two" in first
    (box / "late copy.wav").write_bytes(sound(2))
    (box / "three.wav").write_bytes(sound(3))
    assert run() == sorted([*first, "three"])
    assert run() == sorted([*first, "three"])
    assert [r.song_id for r in inbox.songs(spark, table).where("error is not null").collect()] == ["bad"]
    # A batch whose offsets weren't committed is run again.
    shutil.rmtree(f"{check}/commits")
    assert run() == sorted([*first, "three"])
