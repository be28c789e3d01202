"""Every query with SQL against DuckDB on the smallest tables, and the operators' laws."""

import datetime
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import config, kit_queries, queries  # noqa: F401
from tessella.functions import labels, signal
from tessella.operators import clusters, intervals, ranking
from tessella.plans import jobs, separate
from tessella.streaming import progress

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sql, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), sql.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_leaders_against_a_loop(spark):
    found = queries.clustered(spark, DATA).toPandas()
    raw = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    import numpy as np

    raw["song"] = raw.vec_id // 400
    for (song, stem), group in raw.groupby(["song", "label"]):
        kept, want = [], {}
        for r in group.assign(p=-(group.vec_id % 7)).sort_values(["p", "vec_id"]).itertuples():
            v = np.asarray(r.embedding, float)
            near = [max(0, 1 - np.linalg.norm(v - k) / (0.5 * (np.linalg.norm(v) + np.linalg.norm(k)) + 1e-10)) for k in kept]
            if near and max(near) >= 0.3:
                want[r.vec_id] = int(np.argmax(near))
            else:
                want[r.vec_id] = len(kept)
                kept.append(v)
        got = found[(found.song == song) & (found.stem == str(stem))].set_index("ord")["leader"].to_dict()
        assert got == want
    numbered = clusters.numbered(queries.clustered(spark, DATA), group=["stem"], by=["song"], ties="ord").toPandas()
    for _, own in numbered.groupby("song"):
        firsts = own.groupby("stem").agg(first=("ord", "min"), low=("cluster", "min")).sort_values("first")
        assert firsts.low.is_monotonic_increasing and own.cluster.nunique() == own.cluster.max() + 1


def test_deal_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice("abc"), rng.randint(0, 5) / 10, i) for g in "xyz" for i in range(rng.randint(0, 14))]
    df = spark.createDataFrame(rows, "g string, q string, score double, ord int")
    got = ranking.deal(df, group=["g"], queue="q", queue_order="q", score="score", ties="ord", count=7).collect()
    for g in "xyz":
        queues = {q: sorted((r for r in rows if r[0] == g and r[1] == q), key=lambda r: (-r[2], r[3])) for q in "abc"}
        want = []
        while any(queues.values()) and len(want) < 7:
            for q in "abc":
                if queues[q] and len(want) < 7:
                    want.append(queues[q].pop(0)[3])
        assert [r.ord for r in sorted((r for r in got if r.g == g), key=lambda r: r.deal_rank)] == want


def test_interval_and_as_of_joins(spark):
    rng = random.Random(2)
    points = [(i, rng.randrange(2), rng.randrange(500)) for i in range(200)]
    spans = [(i, rng.randrange(2), a, a + rng.randrange(0, 90)) for i in range(40) for a in [rng.randrange(480)]]
    p, s = spark.createDataFrame(points, "id int, k int, t int"), spark.createDataFrame(spans, "sid int, k int, a int, b int")
    want = {(i, j) for i, k, t in points for j, kk, a, b in spans if k == kk and a <= t < b}
    got = intervals.interval_join(p, s, point="t", start="a", end="b", width=37, keys=["k"])
    assert sorted((r.id, r.sid) for r in got.collect()) == sorted(want)
    semi = intervals.interval_join(p, s, point="t", start="a", end="b", width=37, keys=["k"], how="left_semi")
    assert sorted(r.id for r in semi.collect()) == sorted({i for i, _ in want})
    back = intervals.as_of(p, s, keys=["k"], at="t", right_at="a", value="sid", ties="sid").collect()
    for r in back:
        before = [(a, j) for j, k, a, b in spans if k == r.k and a <= r.t]
        assert r.sid == (max(before)[1] if before else None)


def test_labels(spark):
    one = spark.range(1)
    got = one.select(
        labels.clock(F.lit(125.9)).alias("clock"), labels.upload_name(F.lit("My: song (1).WAV")).alias("upload"), labels.note_name(F.lit(440.0)).alias("a"),
        labels.slice_label(F.lit("other"), F.lit("one_shot"), F.lit("stab"), F.lit(2), F.lit(None).cast("double"), F.lit("Fmin")).alias("stab"),
        labels.slice_file(F.lit("bass"), F.lit("loop"), F.lit("bass_loop"), F.lit(28), F.lit(2.0), F.lit(None).cast("string"), F.lit("_92bpm")).alias("loop"),
        labels.file_number(F.lit(0)).alias("first"), labels.file_number(F.lit(12)).alias("top"), labels.file_number(F.lit(3), top_first=False).alias("bottom"),
    ).first()
    assert tuple(got) == ("2:05", "My_ song (1).wav", "A4", "Other stab 2 Fmin", "Bass_Loop_AB_2bar_92bpm", 13, 1, 4)
    x = one.select(F.array(*[F.lit(v).cast("float") for v in (1, 1, 1, 1, 1, 1)]).alias("x"))
    faded = x.select(signal.apply_fades("x", 3, 2).alias("y"), signal.fit_length("x", F.lit(8)).alias("z"), signal.array_rms("x").alias("r")).first()
    assert faded.y == [0, 0.5, 1, 1, 1, 0] and faded.z == [1] * 6 + [0, 0] and abs(faded.r - 1) < 1e-9


def test_config():
    cfg = config.load()
    assert cfg["kit"]["pad_split"] == {"drums": 6, "vocals": 4, "bass": 3, "other": 3}
    changed = config.load('[kit]\npad_split = {drums = 16}\n[split]\nfast = true')
    assert changed["kit"]["pad_split"] == {"drums": 16} and changed["kit"]["backups_per_stem"] == 20 and config.DEFAULTS["split"]["fast"] is False
    for bad in ({"kit": {"pad_count": 32}}, {"split": {"format": "ogg"}}, {"split": {"bit_depth": 8}}, {"kit": {"pad_split": {"drums": 17, "bass": -1}}}):
        with pytest.raises(config.ConfigError):
            config.load(overrides=bad)


def test_jobs_and_separation_plan(spark):
    log = [("one", "ingest", 1, "done"), ("one", "separate", 2, "done"), ("one", "analyze", 3, "failed"), ("two", "ingest", 1, "running"), ("two", "ingest", 2, "done")]
    latest = jobs.latest_status(spark.createDataFrame(log, "song_id string, stage string, at int, status string"), by=["song_id", "stage"], order=["at"], value="status")
    todo = {(r.song_id, r.stage) for r in jobs.todo(latest, "kit").collect()}
    assert todo == {("one", s) for s in ("analyze", "pick", "render")} | {("two", s) for s in ("separate", "analyze", "pick", "render")}
    assert {r.stage for r in jobs.invalidate_from(latest.where("song_id = 'one'"), "separate").collect()} == {"ingest"}
    changes = spark.createDataFrame([("two", "ingest", "failed")], "song_id string, stage string, status string")
    assert jobs.upsert(latest, changes, ["song_id", "stage"]).where("song_id = 'two'").first().status == "failed"
    p = separate.plan("split")
    assert p.vocal_model and p.stems_on is None
    assert separate.plan("kit", pair_source="vocal_model", pair_exists=True).stems_on == "instrumental"
    assert separate.plan("split", fast=True, include_stems=True) == separate.Plan(False, True, None)
    assert separate.satisfied("kit", stems_from="mix", stems_exist=True) and not separate.satisfied("kit", hq_vocals=True, stems_from="mix", stems_exist=True)


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    got = run(progress.levels(stream, late="100 days"), "levels", "update").groupBy("event_type").agg(F.sum("n").alias("n")).collect()
    assert {r.event_type: r.n for r in got} == {r.event_type: r["count"] for r in e.groupBy("event_type").count().collect()}
    runs = progress.sounding(e)
    assert runs.agg(F.sum("n")).first()[0] == e.count()
    log = [("j", s, st, datetime.datetime(2024, 1, 1, 0, i)) for i, (s, st) in enumerate([("ingest", "done"), ("separate", "done"), ("ingest", "running"), ("ingest", "done")])]
    spark.createDataFrame(log, "job string, stage string, status string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "log"))
    jobs_log = spark.readStream.schema("job string, stage string, status string, at timestamp").parquet(str(tmp_path / "log"))
    r = run(progress.job_progress(jobs_log), "progress", "update").first()
    assert (r.job, r.next_stage, r.n_done, r.failed) == ("j", "separate", 1, False)
