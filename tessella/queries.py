"""One query for each relational operator, on the driver's tables, with its SQL.

``events`` stand in for a signal: ``event_type`` is the stem, ``user_id`` the
song, ``value`` the amplitude, in the order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import dsp, labels, scoring, signal
from tessella.operators import clusters, grids, intervals, islands, ranking
from tessella.operators import frames as fr
from tessella.plans import analysis
from tessella.workers import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY_S = 86_400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in seconds since 2024-01-01."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("t_s", (signal.micros("ts") - F.lit(1704067200000000)) / 1e6)


EVENTS = "SELECT *, (epoch_us(ts) - 1704067200000000) / 1e6 AS t_s FROM events"
TIME = ["ts", "event_id"]
#: A stem has very many events; they are ranked day by day, and neighbours are looked at in chunks.
CHUNK = 4096


def indexed(e: DataFrame, name: str = "idx") -> DataFrame:
    """Events with their place in the stem, from 1."""
    return ranking.block_rank(e, name, by=["event_type"], block=F.to_date("ts"), order=TIME)


def chunks(e: DataFrame, halo: int) -> tuple[DataFrame, Window]:
    """Indexed events in chunks with their neighbours, and the window that goes along them."""
    return ranking.with_halo(e, index="idx", size=CHUNK, halo=halo), Window.partitionBy("event_type", "chunk").orderBy("idx")


def signal_blocks(e: DataFrame) -> DataFrame:
    """Events as the song "events" of a stem for each type: blocks of ``CHUNK`` samples in order."""
    prepare(e.sparkSession)
    i = indexed(e).withColumn("at", F.col("idx") - 1)
    total = e.groupBy("event_type").agg(F.count("*").alias("total"))
    x = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"])
    b = i.groupBy("event_type", F.floor(F.col("at") / CHUNK).cast("int").alias("block_idx")).agg(x.alias("left")).join(total, "event_type")
    return b.select(
        F.when(F.col("event_type").isNotNull(), "events").alias("song_id"), F.col("event_type").alias("stem"), "block_idx", (F.col("block_idx") * CHUNK).cast("long").alias("start_sample"),
        F.size("left").alias("n"), "total", F.lit(44100).alias("rate"), "left", F.col("left").alias("right"),
    )


def r(x, n: int = 4):
    return F.round(x, n)


# ------------------------------------------------------------------ sources


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars FROM documents")
def q01_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


@query("""SELECT doc_id, source, length(text)::BIGINT AS n_chars FROM documents d
WHERE length(text) <= 6000 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""")
def q02_ingest_gate(spark, sf_dir):
    """Only rows whose rights are confirmed (labelled, not toxic) and that are not too long."""
    d, ok = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 0")
    d = d.where(F.length("text") <= 6000).join(ok, "doc_id", "left_semi")
    return d.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang
FROM pages WHERE regexp_matches(url, '^https?://[^/]+/(en|de|fr)/')""")
def q03_extension_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[^/]+/(en|de|fr)/"))
    return p.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"))


# ------------------------------------------------------------------ signal primitives


@query("SELECT date_trunc('hour', ts) AS hour, round(avg(value), 8) AS mono FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def q04_mono(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(r(F.avg("value"), 8).alias("mono"))


@query("""SELECT event_type, round(sqrt(avg(value * value) + 1e-10), 4) AS rms,
round(20 * log10(greatest(sqrt(avg(value * value) + 1e-10), 1e-10)), 4) AS level_db, count(*) AS n FROM events GROUP BY 1""")
def q05_rms_decibels(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(r(signal.rms("value")).alias("rms"), r(signal.decibels(signal.rms("value"))).alias("level_db"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT event_type, event_id, ts, value - avg(value) OVER (PARTITION BY event_type) AS x FROM events),
i AS (SELECT event_type, x, row_number() OVER w AS idx, lag(x) OVER w AS before FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
z AS (SELECT event_type, idx FROM i WHERE (x < 0) <> (before < 0)),
w AS (SELECT event_type, unnest([100, 200, 300, 400]) AS target FROM (SELECT DISTINCT event_type FROM events))
SELECT w.event_type, target::BIGINT AS target, coalesce(arg_min(idx, abs(idx - target) * 1000000 + idx), target)::BIGINT AS crossing
FROM w LEFT JOIN z ON z.event_type = w.event_type AND abs(idx - target) <= 20 GROUP BY w.event_type, w.target""")
def q06_zero_crossing(spark, sf_dir):
    """The sign change nearest to each of some places, within 20, else the place; the first of equals. Slices are cut by the same function."""
    e = table(spark, sf_dir, "events")
    means = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    blocks = signal_blocks(e.join(means, "event_type").withColumn("value", F.col("value") - F.col("mean")))
    targets = means.select(F.lit("events").alias("song_id"), F.col("event_type").alias("stem"), F.explode(F.array(*[F.lit(x - 1).cast("long") for x in (100, 200, 300, 400)])).alias("start"))

    def run(key, windows, parts):
        base, x = fr.put_together(parts, "left")
        found = [dsp.nearest_crossing(x, at - base, 20) + base + 1 for at in windows["start"]]
        return pd.DataFrame({"event_type": windows["stem"], "target": windows["start"] + 1, "crossing": found})

    return fr.with_audio(targets.withColumn("end", F.col("start")), blocks, run, "event_type string, target long, crossing long", margin=30, size=CHUNK)


@query("""SELECT event_id, round(CASE WHEN p < 1e-6 THEN value ELSE value * pow(10, -1 / 20.0) / p END, 6) AS normalised
FROM (SELECT event_id, value, max(abs(value)) OVER (PARTITION BY event_type) AS p FROM events)""")
def q07_peak_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    peaks = e.groupBy("event_type").agg(F.max(F.abs("value")).alias("p"))  # a row per stem, joined back
    gain = F.when(F.col("p") < 1e-6, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.lit(-1 / 20.0)) / F.col("p"))
    return e.join(peaks, "event_type").select("event_id", r(F.col("value") * gain, 6).alias("normalised"))


@query("""SELECT event_type, (idx // 4)::BIGINT AS frame, round(level, 4) AS level FROM (
SELECT event_type, row_number() OVER w AS idx, sqrt(avg(value * value) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) + 1e-10) AS level
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE idx % 4 = 0""")
def q08_framed_rms(spark, sf_dir):
    e, w = chunks(indexed(table(spark, sf_dir, "events")), 7)
    level = F.sqrt(F.avg(F.col("value") * F.col("value")).over(w.rowsBetween(-7, 0)) + signal.EPS)
    return e.withColumn("level", level).where("own and idx % 4 = 0").select("event_type", (F.col("idx") / 4).cast("long").alias("frame"), r("level").alias("level"))


FOLD = "SELECT event_type, (floor(value)::BIGINT % 12) AS pc, sum(value) AS energy FROM events GROUP BY 1, 2"


def fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.pmod(F.floor("value").cast("long"), F.lit(12)).alias("pc")).agg(F.sum("value").alias("energy"))


@query(f"SELECT event_type, pc, round(energy / max(energy) OVER (PARTITION BY event_type), 6) AS chroma FROM ({FOLD})")
def q09_chroma_fold(spark, sf_dir):
    return fold(spark, sf_dir).select("event_type", "pc", r(F.col("energy") / F.max("energy").over(Window.partitionBy("event_type")), 6).alias("chroma"))


@query(f"""WITH b AS (SELECT user_id, t_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM ({EVENTS}))
SELECT user_id, round(60 / regr_slope(t_s / 3600, idx), 4) AS per_60_hours FROM b GROUP BY 1 HAVING count(*) > 4""")
def q10_grid_tempo(spark, sf_dir):
    b = ranking.stable_rank(events(spark, sf_dir), "idx", ["user_id"], TIME)
    b = b.groupBy("user_id").agg(F.count("*").alias("n"), signal.slope(F.col("t_s") / 3600, "idx").alias("slope"))
    return b.where("n > 4").select("user_id", r(60 / F.col("slope")).alias("per_60_hours"))


@query("""WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k,
count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, (k // greatest(1, n // 50))::BIGINT AS bucket, max(abs(value)) AS peak FROM i GROUP BY 1, 2""")
def q11_waveform_peaks(spark, sf_dir):
    e = indexed(table(spark, sf_dir, "events"), "k")
    sizes = e.groupBy("event_type").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 50))
    e = e.join(sizes, "event_type").withColumn("bucket", F.floor((F.col("k") - 1) / step).cast("long"))
    return e.groupBy("event_type", "bucket").agg(F.max(F.abs("value")).alias("peak"))


# ------------------------------------------------------------------ analysis


@query(f"""WITH h AS (SELECT event_type, floor(t_s / 3600)::BIGINT AS hour, sum(value) AS x FROM ({EVENTS}) GROUP BY 1, 2)
SELECT event_type, hour, round(greatest(x - coalesce(lag(x) OVER (PARTITION BY event_type ORDER BY hour), x), 0), 4) AS onset FROM h""")
def q12_onset_strength(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t_s") / 3600).cast("long").alias("hour")).agg(F.sum("value").alias("x"))
    rise = F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("event_type").orderBy("hour")), "x")
    return h.select("event_type", "hour", r(F.greatest(rise, F.lit(0.0))).alias("onset"))


@query(f"""WITH b AS (SELECT user_id AS song_id, t_s, [30, 60, 120, 200, 400][(user_id % 5 + 1)::INT] AS bpm, count(*) OVER (PARTITION BY user_id) AS n, lead(t_s) OVER (PARTITION BY user_id ORDER BY t_s) AS after FROM (SELECT DISTINCT user_id, t_s FROM ({EVENTS}))),
d AS (SELECT song_id, CASE bpm WHEN 200 THEN 2 WHEN 400 THEN 4 ELSE 1 END AS each, t_s + CASE WHEN j = 0 THEN 0 ELSE (after - t_s) * j / CASE bpm WHEN 30 THEN 4 ELSE 2 END END AS t_s
 FROM b, (SELECT unnest(range(4)) AS j) WHERE n >= 2 AND (j = 0 OR after IS NOT NULL AND j < CASE bpm WHEN 30 THEN 4 WHEN 60 THEN 2 ELSE 1 END)),
k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t_s) - 1 AS i FROM d)
SELECT song_id, (i // each)::BIGINT AS idx, round(t_s, 3) AS t_s FROM k WHERE i % each = 0""")
def q13_tempo_folding(spark, sf_dir):
    """Beats of songs of 30 to 400 a minute, folded into 70 to 180: midpoints added, or every other one left out."""
    b = events(spark, sf_dir).select(F.col("user_id").alias("song_id"), "t_s").distinct()
    bpm = F.element_at(F.array(*[F.lit(float(x)) for x in (30, 60, 120, 200, 400)]), (F.col("song_id") % 5 + 1).cast("int"))
    return analysis.folded(b.withColumn("bpm", bpm), 70, 180).select("song_id", F.col("idx").cast("long").alias("idx"), r("t_s", 3).alias("t_s"))


@query(f"SELECT event_type, floor(t_s / {DAY_S})::BIGINT AS beat, round(avg(value), 8) AS level, count(*) AS n FROM ({EVENTS}) GROUP BY 1, 2")
def q14_beat_mean(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t_s") / DAY_S).cast("long").alias("beat"))
    return e.agg(r(F.avg("value"), 8).alias("level"), F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT event_type, floor(t_s / {DAY_S})::BIGINT AS beat, avg(value) AS x FROM ({EVENTS}) GROUP BY 1, 2),
d AS (SELECT event_type, beat, x, abs(x - coalesce(lag(x) OVER (PARTITION BY event_type ORDER BY beat), x)) AS change FROM b),
z AS (SELECT event_type, beat, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-10) + (change - avg(change) OVER w) / (stddev_pop(change) OVER w + 1e-10) AS score
 FROM d WINDOW w AS (PARTITION BY event_type)),
p AS (SELECT event_type, (beat % 4) AS phase, avg(score) AS strength FROM z GROUP BY 1, 2)
SELECT event_type, phase, round(strength, 4) AS strength FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY strength DESC, phase) = 1""")
def q15_downbeat_phase(spark, sf_dir):
    b = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t_s") / DAY_S).cast("long").alias("beat")).agg(F.avg("value").alias("x"))
    before = F.lag("x").over(Window.partitionBy("event_type").orderBy("beat"))
    d = b.withColumn("change", F.abs(F.col("x") - F.coalesce(before, "x")))
    return grids.bar_phase(d, by=["event_type"], beat="beat", cues=["x", "change"]).select("event_type", "phase", r("strength").alias("strength"))


PROFILES = """(VALUES ('maj', [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]),
 ('min', [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])) AS p(mode, w)"""


@query(f"""WITH f AS (SELECT event_type, pc, sum(value) AS energy FROM (SELECT event_type, (floor(value)::BIGINT % 12) AS pc, value FROM events) GROUP BY 1, 2),
c AS (SELECT event_type, k.tonic, mode, corr(coalesce(energy, 0), w[((k.pc - k.tonic + 12) % 12 + 1)::INT]) AS score
 FROM (SELECT * FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(12)) AS pc), (SELECT unnest(range(12)) AS tonic), {PROFILES}) k
 LEFT JOIN f USING (event_type, pc) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY event_type ORDER BY score DESC, tonic DESC, mode DESC))
SELECT event_type, tonic::BIGINT AS tonic, mode, round(score, 4) AS score, round(least(1, greatest(score - second, 0) + 0.5 * greatest(score, 0)), 3) AS confidence FROM o WHERE n = 1""")
def q16_key_templates(spark, sf_dir):
    return grids.detect_key(fold(spark, sf_dir), by=["event_type"], pitch_class="pc", energy="energy")



@query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS day FROM orders),
s AS (SELECT n_name AS label, n_nationkey AS i, (n_nationkey * 95)::BIGINT AS start_d, (n_nationkey * 95 + 110)::BIGINT AS end_d FROM nation)
SELECT o_orderkey, day, arg_min(label, i) AS section FROM o LEFT JOIN s ON day >= start_d AND day < end_d GROUP BY 1, 2""")
def q17_section_at(spark, sf_dir):
    """The first of overlapping sections that holds an order's day, or null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_diff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("day"))
    start = (F.col("n_nationkey") * 95).cast("long")
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("section"), F.col("n_nationkey").alias("i"), start.alias("start_d"), (start + 110).alias("end_d"))
    found = intervals.first_interval(o, s, point="day", start="start_d", end="end_d", index="i", label="section", width=90, id_col="o_orderkey")
    return found.select("o_orderkey", "day", "section")


# ------------------------------------------------------------------ candidate generators


@query(f"""SELECT user_id, event_id, round(t_s, 3) AS start_s, round(least(coalesce(nxt, t_s + 3600), t_s + 3600), 3) AS end_s FROM (
SELECT user_id, event_id, t_s, lead(t_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ({EVENTS}))
WHERE least(coalesce(nxt, t_s + 3600), t_s + 3600) - t_s >= 600""")
def q18_one_shots(spark, sf_dir):
    found = grids.one_shots(events(spark, sf_dir), by=["user_id"], at="t_s", ties="event_id", longest=3600.0, least=600.0)
    return found.select("user_id", "event_id", r("start", 3).alias("start_s"), r("end", 3).alias("end_s"))


@query(f"""WITH d AS (SELECT event_type, floor(t_s / {DAY_S})::BIGINT AS day, sum(value * value) AS energy FROM ({EVENTS}) GROUP BY 1, 2),
n AS (SELECT max(day) + 1 AS n FROM d),
g AS (SELECT event_type, day AS start_day, day + bars AS end_day, bars FROM d, (SELECT unnest([1, 2, 4])::BIGINT AS bars), n WHERE day + bars <= n),
e AS (SELECT g.event_type, g.start_day, g.end_day, g.bars, sum(energy) / g.bars AS power FROM g JOIN d ON d.event_type = g.event_type AND d.day >= start_day AND d.day < end_day GROUP BY 1, 2, 3, 4)
SELECT event_type, start_day, end_day, bars, round(power, 6) AS power FROM e
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY power DESC, start_day, bars) <= 10""")
def q19_grid_loops(spark, sf_dir):
    """Loops of 1, 2 and 4 days from each day, the ten of the highest power of each stem."""
    d = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t_s") / DAY_S).cast("long").alias("day")).agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    n = d.agg((F.max("day") + 1).alias("n")).scalar()
    loops = grids.grid_loops(d.select("event_type", "day", n.alias("n")), start="day", lengths={1: 1, 2: 2, 4: 4}, limit="n")
    index = grids.prefix_energy(d, by=["event_type"], order="day", energy="energy")
    ends = index.select("event_type", F.col("day").alias("last_day"), F.col("until").alias("to"))
    loops = loops.join(index.select("event_type", "day", F.col("before").alias("from")), ["event_type", "day"])
    loops = loops.withColumn("last_day", F.col("end") - 1).join(ends, ["event_type", "last_day"])
    power = (F.col("to") - F.col("from")) / F.col("bars")
    loops = loops.select("event_type", F.col("day").alias("start_day"), F.col("end").alias("end_day"), "bars", power.alias("power"))
    return ranking.keep_top(loops, 10, ["event_type"], [F.desc(r("power", 6)), "start_day", "bars"]).withColumn("power", r("power", 6))


CANDIDATES = """SELECT l_returnflag AS stem, l_linestatus || (l_linenumber % 3) AS category, l_orderkey * 8 + l_linenumber AS ord,
 round((1 - l_discount) * l_quantity / 50, 4) AS score, l_partkey % 5 <> 0 AS representative FROM lineitem"""


def candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("stem"), F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("category"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), r((1 - F.col("l_discount")) * F.col("l_quantity") / 50).alias("score"),
        (F.col("l_partkey") % 5 != 0).alias("representative"),
    )


DEALT = f"""reps AS (SELECT * FROM c WHERE representative QUALIFY score >= 0.6 * max(score) OVER (PARTITION BY stem)),
cyc AS (SELECT *, row_number() OVER (PARTITION BY stem, category ORDER BY score DESC, ord) AS cycle FROM reps),
dealt AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY cycle, category) AS deal_rank FROM cyc)"""


@query(f"WITH c AS ({CANDIDATES}), {DEALT} SELECT stem, category, ord, score, deal_rank FROM dealt WHERE deal_rank <= 16")
def q20_round_robin(spark, sf_dir):
    """Flagship: 16 pads for each stem, dealt round-robin over its categories, best first, above the floor."""
    reps = ranking.above_floor(candidates(spark, sf_dir).where("representative"), 0.6, ["stem"])
    dealt = ranking.deal(reps, group=["stem"], queue="category", queue_order="category", score="score", ties="ord", count=16)
    return dealt.select("stem", "category", "ord", "score", "deal_rank")


@query("""WITH p AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS slot FROM part WHERE p_size <= 10),
slots AS (SELECT p_brand, s AS slot FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(1, 9)) AS s)),
f AS (SELECT s.p_brand, s.slot, p.p_partkey FROM slots s LEFT JOIN p USING (p_brand, slot)),
empty AS (SELECT p_brand, slot, row_number() OVER (ORDER BY p_brand, slot) AS k FROM f WHERE p_partkey IS NULL),
rest AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f WHERE p_partkey IS NOT NULL))
SELECT f.p_brand, f.slot, coalesce(f.p_partkey, rest.p_partkey) AS p_partkey, f.p_partkey IS NULL AND rest.p_partkey IS NOT NULL AS leftover
FROM f LEFT JOIN empty USING (p_brand, slot) LEFT JOIN rest USING (k)""")
def q21_slots_and_leftovers(spark, sf_dir):
    """Eight slots a brand; empty ones, in their order, take the best parts that are in none."""
    p = table(spark, sf_dir, "part")
    best = ranking.stable_rank(p.where("p_size <= 10"), "slot", ["p_brand"], [F.desc("p_retailprice"), "p_partkey"])
    slots = p.select("p_brand").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    filled = slots.join(best.select("p_brand", "slot", "p_partkey"), ["p_brand", "slot"], "left")
    empty = filled.where("p_partkey is null")
    rest = p.join(filled.where("p_partkey is not null"), "p_partkey", "left_anti").select("p_partkey", "p_retailprice")
    pairs = ranking.pair_in_order(
        empty.select("p_brand", "slot"), rest, ["p_brand", "slot"], [F.desc("p_retailprice"), "p_partkey"],
        blocks=(F.col("p_brand"), -F.floor(F.col("p_retailprice") / 10)),
    )
    pairs = pairs.select("p_brand", "slot", F.col("p_partkey").alias("extra"))
    out = filled.join(pairs, ["p_brand", "slot"], "left")
    return out.select("p_brand", "slot", F.coalesce("p_partkey", "extra").alias("p_partkey"), (F.col("p_partkey").isNull() & F.col("extra").isNotNull()).alias("leftover"))


@query(f"""WITH c AS ({CANDIDATES}), {DEALT}, pads AS (SELECT ord FROM dealt WHERE deal_rank <= 16)
SELECT stem, category, ord, score, representative, row_number() OVER (PARTITION BY stem ORDER BY representative DESC, score DESC, ord) AS backup
FROM c WHERE score > 0 AND ord NOT IN (SELECT ord FROM pads)
QUALIFY row_number() OVER (PARTITION BY stem ORDER BY representative DESC, score DESC, ord) <= 20""")
def q22_backups(spark, sf_dir):
    """The best that are on no pad: of each stem those that would be left of as many more as there are pads."""
    order = [F.desc("representative"), F.desc("score"), "ord"]
    pads = q20_round_robin(spark, sf_dir).select("stem", "ord")
    rest = ranking.keep_top(candidates(spark, sf_dir).where("score > 0"), 20 + 16, ["stem"], order)
    rest = ranking.stable_rank(rest.join(pads, ["stem", "ord"], "left_anti"), "backup", ["stem"], order)
    return rest.where("backup <= 20").select("stem", "category", "ord", "score", "representative", "backup")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 'perc'
 WHEN l_discount * 10 > 0.45 AND l_extendedprice / 10 < 1000 THEN 'kick' WHEN l_tax * 10 > 0.5 OR l_extendedprice / 10 > 6000 THEN 'hat'
 WHEN l_discount * 5 > 0.15 AND l_extendedprice / 10 > 800 THEN 'snare' ELSE 'perc' END AS category FROM lineitem""")
def q23_drum_classifier(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.when(F.col("l_quantity") < 3, 10).otherwise(1000)
    kind = scoring.drum_category(n, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_extendedprice") / 10, F.col("l_discount") * 5)
    return li.select("l_orderkey", "l_linenumber", kind.alias("category"))


ISLANDS = f"""WITH g AS (SELECT user_id, event_id, ts, t_s, CASE WHEN t_s - lag(t_s) OVER w <= 28800 THEN 0 ELSE 1 END AS fresh FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY t_s, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT user_id, island::BIGINT AS island, min(t_s) AS start_s, max(t_s) AS end_s, count(*) AS n FROM i GROUP BY 1, 2)"""


def sounding(spark, sf_dir):
    e = islands.gap_islands(events(spark, sf_dir), by=["user_id"], at="t_s", ties="event_id", most=28800.0)
    return e.groupBy("user_id", "island").agg(F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.count("*").alias("n"))


@query(f"{ISLANDS} SELECT user_id, island, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, n FROM s")
def q24_silence_split(spark, sf_dir):
    return sounding(spark, sf_dir).select("user_id", "island", r("start_s", 3).alias("start_s"), r("end_s", 3).alias("end_s"), "n")


@query(f"""{ISLANDS}, m AS (SELECT user_id, island, floor(start_s)::BIGINT AS a, floor(end_s)::BIGINT + 1 AS b FROM s),
c AS (SELECT user_id, island, unnest(range(a, b, 20000)) AS start_s, b FROM m)
SELECT user_id, island, start_s, least(start_s + 20000, b) AS end_s FROM c WHERE least(start_s + 20000, b) - start_s >= 5000""")
def q25_long_phrases(spark, sf_dir):
    s = sounding(spark, sf_dir).select("user_id", "island", F.floor("start_s").cast("long").alias("start_s"), (F.floor("end_s").cast("long") + 1).alias("end_s"))
    return islands.cut_long(s, start="start_s", end="end_s", most=F.lit(20000).cast("long"), least=5000)


@query(f"""{ISLANDS}, grid AS (SELECT u.user_id, (k * 21600)::BIGINT AS place_s, beats::BIGINT AS beats FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(120)) AS k), (SELECT unnest([1, 2]) AS beats))
SELECT user_id, place_s, beats FROM grid WHERE place_s + beats * 21600 <= 2592000 AND EXISTS (SELECT 1 FROM s WHERE s.user_id = grid.user_id AND s.start_s <= grid.place_s AND grid.place_s < s.end_s)""")
def q26_chops_in_islands(spark, sf_dir):
    s = sounding(spark, sf_dir)
    places = F.sequence(F.lit(0).cast("long"), F.lit(119 * 21600).cast("long"), F.lit(21600).cast("long"))
    users = s.select("user_id").distinct().withColumn("place_s", F.explode(places))
    chops = grids.grid_loops(users.withColumn("n", F.lit(2592000)), start="place_s", lengths={1: 21600, 2: 43200}, limit="n", bars="beats")
    inside = intervals.interval_join(chops, s, point="place_s", start="start_s", end="end_s", width=86400, keys=["user_id"], how="left_semi")
    return inside.select("user_id", "place_s", "beats")


# ------------------------------------------------------------------ scores


@query(f"""WITH i AS (SELECT event_type, row_number() OVER w AS idx, sum(value * value) OVER (w ROWS UNBOUNDED PRECEDING) AS until FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT a.event_type, a.idx AS first_idx, round(b.until - a.until, 4) AS energy FROM i a JOIN i b ON a.event_type = b.event_type AND b.idx = a.idx + 32 WHERE a.idx % 16 = 0""")
def q27_prefix_energy(spark, sf_dir):
    e = indexed(table(spark, sf_dir, "events")).withColumns({"energy": F.col("value") * F.col("value"), "chunk": F.floor(F.col("idx") / CHUNK)})
    index = grids.prefix_energy(e, by=["event_type"], order="idx", energy="energy", block="chunk").select("event_type", "idx", "until")
    a = index.where("idx % 16 = 0").select("event_type", F.col("idx").alias("first_idx"), F.col("until").alias("from"), (F.col("idx") + 32).alias("idx"))
    return a.join(index, ["event_type", "idx"]).select("event_type", "first_idx", r(F.col("until") - F.col("from"), 4).alias("energy"))


@query(f"""SELECT floor(t_s / {DAY_S})::BIGINT AS day, event_type, round(CASE WHEN t > 1e-10 THEN e / t ELSE 0 END, 6) AS isolation FROM (
SELECT *, sum(e) OVER (PARTITION BY floor(t_s / {DAY_S})) AS t FROM (SELECT floor(t_s / {DAY_S}) * {DAY_S} AS t_s, event_type, sum(value * value) AS e FROM ({EVENTS}) GROUP BY 1, 2))""")
def q28_isolation(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.floor(F.col("t_s") / DAY_S).cast("long").alias("day"), "event_type").agg(F.sum(F.col("value") * F.col("value")).alias("e"))
    every = F.sum("e").over(Window.partitionBy("day"))
    return e.select("day", "event_type", r(scoring.isolation("e", every), 6).alias("isolation"))


@query("""WITH b AS (SELECT user_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS beat FROM events),
m AS (SELECT user_id, beat, avg(value) AS level FROM b GROUP BY 1, 2)
SELECT user_id, round(least(greatest(1 - stddev_pop(level) / (avg(level) + 1e-10), 0), 1), 4) AS clarity FROM m GROUP BY 1""")
def q29_loop_clarity(spark, sf_dir):
    beat = F.ntile(4).over(Window.partitionBy("user_id").orderBy(*TIME))
    m = table(spark, sf_dir, "events").select("user_id", "value", beat.alias("beat")).groupBy("user_id", "beat").agg(F.avg("value").alias("level"))
    return m.groupBy("user_id").agg(r(scoring.loop_clarity(F.avg("level"), F.stddev_pop("level"))).alias("clarity"))


@query("""WITH l AS (SELECT user_id, 20 * log10(greatest(sqrt(avg(value * value / 1e6) + 1e-10), 1e-10)) AS level, avg((value >= 488)::INT) AS clipped FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN level < -50 OR clipped > 0.01 THEN 0 ELSE least(greatest((level + 50) / 32, 0), 1) END, 4) AS loudness FROM l""")
def q30_loudness_gate(spark, sf_dir):
    level = signal.decibels(signal.rms(F.col("value") / 1e3))
    clipped = F.avg((F.col("value") >= 488).cast("int"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(level.alias("level"), clipped.alias("clipped"))
    return e.select("user_id", r(scoring.loudness("level", "clipped", most_clipped=0.01)).alias("loudness"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, 1 - list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
 / (0.5 * (sqrt(list_sum([x::DOUBLE * x for x in a.embedding])) + sqrt(list_sum([x::DOUBLE * x for x in b.embedding]))) + 1e-10)), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id""")
def q31_timbre_similarity(spark, sf_dir):
    """Every vector against the reference vectors of its label, whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"))
    b = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return a.join(b, "label").where("a <> b").select("a", "b", r(signal.similarity("x", "y")).alias("similarity"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS isolation, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END AS clarity,
 CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 0.5 END AS loudness, CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 END AS loopability FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN loudness = 0 THEN 0 ELSE
 (0.3 * isolation + coalesce(0.2 * clarity, 0) + 0.15 * loudness + coalesce(0.2 * loopability, 0))
 / (0.45 + CASE WHEN clarity IS NULL THEN 0 ELSE 0.2 END + CASE WHEN loopability IS NULL THEN 0 ELSE 0.2 END) END, 4) AS score FROM p""")
def q32_weighted_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = {
        "isolation": F.col("l_discount") * 10, "clarity": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 10),
        "loudness": F.when(F.col("l_returnflag") == "R", 0.0).otherwise(0.5), "loopability": F.when(F.col("l_linestatus") == "O", F.col("l_quantity") / 50),
    }
    weights = {k: v for k, v in scoring.WEIGHTS.items() if k != "uniqueness"}
    return li.select("l_orderkey", "l_linenumber", r(scoring.weighted(parts, weights)).alias("score"))


# ------------------------------------------------------------------ duplicates


def clustered(spark, sf_dir):
    """Songs of 400 vectors at most, as the candidates of a category are, with labels as stems."""
    song = F.floor(F.col("vec_id") / 400).cast("long")
    e = table(spark, sf_dir, "embeddings").select(song.alias("song"), F.col("label").cast("string").alias("stem"), F.col("vec_id").alias("ord"), (F.col("vec_id") % 7).cast("double").alias("prelim"), F.col("embedding").alias("timbre"))
    return clusters.leaders(e, group=["song", "stem"], vector="timbre", score="prelim", ties="ord", threshold=0.3)


#: The leader pass as a recursion: each step brings the next row of every group to the leaders that the group has so far.
LEADERS = """RECURSIVE e AS (SELECT vec_id // 400 AS song, label::VARCHAR AS stem, vec_id AS ord, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm,
 row_number() OVER (PARTITION BY vec_id // 400, label ORDER BY vec_id % 7 DESC, vec_id) AS i FROM embeddings),
pass AS (SELECT song, stem, ord, i, [{'v': v, 'norm': norm}] AS kept, 0::BIGINT AS leader, NULL::DOUBLE AS similarity FROM e WHERE i = 1
UNION ALL SELECT song, stem, ord, i, CASE WHEN best >= 0.3 THEN kept ELSE list_append(kept, {'v': v, 'norm': norm}) END,
 CASE WHEN best >= 0.3 THEN list_position(near, best) - 1 ELSE len(kept) END, CASE WHEN best >= 0.3 THEN best END
 FROM (SELECT *, list_max(near) AS best FROM (SELECT e.*, p.kept, list_transform(p.kept, lambda k: greatest(0, 1 - list_distance(k.v, e.v) / (0.5 * (k.norm + e.norm) + 1e-10))) AS near
  FROM pass p JOIN e ON e.song = p.song AND e.stem = p.stem AND e.i = p.i + 1)))"""


@query(f"WITH {LEADERS} SELECT song, stem, ord, leader, similarity IS NULL AS representative, round(similarity, 4) AS similarity FROM pass")
def q33_leader_clusters(spark, sf_dir):
    found = clustered(spark, sf_dir)
    return found.select("song", "stem", "ord", F.col("leader").cast("long"), "representative", r("similarity").alias("similarity"))


@query(f"""WITH {LEADERS}, g AS (SELECT song, stem, min(ord) AS first, max(leader) + 1 AS n FROM pass GROUP BY 1, 2),
b AS (SELECT song, stem, coalesce(sum(n) OVER (PARTITION BY song ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g)
SELECT song, stem, ord, (base + leader)::BIGINT AS cluster FROM pass JOIN b USING (song, stem)""")
def q34_cluster_numbers(spark, sf_dir):
    """Clusters numbered through a song's groups, in the order in which the groups first appear."""
    return clusters.numbered(clustered(spark, sf_dir), group=["stem"], by=["song"], ties="ord").select("song", "stem", "ord", "cluster")


# ------------------------------------------------------------------ labels


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Kick ' || n WHEN 1 THEN 'Drum loop ' || l || ' (' || (1 + p_size % 2) || ' bar)'
 WHEN 2 THEN 'Bass note ' || n || ' Ab2' ELSE 'Vox phrase ' || n END AS label,
 CASE p_size % 4 WHEN 0 THEN 'Drums_Kick_' || n WHEN 1 THEN 'Drums_Loop_' || l || '_' || (1 + p_size % 2) || 'bar' WHEN 2 THEN 'Bass_Note_' || n || '_Ab2' ELSE 'Vocals_Phrase_' || n END || '_120bpm_Fmin' AS file
FROM (SELECT *, CASE WHEN (n - 1) // 26 = 0 THEN '' ELSE chr((64 + (n - 1) // 26)::INT) END || chr((65 + (n - 1) % 26)::INT) AS l FROM (
 SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand, p_size % 4 ORDER BY p_partkey) AS n FROM part))""")
def q35_slice_labels(spark, sf_dir):
    p = ranking.stable_rank(table(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 4), "n", ["p_brand", "k"], ["p_partkey"])

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") + 1)

    stem, kind, category = pick("drums", "drums", "bass", "vocals"), pick("one_shot", "loop", "one_shot", "phrase"), pick("kick", "drum_loop", "bass_note", "vox_phrase")
    bars, note = F.when(F.col("k") == 1, 1 + F.col("p_size") % 2), F.when(F.col("k") == 2, "Ab2")
    args = (stem, kind, category, F.col("n"), bars, note)
    return p.select("p_partkey", labels.slice_label(*args).alias("label"), labels.slice_file(*args, labels.suffix(F.lit(120.2), F.lit("Fmin"))).alias("file"))


@query("""SELECT o_orderkey, array_to_string(list_reverse(list_transform(list_filter(list_zip([1, 26, 676, 17576, 456976, 11881376], [0, 26, 702, 18278, 475254, 12356630]), lambda p: o_orderkey > p[2]),
 lambda p: chr((65 + ((o_orderkey - 1 - p[2]) // p[1]) % 26)::INT))), '') AS name FROM orders""")
def q36_letters(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.letters("o_orderkey").alias("name"))


@query("""WITH m AS (SELECT p_partkey, round_even(69 + 12 * log2(p_retailprice / 440), 0)::BIGINT AS midi FROM part)
SELECT p_partkey, midi, ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][(midi % 12 + 1)::INT] || (midi // 12 - 1) AS note FROM m""")
def q37_note_name(spark, sf_dir):
    midi = labels.midi_note("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", midi.cast("long").alias("midi"), labels.pitch_name(midi).alias("note"))


@query(f"""WITH f AS ({FOLD}), t AS (SELECT root, q, third FROM (SELECT unnest(range(12)) AS root), (VALUES ('maj', 4), ('min', 3)) AS q(q, third)),
s AS (SELECT event_type, root, q, sum(CASE WHEN pc IN (root, (root + third) % 12, (root + 7) % 12) THEN energy ELSE 0 END) / (sqrt(sum(energy * energy)) * sqrt(3)) AS score FROM f, t GROUP BY 1, 2, 3)
SELECT event_type, ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][(root + 1)::INT] || q AS chord, round(score, 4) AS score
FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, root, q) = 1""")
def q38_chord_name(spark, sf_dir):
    return grids.name_chord(fold(spark, sf_dir), by=["event_type"], pitch_class="pc", energy="energy").select("event_type", "chord", r("score").alias("score"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g')) AS song,
regexp_replace(regexp_replace(regexp_replace(url, '[()]', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS clean FROM pages""")
def q39_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.sanitised_song("url").alias("song"), labels.export_clean("url").alias("clean"))


@query("""WITH v AS (SELECT p_partkey, 'drums=' || p_size || ',vocals=' || p_brand || ', bass = ' || p_partkey % 7 || CASE WHEN p_partkey % 3 = 0 THEN ',' ELSE ',other' END AS spec FROM part),
p AS (SELECT p_partkey, unnest(string_split(spec, ',')) AS part, unnest(range(1, len(string_split(spec, ',')) + 1)) AS place FROM v)
SELECT p_partkey, place::BIGINT AS place, trim(string_split(part, '=')[1]) AS stem,
 CASE WHEN regexp_full_match(trim(string_split(part, '=')[2]), '[0-9]+') THEN trim(string_split(part, '=')[2])::BIGINT END AS count FROM p WHERE trim(part) <> ''""")
def q40_pad_split(spark, sf_dir):
    """Splits written by hand: blanks, missing and false numbers, a comma at the end."""
    spec = F.concat(F.lit("drums="), F.col("p_size"), F.lit(",vocals="), "p_brand", F.lit(", bass = "), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 3 == 0, ",").otherwise(",other"))
    v = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(labels.pad_split(spec)).alias("place", "pair"))
    return v.select("p_partkey", (F.col("place") + 1).cast("long").alias("place"), "pair.stem", F.col("pair.count").cast("long").alias("count"))


# ------------------------------------------------------------------ export, render, separation


CLEAN = "regexp_replace(regexp_replace(regexp_replace({}, '[()]', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH p AS (SELECT p_brand, p_partkey, {CLEAN.format("p_name")} AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part),
a AS (SELECT *, CASE WHEN i < 32 AND i % 7 <> 5 THEN i END AS pad FROM p),
pads AS (SELECT p_brand, k AS i, chr((65 + k // 16)::INT) AS bank, (3 - (k % 16) // 4) * 4 + (k % 16) % 4 + 1 AS number FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(32)) AS k))
SELECT pads.p_brand, 'Bank_' || bank || '/' || lpad(number::VARCHAR, 2, '0') || '_' || coalesce(n, 'Empty') || '.wav' AS path, p_partkey
FROM pads LEFT JOIN a ON a.p_brand = pads.p_brand AND a.pad = pads.i
UNION ALL SELECT p_brand, 'Extras/' || n || repeat('_', (row_number() OVER (PARTITION BY p_brand, n ORDER BY i) - 1)::INT) || '.wav', p_partkey FROM a WHERE pad IS NULL""")
def q41_export_plan(spark, sf_dir):
    """Each brand's numbered files of two banks, empty pads included, and the slices that are on no pad."""
    from tessella.plans import export

    p = ranking.stable_rank(table(spark, sf_dir, "part"), "n", ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).withColumn("i", F.col("n") - 1)
    slices = p.select(F.col("p_brand").alias("song_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("i").alias("kept_ord"))
    on = p.where("i < 32 and i % 7 <> 5").select(F.col("p_brand").alias("song_id"), F.col("n").cast("int").alias("pad"), F.col("p_partkey").alias("slice_id"))
    every = p.select(F.col("p_brand").alias("song_id")).distinct().withColumn("pad", F.explode(F.sequence(F.lit(1), F.lit(32))))
    plan = export.export_plan(every.join(on, ["song_id", "pad"], "left"), slices, extras=True)
    return plan.select(F.col("song_id").alias("p_brand"), "path", F.col("slice_id").alias("p_partkey"))


@query("""SELECT o_orderkey, round(o_totalprice - coalesce(s, 0), 2) AS rest FROM orders LEFT JOIN (
SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q42_subtract_pair(spark, sf_dir):
    """What is left of a mix when one stem is taken out."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, sf_dir, "orders").join(s, "o_orderkey", "left")
    return o.select("o_orderkey", r(F.col("o_totalprice") - F.coalesce("s", F.lit(0.0)), 2).alias("rest"))


@query("""SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS median FROM events""")
def q43_running_median(spark, sf_dir):
    e, w = chunks(indexed(table(spark, sf_dir, "events")), 3)
    median = F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-3, 3))
    return e.withColumn("median", median).where("own").select("event_id", r("median").alias("median"))


@query("""WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events),
c AS (SELECT event_type, value, k, chunk, k - chunk * 12 AS place FROM (SELECT *, unnest([k // 12 - 1, k // 12]) AS chunk FROM i) WHERE chunk >= 0 AND k - chunk * 12 < 16),
m AS (SELECT *, avg(value) OVER (PARTITION BY event_type, chunk) AS level, least(place + 1, 16 - place) / 8.0 AS w FROM c)
SELECT event_type, k::BIGINT AS k, round(sum(w * level) / sum(w), 8) AS level FROM m GROUP BY 1, 2""")
def q44_overlap_add(spark, sf_dir):
    """Chunks of 16 that begin every 12, each reduced to its mean, put together under triangular weights."""
    i = indexed(table(spark, sf_dir, "events"), "k").withColumn("k", F.col("k") - 1)
    c = grids.overlapping_chunks(i, index="k", size=16, stride=12)
    level = F.avg("value").over(Window.partitionBy("event_type", "chunk"))
    return grids.overlap_add(c.withColumn("level", level), by=["event_type"], index="k", value="level").select("event_type", "k", r("level", 8).alias("level"))


# ------------------------------------------------------------------ jobs, documents, views

STAGES = ["ingest", "separate", "analyze", "pick", "render"]


@query("""WITH l AS (SELECT user_id AS job, (event_id % 5) AS stage, ts, event_id, CASE WHEN value < 50 THEN 'failed' WHEN value < 100 THEN 'running' ELSE 'done' END AS status FROM events),
s AS (SELECT job, stage, arg_max(status, struct_pack(t := ts, e := event_id)) AS status FROM l GROUP BY 1, 2),
f AS (SELECT job, min(stage) AS first_bad FROM s WHERE status <> 'done' GROUP BY 1)
SELECT s.job, s.stage::BIGINT AS stage, s.status, s.stage < coalesce(first_bad, 5) AS valid FROM s LEFT JOIN f USING (job)""")
def q45_stage_status(spark, sf_dir):
    """Each job's latest status by stage; a stage that isn't done invalidates itself and all later ones."""
    from tessella.plans import jobs

    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 50, "failed").when(F.col("value") < 100, "running").otherwise("done")
    log = e.select(F.col("user_id").alias("job"), (F.col("event_id") % 5).alias("stage"), "ts", "event_id", status.alias("status"))
    latest = jobs.latest_status(log, by=["job", "stage"], order=["ts", "event_id"], value="status")
    return jobs.with_validity(latest, job="job", stage="stage", status="status", stages=5)


@query("""SELECT 'queued' AS what, o_orderstatus AS name, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 2
UNION ALL SELECT 'recent', o_orderkey::VARCHAR, k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 20""")
def q46_queue_and_recent(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    queued = o.where(F.col("o_orderstatus").isin("O", "P")).groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    recent = o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    recent = recent.withColumn("n", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long"))
    return queued.select(F.lit("queued").alias("what"), "name", "n").unionByName(recent.select(F.lit("recent").alias("what"), F.col("o_orderkey").cast("string").alias("name"), "n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q47_json_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("""SELECT n_name AS lane, c_custkey, dense_rank() OVER (ORDER BY n_nationkey) AS lane_no, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place,
coalesce(o.last, 0)::DOUBLE AS last_total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def q48_lanes(spark, sf_dir):
    """Rows in lanes in a fixed order, longest first, with a fallback for what is missing."""
    n = table(spark, sf_dir, "nation")
    n = n.join(ranking.stable_rank(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "lane_no", [], ["n_nationkey"]), "n_nationkey")
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("last"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(last, "c_custkey", "left")
    c = ranking.stable_rank(c, "place", ["n_nationkey"], [F.desc("c_acctbal"), "c_custkey"])
    return c.select(F.col("n_name").alias("lane"), "c_custkey", "lane_no", "place", F.coalesce("last", F.lit(0.0)).alias("last_total"))
