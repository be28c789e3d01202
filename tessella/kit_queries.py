"""Queries over the song path and its records: candidates, scores, kits, exports, jobs, views; each with its SQL.

Songs are the users of ``events`` or the suppliers of ``lineitem``; the operators
are those that ``plans.songs`` runs on audio.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import labels, scoring, signal
from tessella.operators import grids, islands, ranking
from tessella.plans import analysis, candidates, export, jobs, kit, render, scores, views
from tessella.queries import CHUNK, CLEAN, EVENTS, TIME, events, query, r, signal_blocks, table  # queries are added to its list
from tessella.workers import prepare

BY = ["song_id", "stem"]

# ------------------------------------------------------------------ frames and candidates


FRAMES = """SELECT user_id::VARCHAR AS song_id, event_type AS stem, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame FROM events"""


def frames(spark, sf_dir) -> DataFrame:
    """Every song's stems as frames in order, the value as the only band."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("song_id"), F.col("event_type").alias("stem"), "value", *TIME)
    return ranking.stable_rank(e, "frame", BY, TIME).select("song_id", "stem", "value", (F.col("frame") - 1).alias("frame"))


ONSETS = f"""RECURSIVE f AS ({FRAMES}),
rise AS (SELECT *, greatest(value - lag(value) OVER w, 0) AS up FROM f WINDOW w AS (PARTITION BY song_id, stem ORDER BY frame)),
env AS (SELECT song_id, stem, frame, coalesce(lag(up, 2) OVER (PARTITION BY song_id, stem ORDER BY frame), 0) AS onset FROM rise),
n AS (SELECT *, CASE WHEN max(onset) OVER g > min(onset) OVER g THEN (onset - min(onset) OVER g) / (max(onset) OVER g - min(onset) OVER g) ELSE 0 END AS x FROM env WINDOW g AS (PARTITION BY song_id, stem)),
w AS (SELECT *, max(x) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top, avg(x) OVER (o ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS mean,
 lag(onset) OVER o AS prev, lead(onset) OVER o AS next FROM n WINDOW o AS (PARTITION BY song_id, stem ORDER BY frame)),
p AS (SELECT song_id, stem, frame, row_number() OVER (PARTITION BY song_id, stem ORDER BY frame) AS i FROM w WHERE x = top AND x >= mean + 0.07),
kept AS (SELECT song_id, stem, frame, i, frame AS last, true AS taken FROM p WHERE i = 1
 UNION ALL SELECT p.song_id, p.stem, p.frame, p.i, CASE WHEN k.last + 2 < p.frame THEN p.frame ELSE k.last END, k.last + 2 < p.frame
 FROM kept k JOIN p ON p.song_id = k.song_id AND p.stem = k.stem AND p.i = k.i + 1),
low AS (SELECT song_id, stem, frame FROM w WHERE onset <= prev AND onset < next)
SELECT DISTINCT k.song_id, k.stem, (512 * coalesce((SELECT max(l.frame) FROM low l WHERE l.song_id = k.song_id AND l.stem = k.stem AND l.frame <= k.frame), 0))::BIGINT AS sample FROM kept k WHERE taken"""


@query(f"WITH {ONSETS}")
def q49_onsets(spark, sf_dir):
    """Onsets of every stem of every song: peaks of the strength, led back to the minimum before."""
    f = frames(spark, sf_dir).withColumn("mel", F.array("value"))
    return candidates.onsets(f).select("song_id", "stem", F.col("sample").cast("long"))


@query(f"""WITH f AS ({FRAMES}), d AS (SELECT *, 20 * log10(greatest(value, 1e-10)) - 20 * log10(max(greatest(value, 1e-10)) OVER (PARTITION BY song_id, stem)) AS db FROM f),
a AS (SELECT song_id, stem, frame, frame - row_number() OVER (PARTITION BY song_id, stem ORDER BY frame) AS run FROM d WHERE db > -9)
SELECT song_id, stem, min(frame) AS first, max(frame) AS last FROM a GROUP BY song_id, stem, run""")
def q50_loud_runs(spark, sf_dir):
    """Runs of frames less than 9 dB below a stem's loudest."""
    f = frames(spark, sf_dir)
    tops = f.groupBy(*BY).agg(F.max("value").alias("top"))
    loud = signal.decibels("value") - signal.decibels("top") > -9
    return islands.active_runs(f.join(tops, BY), by=BY, frame="frame", active=loud)


@query(f"""WITH f AS ({FRAMES}), w AS (SELECT song_id, stem, frame // 20 AS win, frame % 20 AS pos, value, count(*) OVER (PARTITION BY song_id, stem, frame // 20) AS n FROM f),
m AS (SELECT *, max(CASE WHEN pos // 2 < n // 2 THEN value END) OVER (PARTITION BY song_id, stem, win) AS top FROM w),
e AS (SELECT song_id, stem, win, n, max(CASE WHEN pos // 2 < n // 2 AND value > top * pow(10, -6 / 20.0) THEN pos // 2 END) AS last FROM m GROUP BY 1, 2, 3, 4)
SELECT song_id, stem, win, (win * 20)::BIGINT AS start, (win * 20 + CASE WHEN n < 4 OR last IS NULL THEN n ELSE least(n, (last + 2) * 2) END)::BIGINT AS "end" FROM e""")
def q51_tail_trim(spark, sf_dir):
    """Windows of 20 frames without their quiet tails, cut in steps of two by the function that cuts one-shots."""
    w = frames(spark, sf_dir).withColumn("win", F.floor(F.col("frame") / 20).cast("long"))
    x = w.groupBy(*BY, "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda s: s["value"]).alias("x"))

    def run(batches):
        for batch in batches:
            kept = [candidates.trimmed(v.values.to_numpy(zero_copy_only=False), 6.0, 2) for v in batch["x"]]
            start = pc.multiply(batch["win"], 20)
            yield pa.RecordBatch.from_arrays([batch["song_id"], batch["stem"], batch["win"], start, pc.add(start, pa.array(kept, pa.int64()))], names=["song_id", "stem", "win", "start", "end"])

    prepare(spark)
    return x.mapInArrow(run, "song_id string, stem string, win long, start long, end long")


CAND = f"""t AS (SELECT user_id::VARCHAR AS song_id, event_type AS stem, floor(t_s)::BIGINT AS s, lead(floor(t_s)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY floor(t_s)::BIGINT, event_id) AS nxt FROM ({EVENTS})),
shots AS (SELECT song_id, stem, 'one_shot' AS kind, CASE stem WHEN 'click' THEN 'hit' WHEN 'view' THEN 'bass_note' ELSE 'stab' END AS category, s AS start, least(coalesce(nxt, s + 7200), s + 7200) AS "end" FROM t),
loops AS (SELECT song_id, stem, 'loop' AS kind, stem || '_loop' AS category, day * 86400 AS start, (day + n) * 86400 AS "end" FROM (SELECT DISTINCT song_id, stem, s // 86400 AS day FROM t), (SELECT unnest([1, 2])::BIGINT AS n) WHERE (day + n) * 86400 <= 2592000),
c AS (SELECT * FROM shots WHERE "end" - start >= 60 UNION ALL SELECT * FROM loops),
capped AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY song_id, stem, kind ORDER BY "end" - start DESC, start, "end", category) <= 12)"""


@query(f"""WITH {CAND} SELECT song_id, stem, kind, category, start, "end", stem || '-' || lpad((row_number() OVER (PARTITION BY song_id, stem ORDER BY start, "end", category) - 1)::VARCHAR, 4, '0') AS id,
row_number() OVER (PARTITION BY song_id ORDER BY stem, start, "end", category) AS ord FROM capped""")
def q52_candidates(spark, sf_dir):
    """One-shots and loops of every stem, a dozen of each kind, with ids by stem and an order by song."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("song_id"), F.col("event_type").alias("stem"), F.floor("t_s").cast("long").alias("s"), "event_id")
    shots = grids.one_shots(e, by=BY, at="s", ties="event_id", longest=7200, least=60)
    kind = F.when(F.col("stem") == "click", "hit").when(F.col("stem") == "view", "bass_note").otherwise("stab")
    shots = shots.select(*BY, F.lit("one_shot").alias("kind"), kind.alias("category"), "start", "end")
    days = e.select(*BY, (F.floor(F.col("s") / 86400) * 86400).alias("start")).distinct().withColumn("n", F.lit(2592000))
    loops = grids.grid_loops(days, start="start", lengths={1: 86400, 2: 172800}, limit="n")
    loops = loops.select(*BY, F.lit("loop").alias("kind"), F.concat("stem", F.lit("_loop")).alias("category"), "start", "end")
    return candidates.named(candidates.capped(shots.unionByName(loops), 12, [F.desc(F.col("end") - F.col("start")), "start", "end", "category"]))


# ------------------------------------------------------------------ scores


@query(f"""WITH f AS ({FRAMES}), a AS (SELECT song_id, stem, max(value) FILTER (frame < 3) AS attack, avg(value) AS mean, avg(value) FILTER (frame >= n - greatest(1, n // 8)) AS tail, max(value) AS peak
 FROM (SELECT *, count(*) OVER (PARTITION BY song_id, stem) AS n FROM f) GROUP BY 1, 2)
SELECT song_id, stem, round(0.5 * least(greatest((attack / (mean + 1e-10) - 1) / 2, 0), 1) + 0.5 * least(greatest(1 - 2 * tail / (peak + 1e-10), 0), 1), 4) AS clarity FROM a""")
def q53_one_shot_clarity(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.join(f.groupBy(*BY).agg(F.count("*").alias("n")), BY)
    tail = F.col("frame") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    a = f.groupBy(*BY).agg(F.max(F.when(F.col("frame") < 3, F.col("value"))).alias("attack"), F.avg("value").alias("mean"), F.avg(F.when(tail, F.col("value"))).alias("tail"), F.max("value").alias("peak"))
    return a.select(*BY, r(scoring.one_shot_clarity("attack", "mean", "tail", "peak")).alias("clarity"))


@query(f"""WITH f AS ({FRAMES}) SELECT song_id, stem, round(avg((value > 0.1 * top)::INT), 4) AS active FROM (SELECT *, max(value) OVER (PARTITION BY song_id, stem) AS top FROM f) GROUP BY 1, 2""")
def q54_active_share(spark, sf_dir):
    """The share of a stem's frames above a tenth of its peak."""
    f = frames(spark, sf_dir)
    f = f.join(f.groupBy(*BY).agg(F.max("value").alias("top")), BY)
    return f.groupBy(*BY).agg(r(F.avg((F.col("value") > 0.1 * F.col("top")).cast("int"))).alias("active"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v[1:32] AS x, a.v[33:64] AS y FROM v a),
n AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda q: q * q)) / 32 + 1e-10) AS head, sqrt(list_sum(list_transform(y, lambda q: q * q)) / 32 + 1e-10) AS tail,
 list_inner_product(x, y) / (sqrt(list_sum(list_transform(x, lambda q: q * q))) * sqrt(list_sum(list_transform(y, lambda q: q * q))) + 1e-10) AS c FROM p)
SELECT vec_id, round(least(greatest(0.5 * exp(-abs(ln((tail + 1e-10) / (head + 1e-10)))) + 0.5 * greatest(c, 0), 0), 1), 4) AS seam FROM n""")
def q55_loop_seam(spark, sf_dir):
    """How well each vector's second half runs into its first: level and cosine."""
    x, y = (F.transform(F.slice("embedding", at, 32), lambda q: q.cast("double")) for at in (1, 33))
    e = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), y.alias("y"))
    return e.select("vec_id", r(scoring.seam(signal.array_rms("x"), signal.array_rms("y"), signal.cosine("x", "y"))).alias("seam"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 4) AS isolation, CASE WHEN l_linenumber % 2 = 0 THEN round(l_tax * 12.3456, 4) END AS clarity, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 0.5 END AS loudness,
 CASE WHEN l_linestatus = 'O' THEN round(l_quantity / 51, 4) END AS loopability, CASE WHEN l_partkey % 4 = 0 THEN round(1 - least(greatest(l_quantity / 60, 0), 1), 4) ELSE 1.0 END AS uniqueness FROM lineitem)
SELECT *, round((CASE WHEN loudness = 0 THEN 0 ELSE (0.0::DOUBLE + 0.3::DOUBLE * isolation + coalesce(0.2::DOUBLE * clarity, 0) + 0.15::DOUBLE * loudness + coalesce(0.2::DOUBLE * loopability, 0) + 0.15::DOUBLE * uniqueness)
 / (0.3::DOUBLE + CASE WHEN clarity IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.15::DOUBLE + CASE WHEN loopability IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.15::DOUBLE) END)::DOUBLE::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS score FROM p""")
def q56_full_score(spark, sf_dir):
    """All five parts, rounded first, then their weighted mean."""
    li = table(spark, sf_dir, "lineitem")
    parts = {
        "isolation": F.col("l_discount") * 10, "clarity": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 12.3456), "loudness": F.when(F.col("l_returnflag") == "R", 0.0).otherwise(0.5),
        "loopability": F.when(F.col("l_linestatus") == "O", F.col("l_quantity") / 51), "uniqueness": F.when(F.col("l_partkey") % 4 == 0, 1 - signal.clip(F.col("l_quantity") / 60)).otherwise(1.0),
    }
    return scoring.final_score(li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in parts.items()]), scoring.WEIGHTS)


@query("""WITH i AS (SELECT event_type AS stem, value * value AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS at FROM events), n AS (SELECT stem, count(*) AS n FROM i GROUP BY 1),
w AS (SELECT stem, k * 1000 AS start FROM n, (SELECT unnest(range(100000)) AS k) WHERE k * 1000 < n),
s AS (SELECT w.stem, w.start, sum(CASE WHEN i.stem = w.stem THEN e ELSE 0 END) AS own, sum(e) AS every FROM w JOIN i ON i.at // 1000 * 1000 = w.start OR i.at // 1000 * 1000 = w.start + 1000 WHERE i.at >= w.start AND i.at < w.start + 1500 GROUP BY 1, 2)
SELECT stem, start::BIGINT AS start, round(own / every, 6) AS isolation FROM s""")
def q84_isolation(spark, sf_dir):
    """The share of its own stem in all stems' energy of windows of 1,500 samples, begun every 1,000: what candidates are scored by."""
    blocks = signal_blocks(table(spark, sf_dir, "events"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(1000).cast("long")))
    windows = blocks.where("block_idx = 0").select("song_id", "stem", starts.alias("start"))
    windows = windows.select("song_id", "stem", F.concat_ws("-", "stem", "start").alias("id"), "start", (F.col("start") + 1500).alias("end"))
    told = scores.isolation(windows, blocks, CHUNK).join(windows, ["song_id", "id"])
    return told.select("stem", "start", r("isolation", 6).alias("isolation"))


# ------------------------------------------------------------------ kits


SONGS = """found AS (SELECT l_suppkey AS song_id, ['drums', 'vocals', 'bass', 'keys'][(l_partkey % 4 + 1)::INT] AS stem,
 CASE l_partkey % 4 WHEN 0 THEN ['kick', 'snare', 'hat', 'perc', 'drum_loop'][(l_linenumber % 5 + 1)::INT] WHEN 1 THEN ['vox_chop', 'vox_phrase'][(l_linenumber % 2 + 1)::INT]
  WHEN 2 THEN ['bass_loop', 'bass_note'][(l_linenumber % 2 + 1)::INT] ELSE 'keys_loop' END AS category,
 'c' || l_orderkey || '-' || l_linenumber AS id, l_orderkey * 8 + l_linenumber AS ord, CASE WHEN l_discount = 0.1 THEN 0 ELSE round((1 - l_discount) * l_quantity / 50, 4) END AS score, l_orderkey % 3 <> 0 AS representative
 FROM lineitem WHERE l_partkey % 11 <> 5)"""


def found(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 11 <> 5")

    def pick(*values, by: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(by), F.lit(len(values))).cast("int") + 1)

    k = F.col("l_partkey") % 4
    category = (
        F.when(k == 0, pick("kick", "snare", "hat", "perc", "drum_loop", by="l_linenumber")).when(k == 1, pick("vox_chop", "vox_phrase", by="l_linenumber"))
        .when(k == 2, pick("bass_loop", "bass_note", by="l_linenumber")).otherwise("keys_loop")
    )
    return li.select(
        F.col("l_suppkey").alias("song_id"), pick("drums", "vocals", "bass", "keys", by="l_partkey").alias("stem"), category.alias("category"),
        F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_discount") == 0.1, 0.0).otherwise(r((1 - F.col("l_discount")) * F.col("l_quantity") / 50)).alias("score"), (F.col("l_orderkey") % 3 != 0).alias("representative"),
    )


#: Pads 1-6 drums, 7-10 vocals, 11-13 bass, 14-16 other; no song here has a stem "other", so its pads take what is left.
PADS = f"""{SONGS}, u AS (SELECT * FROM found WHERE score > 0), split(stem, n, base) AS (VALUES ('drums', 6, 0), ('vocals', 4, 6), ('bass', 3, 10), ('other', 3, 13)),
turn(category, t) AS (VALUES ('kick', '00'), ('snare', '01'), ('hat', '02'), ('perc', '03'), ('drum_loop', '04'), ('bass_loop', '00'), ('bass_note', '01'), ('vox_chop', '00'), ('vox_phrase', '01')),
reps AS (SELECT * FROM u WHERE representative QUALIFY score >= 0.6 * max(score) OVER (PARTITION BY song_id, stem)),
cyc AS (SELECT r.*, n, t, row_number() OVER (PARTITION BY song_id, r.stem, r.category ORDER BY score DESC, ord) AS cycle FROM reps r JOIN split USING (stem) JOIN turn USING (category)),
dealt AS (SELECT song_id, stem, id, row_number() OVER (PARTITION BY song_id, stem ORDER BY cycle, t, score DESC, ord) AS slot, n FROM cyc QUALIFY slot <= n),
had AS (SELECT song_id, stem, count(*) AS had FROM dealt GROUP BY 1, 2),
more AS (SELECT u.song_id, u.stem, u.id, coalesce(had, 0) + row_number() OVER (PARTITION BY u.song_id, u.stem ORDER BY score DESC, ord) AS slot, n
 FROM u JOIN split USING (stem) LEFT JOIN had USING (song_id, stem) WHERE NOT EXISTS (SELECT 1 FROM dealt d WHERE d.song_id = u.song_id AND d.id = u.id)),
picked AS (SELECT song_id, stem, id, slot FROM dealt UNION ALL SELECT song_id, stem, id, slot FROM more WHERE slot <= n),
slots AS (SELECT song_id, stem, base + i AS pad, i AS slot FROM (SELECT DISTINCT song_id FROM found), split, (SELECT unnest(range(1, 7)) AS i) WHERE i <= n),
filled AS (SELECT s.song_id, pad, p.id FROM slots s LEFT JOIN picked p USING (song_id, stem, slot)),
gaps AS (SELECT song_id, pad, row_number() OVER (PARTITION BY song_id ORDER BY pad) AS k FROM filled WHERE id IS NULL),
spare AS (SELECT song_id, id, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, ord) AS k FROM u WHERE representative AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.song_id = u.song_id AND p.id = u.id)),
pads AS (SELECT f.song_id, f.pad::INT AS pad, coalesce(f.id, s.id) AS slice_id FROM filled f LEFT JOIN gaps g USING (song_id, pad) LEFT JOIN spare s ON s.song_id = g.song_id AND s.k = g.k),
rest AS (SELECT song_id, stem, id, ord, score, representative FROM u WHERE NOT EXISTS (SELECT 1 FROM pads p WHERE p.song_id = u.song_id AND p.slice_id = u.id)
 QUALIFY row_number() OVER (PARTITION BY song_id, stem ORDER BY representative DESC, score DESC, ord) <= 20),
kept AS (SELECT song_id, slice_id, pad AS kept_ord FROM pads WHERE slice_id IS NOT NULL
 UNION ALL SELECT song_id, id, 1000 + row_number() OVER (PARTITION BY song_id ORDER BY stem, representative DESC, score DESC, ord) FROM rest)"""


@query(f"WITH {PADS} SELECT song_id, pad, slice_id FROM pads")
def q57_pads(spark, sf_dir):
    """Every song's 16 pads: dealt by stem, filled up from the stem, then from what is left."""
    return kit.choose_pads(found(spark, sf_dir), config.DEFAULTS)[0].select("song_id", "pad", "slice_id")


@query(f"WITH {PADS} SELECT song_id, slice_id, kept_ord::BIGINT AS kept_ord FROM kept")
def q58_kept_order(spark, sf_dir):
    """What a kit keeps: pads in their order, then each stem's backups."""
    return kit.choose_pads(found(spark, sf_dir), config.DEFAULTS)[1].select("song_id", "slice_id", F.col("kept_ord").cast("long"))


@query(f"""WITH {PADS} SELECT p.song_id, pad, chr((65 + (pad - 1) // 16)::INT) AS bank, (36 + (pad - 1) % 16)::INT AS midi_note, slice_id, f.stem, f.category, f.score
FROM pads p LEFT JOIN found f ON f.song_id = p.song_id AND f.id = p.slice_id""")
def q59_pad_slices(spark, sf_dir):
    """Pads with bank, note and slice; empty pads stay."""
    f = found(spark, sf_dir)
    rows = kit.pad_rows(kit.choose_pads(f, config.DEFAULTS)[0])
    return kit.pad_slices(rows, f.select("song_id", "id", "stem", "category", "score")).select("song_id", "pad", "bank", "midi_note", "slice_id", "stem", "category", "score")


@query(f"""WITH {PADS} SELECT song_id, pad, CASE WHEN song_id = 3 AND pad = 5 THEN 'c1-1' ELSE slice_id END AS slice_id FROM pads""")
def q60_swapped_pad(spark, sf_dir):
    return kit.swap_pad(q57_pads(spark, sf_dir), 3, 5, "c1-1").select("song_id", "pad", "slice_id")


# ------------------------------------------------------------------ exports and labels


@query(f"""SELECT c_custkey, replace({CLEAN.format("c_name")}, '_', ' ') || ' - ' || CASE WHEN c_acctbal > 0 THEN round_even(c_acctbal / 50, 0)::INT || 'bpm ' ELSE '' END || c_mktsegment AS folder FROM customer""")
def q61_folder_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", export.folder_name("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 50), F.col("c_mktsegment")).alias("folder"))


@query("""WITH p AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part),
k AS (SELECT p_brand, unnest(range(16)) AS i FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT k.p_brand, 3 - k.i // 4 AS line, k.i % 4 AS col, lpad(((3 - k.i // 4) * 4 + k.i % 4 + 1)::VARCHAR, 2, '0') || ' ' || coalesce(p_name, '(empty)') AS name FROM k LEFT JOIN p USING (p_brand, i)),
l AS (SELECT p_brand, line, '  ' || string_agg(rpad(left(name, 24), 24, ' '), ' | ' ORDER BY col) AS text FROM c GROUP BY 1, 2)
SELECT p_brand, string_agg(text, chr(10) ORDER BY line) AS map FROM l GROUP BY 1""")
def q62_pad_maps(spark, sf_dir):
    """Each brand's best 16 parts as a map of four by four pads."""
    p = ranking.keep_top(table(spark, sf_dir, "part"), 16, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"])
    p = ranking.stable_rank(p, "pad", ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).withColumnRenamed("p_brand", "song_id")
    slices = p.select("song_id", F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("pad").alias("kept_ord"))
    pads = p.select("song_id").distinct().withColumn("pad", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(16).cast("long"))))
    pads = pads.join(p.select("song_id", "pad", F.col("p_partkey").alias("slice_id")), ["song_id", "pad"], "left")
    return export.pad_maps(export.export_plan(pads, slices), slices).select(F.col("song_id").alias("p_brand"), "map")


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.WAV' WHEN 1 THEN url || '/Größe ' || page_id || '.Mix.Mp3' WHEN 2 THEN 'a/' || left(url, 3) || ' 夜曲·' || page_id || ' ' WHEN 3 THEN url || '/.hidden' || page_id ELSE url || '/ …' || repeat('!', (page_id % 4)::INT) || ' .Flac' END AS name FROM pages),
l AS (SELECT page_id, list_last(string_split(name, '/')) AS last FROM u), x AS (SELECT page_id, last, regexp_extract(last, '^.+(\.[^.]+)$', 1) AS suffix FROM l),
s AS (SELECT page_id, suffix, trim(regexp_replace(left(last, length(last) - length(suffix)), '[^\p{L}\p{N}_\- .()]+', '_', 'g')) AS stem FROM x)
SELECT page_id, CASE WHEN stem = '' THEN 'song' ELSE left(stem, 80) END || lower(suffix) AS upload FROM s""")
def q63_upload_name(spark, sf_dir):
    """Names of uploads: paths, letters of all scripts, hidden files, names of little but signs."""
    k, n, url = F.col("page_id") % 5, F.col("page_id").cast("string"), F.col("url")
    name = (
        F.when(k == 0, F.concat(url, F.lit(".WAV"))).when(k == 1, F.concat(url, F.lit("/Größe "), n, F.lit(".Mix.Mp3"))).when(k == 2, F.concat(F.lit("a/"), F.substring(url, 1, 3), F.lit(" 夜曲·"), n, F.lit(" ")))
        .when(k == 3, F.concat(url, F.lit("/.hidden"), n)).otherwise(F.concat(url, F.lit("/ …"), F.repeat(F.lit("!"), (F.col("page_id") % 4).cast("int")), F.lit(" .Flac")))
    )
    return table(spark, sf_dir, "pages").select("page_id", labels.upload_name(name).alias("upload"))


@query(r"""WITH s AS (SELECT p_partkey, 'drums=' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ',' ELSE '' END || ', vocals = ' || CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE (p_partkey % 9)::VARCHAR END || CASE WHEN p_partkey % 5 = 0 THEN ',=4' WHEN p_partkey % 5 = 1 THEN ',bass=1=2' ELSE '' END AS spec FROM part),
p AS (SELECT p_partkey, unnest(string_split(spec, ',')) AS part, unnest(range(len(string_split(spec, ',')))) AS i FROM s),
b AS (SELECT p_partkey, arg_min(part, i) AS part FROM p WHERE NOT regexp_matches(part, '^\s*[^=\s][^=]*=\s*[0-9]+\s*$') GROUP BY 1)
SELECT s.p_partkey, 'expected stem=count, got ' || chr(39) || b.part || chr(39) AS error FROM s LEFT JOIN b USING (p_partkey)""")
def q82_pad_split_errors(spark, sf_dir):
    """What is wrong with splits written by hand."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    spec = F.concat(
        F.lit("drums="), F.col("p_size").cast("string"), F.when(k % 3 == 0, ",").otherwise(""), F.lit(", vocals = "), F.when(k % 4 == 0, F.col("p_brand")).otherwise((k % 9).cast("string")),
        F.when(k % 5 == 0, ",=4").when(k % 5 == 1, ",bass=1=2").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", labels.pad_split_error(spec).alias("error"))


@query("SELECT event_id, (floor(value)::INT // 60) || ':' || lpad((floor(value)::INT % 60)::VARCHAR, 2, '0') AS clock FROM events")
def q64_clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", labels.clock("value").alias("clock"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Drums' WHEN 1 THEN 'work_(Vocals)_htdemucs' ELSE 'odd_' || l_returnflag END AS stem FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN lower(stem) IN ('drums', 'bass', 'vocals', 'other') OR regexp_extract(stem, '\\(([^)]+)\\)', 1) = '' THEN lower(stem) ELSE lower(regexp_extract(stem, '\\(([^)]+)\\)', 1)) END AS stem FROM f""".replace("\\\\", "\\"))
def q65_separator_stem(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    name = F.when(k == 0, "Drums").when(k == 1, "work_(Vocals)_htdemucs").otherwise(F.concat(F.lit("odd_"), "l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", labels.separator_stem(name, ("drums", "bass", "vocals", "other")).alias("stem"))


# ------------------------------------------------------------------ signals


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::FLOAT AS x, unnest(range(64)) AS i FROM embeddings),
f AS (SELECT vec_id, i, (x * CASE WHEN i < 8 THEN i / 7.0 ELSE 1 END * CASE WHEN i >= 48 THEN (63 - i) / 15.0 ELSE 1 END)::FLOAT::DOUBLE AS y FROM v)
SELECT vec_id, round(sum(abs(y)), 4) AS level, round(sum(y * i), 3) AS moment FROM f GROUP BY 1""")
def q66_fades(spark, sf_dir):
    """Vectors faded in over 8 and out over 16 values, told by two sums."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.apply_fades("embedding", 8, 16)).alias("i", "y"))
    return e.groupBy("vec_id").agg(r(F.sum(F.abs(F.col("y").cast("double")))).alias("level"), r(F.sum(F.col("y").cast("double") * F.col("i")), 3).alias("moment"))


@query("""SELECT vec_id, (vec_id % 100)::BIGINT AS n, round(coalesce(list_sum(list_transform(embedding[1:vec_id % 100], lambda x: x::DOUBLE)), 0), 6) AS total, least(vec_id % 100, 64)::BIGINT AS own FROM embeddings""")
def q67_fit_length(spark, sf_dir):
    """Vectors cut to, or filled up with zeros to, as many values as their id says."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", signal.fit_length("embedding", (F.col("vec_id") % 100).cast("int")).alias("x"))
    return e.select("vec_id", F.size("x").cast("long").alias("n"), r(signal.total("x"), 6).alias("total"), F.least(F.size("x"), F.lit(64)).cast("long").alias("own"))


# ------------------------------------------------------------------ analysis


@query(f"""WITH s AS (SELECT user_id AS song_id, count(*) AS n, max(t_s) AS duration_s, min(event_id) % 3 * 40 AS bpm FROM ({EVENTS}) GROUP BY 1),
g AS (SELECT song_id, unnest(range(0, greatest(ceil(duration_s / 86400 / 0.5)::BIGINT, 1))) * 0.5 AS t_s FROM s WHERE bpm <= 0 OR n < 20)
SELECT song_id, round(t_s, 3) AS t_s FROM g""")
def q68_beat_fallback(spark, sf_dir):
    """A beat every half second for songs without a tempo or with too few beats."""
    s = events(spark, sf_dir).groupBy(F.col("user_id").alias("song_id")).agg(F.count("*").alias("n"), (F.max("t_s") / 86400).alias("duration_s"), (F.min("event_id") % 3 * 40).alias("bpm"))
    return analysis.fallback_beats(s.where("bpm <= 0 or n < 20")).select("song_id", r("t_s", 3).alias("t_s"))


@query("""SELECT user_id AS song_id, event_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM (SELECT user_id, event_id, value AS start_s, value + event_id % 20 * 0.05 AS end_s FROM events)
WHERE round(end_s, 3) - round(start_s, 3) > 0.5000001""")
def q69_section_filter(spark, sf_dir):
    """Sections of more than half a second."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("song_id"), "event_id", F.col("value").alias("start_s"), (F.col("value") + F.col("event_id") % 20 * 0.05).alias("end_s"))
    return analysis.long_sections(e, 0.5000001)


# ------------------------------------------------------------------ jobs and views


LOG = """SELECT user_id::VARCHAR AS song_id, ['ingest', 'separate', 'analyze', 'pick', 'render', 'split'][(event_id % 6 + 1)::INT] AS stage, arg_max(CASE WHEN value < 30 THEN 'failed' ELSE 'done' END, struct_pack(t := ts, e := event_id)) AS status
FROM events GROUP BY 1, 2"""


def stage_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, jobs.STAGES)), (F.col("event_id") % 6 + 1).cast("int"))
    log = e.select(F.col("user_id").cast("string").alias("song_id"), stage.alias("stage"), F.when(F.col("value") < 30, "failed").otherwise("done").alias("status"), *TIME)
    return jobs.latest_status(log, by=["song_id", "stage"], order=TIME, value="status")


@query(f"""WITH l AS ({LOG}), want AS (SELECT song_id, unnest(['ingest', 'separate', 'analyze', 'pick', 'render']) AS stage, unnest(range(5)) AS i FROM (SELECT DISTINCT song_id FROM l)),
s AS (SELECT w.*, coalesce(status, 'todo') AS status FROM want w LEFT JOIN l USING (song_id, stage))
SELECT song_id, stage FROM s WHERE i >= (SELECT min(i) FROM s b WHERE b.song_id = s.song_id AND b.status <> 'done')""")
def q70_todo(spark, sf_dir):
    """The stages that each song still has to run: the first that isn't done, and all after it."""
    return jobs.todo(stage_log(spark, sf_dir), "kit")


@query(f"""WITH l AS ({LOG}), q AS (SELECT user_id::VARCHAR AS song_id, min(event_id) AS e FROM events GROUP BY 1),
d AS (SELECT song_id, list(stage) FILTER (status = 'done') AS done FROM l GROUP BY 1),
w AS (SELECT q.song_id, coalesce(done, []::VARCHAR[]) AS done, CASE e % 6 WHEN 0 THEN 'pick' WHEN 1 THEN 'split' END AS alone, CASE e % 6 WHEN 2 THEN 'analyze' END AS start_at, CASE WHEN e % 5 > 0 THEN 'x' END AS source, e % 11 = 0 AS force FROM q LEFT JOIN d USING (song_id)),
x AS (SELECT *, CASE WHEN force THEN [] WHEN alone = 'split' THEN done WHEN alone = 'pick' THEN list_filter(done, lambda s: s IN ('ingest', 'separate', 'analyze')) WHEN start_at = 'analyze' THEN list_filter(done, lambda s: s IN ('ingest', 'separate')) ELSE done END AS have FROM w),
m AS (SELECT *, list_filter(['ingest', 'separate', 'analyze', 'pick', 'render'], lambda s: NOT list_contains(have, s)) AS missing FROM x)
SELECT song_id, CASE WHEN alone = 'split' THEN '' WHEN alone = 'pick' THEN CASE WHEN len(list_filter(missing, lambda s: s IN ('ingest', 'separate', 'analyze'))) > 0 THEN '' ELSE 'pick' END
  WHEN list_contains(missing, 'ingest') AND source IS NULL THEN '' ELSE array_to_string(missing, ',') END AS stages,
 CASE WHEN alone = 'split' THEN 'the kit mode has no stage split' WHEN alone = 'pick' THEN CASE WHEN len(list_filter(missing, lambda s: s IN ('ingest', 'separate', 'analyze'))) > 0 THEN 'can''t run pick before ' || array_to_string(list_filter(missing, lambda s: s IN ('ingest', 'separate', 'analyze')), ', ') END
  WHEN list_contains(missing, 'ingest') AND source IS NULL THEN 'no input' END AS error FROM m""")
def q83_run_plans(spark, sf_dir):
    """What each song's next run does: one stage, all from one on, or what is missing; forced ones begin anew."""
    e = F.col("e")
    asked = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("song_id")).agg(F.min("event_id").alias("e"))
    asked = asked.select(
        "song_id", F.lit("kit").alias("mode"), F.when(e % 6 == 0, "pick").when(e % 6 == 1, "split").alias("only"), F.when(e % 6 == 2, "analyze").alias("start_at"), (e % 11 == 0).alias("force"),
        F.when(e % 5 > 0, "x").alias("source"), F.lit(None).cast("string").alias("previous"), F.lit(True).alias("satisfied"),
    )
    return jobs.run_plans(asked, stage_log(spark, sf_dir)).select("song_id", F.array_join("stages", ",").alias("stages"), "error")


@query(f"""WITH l AS ({LOG}) SELECT * FROM l WHERE stage IN ('ingest', 'separate')""")
def q71_invalidated(spark, sf_dir):
    return jobs.invalidate_from(stage_log(spark, sf_dir), "analyze").select("song_id", "stage", "status")


@query(f"""WITH l AS ({LOG}), s AS (SELECT user_id::VARCHAR AS song_id, min(event_id) % 4 = 0 AS changed, min(event_id) % 7 = 0 AS forced FROM events GROUP BY 1)
SELECT l.* FROM l JOIN s USING (song_id) WHERE NOT (changed OR forced)""")
def q72_changed_sources(spark, sf_dir):
    """What stays of the stages of jobs whose source is another now, or that are forced: nothing."""
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("song_id")).agg(F.min("event_id").alias("e"))
    now = s.select("song_id", F.lit("b").alias("source"), (F.col("e") % 7 == 0).alias("force"))
    before = s.select("song_id", F.when(F.col("e") % 4 == 0, "a").otherwise("b").alias("source"))
    return jobs.still_valid(stage_log(spark, sf_dir), before, now).select("song_id", "stage", "status")


@query("""SELECT o_orderkey AS job, CASE WHEN o_custkey % 5 = 0 THEN 'recalled' ELSE o_orderstatus END AS status FROM orders""")
def q73_upsert(spark, sf_dir):
    """Records replaced by those of equal keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return jobs.upsert(o.select("job", "status"), o.where("o_custkey % 5 = 0").select("job", F.lit("recalled").alias("status")), ["job"])


@query("""SELECT o_orderkey AS job, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' END AS error FROM orders""")
def q74_recovered(spark, sf_dir):
    """After a restart what was queued or running has failed."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    return jobs.recovered(o).select("job", "status", "error")


@query(f"""WITH l AS ({LOG}), w AS (SELECT song_id AS job, unnest(['ingest', 'separate', 'analyze', 'split']) AS stage, unnest(['Loading', 'Separating the vocals', 'Analyzing tempo and key', 'Writing the acapella and instrumental']) AS label FROM (SELECT DISTINCT song_id FROM l))
SELECT job, w.stage, label, coalesce(CASE status WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' END, 'todo') AS state FROM w LEFT JOIN l ON l.song_id = w.job AND l.stage = w.stage""")
def q75_progress(spark, sf_dir):
    """Every stage of every job with its label and state."""
    log = stage_log(spark, sf_dir).withColumnRenamed("song_id", "job")
    state = views.progress(log, jobs.MODES["split"])
    return state.withColumn("label", jobs.stage_label("stage", "split")).select("job", "stage", "label", "state")


@query("""WITH p AS (SELECT page_id, ['analysis.json', 'work.wav', 'slices/a b.wav', 'split/x.mp3', 'slices/../kit.wav', 'kit.json', 'split/x.ogg', 'slices/d/e.wav'][(page_id % 8 + 1)::INT] AS path FROM pages)
SELECT page_id, path, path IN ('analysis.json', 'work.wav', 'slices/a b.wav', 'split/x.mp3') AS allowed FROM p""")
def q76_allowed_files(spark, sf_dir):
    paths = ("analysis.json", "work.wav", "slices/a b.wav", "split/x.mp3", "slices/../kit.wav", "kit.json", "split/x.ogg", "slices/d/e.wav")
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 8 + 1).cast("int")).alias("path"))
    return p.withColumn("allowed", views.allowed_file(F.col("path")))


@query(f"""WITH {PADS}, e AS (SELECT song_id, max(ord) / 100.0 AS last_s FROM found GROUP BY 1)
SELECT song_id, CASE WHEN song_id % 3 = 0 THEN round(last_s, 2) ELSE song_id::DOUBLE END AS duration_s FROM e""")
def q77_durations(spark, sf_dir):
    """The analysed duration, else the end of the last slice."""
    f = found(spark, sf_dir)
    known = f.select("song_id").distinct().withColumn("duration_s", F.when(F.col("song_id") % 3 != 0, F.col("song_id").cast("double")))
    return views.durations(known, f.select("song_id", (F.col("ord") / 100).alias("source_end_s"))).select("song_id", r("duration_s", 2).alias("duration_s"))


@query("""WITH p AS (SELECT o_orderpriority AS song_id, o_orderkey AS slice_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pad FROM orders)
SELECT song_id, pad, slice_id FROM p WHERE pad BETWEEN 17 AND 32""")
def q78_bank_page(spark, sf_dir):
    p = ranking.stable_rank(table(spark, sf_dir, "orders"), "pad", ["o_orderpriority"], ["o_orderkey"])
    return views.bank_page(p.select(F.col("o_orderpriority").alias("song_id"), "pad", F.col("o_orderkey").alias("slice_id")), 1)


@query(f"""WITH s AS (SELECT user_id AS job, event_type AS step, t_s AS at_s FROM ({EVENTS})), l AS (SELECT job, arg_max(step, at_s) AS step, max(at_s) AS at_s FROM s GROUP BY 1)
SELECT job, step, round(at_s, 3) AS at_s FROM l WHERE 2592000 - at_s < 86400""")
def q79_last_steps(spark, sf_dir):
    """The last step of each job, if it is no older than a day."""
    steps = events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("t_s").alias("at_s"))
    return views.last_steps(steps, 2592000.0).select("job", "step", r("at_s", 3).alias("at_s"))


@query(f"""WITH s AS (SELECT n_nationkey AS song_id, n_name AS song, n_regionkey AS k FROM nation)
SELECT song_id, json_object('song', trim(song), 'bpm', 90.0 + k, 'key', 'F minor', 'format', 'wav', 'sample_rate', 48000, 'bit_depth', 24, 'normalized', false, 'vocal_model', 'quick',
 'files', json_object('acapella', 'split/' || trim(song) || '_acapella.wav', 'instrumental', 'split/' || trim(song) || '_instrumental.wav'), 'stems', json_object(), 'original', 'work.wav')::VARCHAR AS split FROM s""")
def q80_split_documents(spark, sf_dir):
    """What a split song's document says of its files."""
    n = table(spark, sf_dir, "nation")
    n = n.select(F.col("n_nationkey").alias("song_id"), labels.sanitised_song("n_name").alias("song"), (90.0 + F.col("n_regionkey")).alias("bpm"), F.lit("F minor").alias("key"))
    files = n.select("song_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.concat(F.lit("split/"), "song", F.lit(f"_{p}.wav")).alias("file")) for p in ("acapella", "instrumental")])).alias("f"))
    return render.split_documents(n, files.select("song_id", "f.part", "f.file"), rate=48000, bits=24, vocal_model="quick").select("song_id", "split")


@query("""SELECT song_id, stem, lane, place, on_pads FROM (SELECT p_brand AS song_id, p_type AS stem, '9' || p_type AS lane, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY round(p_retailprice / 10, 4) DESC, p_partkey) AS place,
 CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 16 + 1)::VARCHAR END AS on_pads FROM part)""")
def q81_slice_lanes(spark, sf_dir):
    """Slices in lanes by stem, longest first, with the pads that hold them."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "song_id")
    slices = p.select("song_id", F.col("p_partkey").alias("id"), F.col("p_type").alias("stem"), F.lit(0.0).alias("source_start_s"), (F.col("p_retailprice") / 10).alias("source_end_s"))
    pads = p.where("p_partkey % 3 = 0").select("song_id", (F.col("p_partkey") % 16 + 1).alias("pad"), F.col("p_partkey").alias("slice_id"))
    found = views.lanes(slices, pads)
    return found.select("song_id", "stem", "lane", "place", F.array_join("on_pads", ",").alias("on_pads"))
