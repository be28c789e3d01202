"""Choosing pads and backups, and the kit's slices and pads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import labels
from tessella.operators import intervals, ranking
from tessella.plans.analysis import Analysis

#: The order in which categories of a stem are dealt.
CATEGORY_ORDER = {
    "drums": ("kick", "snare", "hat", "perc", "drum_loop"), "bass": ("bass_loop", "bass_note"),
    "vocals": ("vox_chop", "vox_phrase"), "other": ("other_loop", "stab"),
}

#: Candidates that a task ranks, about; a song's stay together.
TASK_ROWS = 1 << 16

#: Slices that a task joins with pads, about.
JOIN_ROWS = 1 << 19


def tasks(rows: DataFrame, each: int) -> int:
    """As many tasks as make about ``each`` rows each."""
    return max(1, math.ceil(rows.count() / each))


def category_rank():
    """A column that sorts categories as they are dealt; those of other stems go by name."""
    known = [F.when((F.col("stem") == s) & (F.col("category") == c), F.lit(f"{i:02d}")) for s, order in CATEGORY_ORDER.items() for i, c in enumerate(order)]
    return F.coalesce(*known, F.col("category"))


def choices(found: DataFrame, cfg: dict) -> DataFrame:
    """Every candidate with ``pad`` and ``kept_ord``, null where it has none.

    Pads are dealt by stem among the representatives above the floor, then filled
    up from the stem, then from the song; backups are the best of what is left of
    each stem. All ranks are windows within a song, so its rows, a few thousand at
    most, are brought together once, and nothing is joined. A task holds a sort for
    each window, so songs are dealt out to as many tasks as make ``TASK_ROWS``
    each, whatever the session's partitions. Rows that share an id with one that
    has a pad are on it as well, and are dealt no more.
    """
    kit = cfg["kit"]
    names, total = list(kit["pad_split"]), sum(kit["pad_split"].values())
    first = {s: sum(kit["pad_split"][x] for x in names[:i]) for i, s in enumerate(names)}
    count, base = (F.coalesce(F.create_map(*[F.lit(x) for s in names for x in (s, v[s])])[F.col("stem")], F.lit(0)) for v in (kit["pad_split"], first))
    known = F.create_map(*[F.lit(x) for s, order in CATEGORY_ORDER.items() for x in (s, "|".join(order))])
    listed = F.coalesce(F.array_contains(F.split(known[F.col("stem")], r"\|"), F.col("category")), F.lit(True))
    song, stem, same = (Window.partitionBy(*by) for by in (["song_id"], ["song_id", "stem"], ["song_id", "id"]))
    best_first = [F.desc("score"), "ord"]

    rows = found.repartition(tasks(found, TASK_ROWS), "song_id").withColumns({"_usable": F.coalesce(F.col("score") > 0, F.lit(False)), "_count": count, "_turn": category_rank()})
    rep = F.col("_usable") & F.coalesce("representative", F.lit(False))
    rows = rows.withColumn("_best", F.max(F.when(rep, F.col("score"))).over(stem))
    good = rep & F.coalesce(F.col("score") >= kit["min_relative_score"] * F.col("_best"), F.lit(False)) & listed & (F.col("_count") > 0)
    rows = ranking.deal_ranks(rows, group=["song_id", "stem"], queue="category", queue_order="_turn", score="score", ties="ord", count=F.col("_count"), among=good)
    rows = rows.withColumns({"_had": F.count("deal_rank").over(stem), "_free": F.col("_usable") & (F.count("deal_rank").over(same) == 0)})
    more = F.row_number().over(Window.partitionBy("song_id", "stem", "_free").orderBy(*best_first))
    rows = rows.withColumn("_slot", F.coalesce("deal_rank", F.when(F.col("_free"), F.col("_had") + more)))
    rows = rows.withColumn("pad", F.when(F.col("_slot") <= F.col("_count"), base + F.col("_slot")).cast("int"))
    # The k-th pad that is still empty gets the k-th best representative that is on none.
    every = F.sequence(F.lit(1), F.lit(total))
    rows = rows.withColumns({"_empty": F.array_except(every, F.collect_set("pad").over(song)), "_left": rep & (F.count("pad").over(same) == 0)})
    extra = F.row_number().over(Window.partitionBy("song_id", "_left").orderBy(*best_first))
    rows = rows.withColumn("pad", F.coalesce("pad", F.when(F.col("_left"), F.get("_empty", extra - 1))))
    rows = rows.withColumn("_spare", F.col("_usable") & (F.count("pad").over(same) == 0))
    order = [F.desc("representative"), *best_first]
    rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy("song_id", "stem", "_spare").orderBy(*order)))
    rows = rows.withColumn("_spare", F.col("_spare") & (F.col("_b") <= kit["backups_per_stem"]))
    backup = F.row_number().over(Window.partitionBy("song_id", "_spare").orderBy("stem", *order))
    kept = F.coalesce("pad", F.when(F.col("_spare"), F.lit(1000) + backup))
    return rows.select(*found.columns, "pad", kept.cast("int").alias("kept_ord"))


def chosen_pads(chosen: DataFrame, cfg: dict) -> DataFrame:
    """song_id, pad, slice_id of all pads of all songs; empty ones stay."""
    on = F.map_from_entries(F.collect_list(F.when(F.col("pad").isNotNull(), F.struct("pad", "id"))))
    songs = chosen.groupBy("song_id").agg(on.alias("on"))
    every = F.explode(F.sequence(F.lit(1), F.lit(sum(cfg["kit"]["pad_split"].values()))))
    return songs.select("song_id", "on", every.alias("pad")).select("song_id", "pad", F.col("on")[F.col("pad")].alias("slice_id"))


def chosen_slices(chosen: DataFrame) -> DataFrame:
    """song_id, slice_id, kept_ord of pads, then backups."""
    return chosen.where("kept_ord is not null").select("song_id", F.col("id").alias("slice_id"), "kept_ord")


def choose_pads(found: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(song_id, pad, slice_id), and (song_id, slice_id, kept_ord) of pads, then backups."""
    chosen = choices(found, cfg)
    return chosen_pads(chosen, cfg), chosen_slices(chosen)


def build(found: DataFrame, pads: DataFrame, kept: DataFrame, analysis: Analysis, cfg: dict, notes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(slices, pads): labels, files, sections and render settings of what is kept; ``notes`` is (song_id, id, note)."""
    r = cfg["render"]
    s = found.join(kept.withColumnRenamed("slice_id", "id"), ["song_id", "id"])
    s = s.join(notes, ["song_id", "id"], "left") if notes is not None else s.withColumn("note", F.lit(None).cast("string"))
    s = s.join(analysis.songs.select("song_id", "bpm", "key_short"), "song_id")
    s = s.withColumns({"source_start_s": F.round(F.col("start") / F.col("rate"), 4), "source_end_s": F.round(F.col("end") / F.col("rate"), 4), "_at": F.col("start") / F.col("rate")})
    sections = analysis.sections.select("song_id", F.col("idx").alias("_si"), F.col("label").alias("section"), F.col("start_s").alias("_ss"), F.col("end_s").alias("_se"))
    s = intervals.first_interval(s, sections, point="_at", start="_ss", end="_se", index="_si", label="section", width=20.0, id_col="id", keys=["song_id"])
    s = ranking.stable_rank(s, "_n", ["song_id", "category"], ["kept_ord"])
    args = ("stem", "kind", "category", "_n", "bars", "note")
    loop = F.col("kind") == "loop"
    fade = {k: F.when(loop, r["loop_fade_ms"]).otherwise(r[k]).cast("double") for k in ("fade_in_ms", "fade_out_ms")}
    level = F.lit(r["normalize_dbfs"] if r["normalize"] else None).cast("double")
    slices = s.select(
        "song_id", "id", "stem", "kind", "category", labels.slice_label(*args).alias("label"),
        F.concat(F.lit("slices/"), labels.slice_file(*args, labels.suffix("bpm", "key_short")), F.lit(".wav")).alias("file"),
        "start", "end", "source_start_s", "source_end_s", "bars", "beats", "note", "section", "score",
        F.struct("isolation", "clarity", "loudness", "loopability", "uniqueness").alias("score_parts"), "cluster",
        F.struct(fade["fade_in_ms"].alias("fade_in_ms"), fade["fade_out_ms"].alias("fade_out_ms"), level.alias("normalize_dbfs"), F.lit(False).alias("reverse"), F.when(loop, "loop").otherwise("one_shot").alias("playback")).alias("render"),
        "kept_ord",
    )
    return slices, pad_rows(pads)


def pad_rows(pads: DataFrame) -> DataFrame:
    """Pads with their bank and note."""
    i = F.col("pad") - 1
    return pads.select("song_id", "pad", labels.bank(i).alias("bank"), (F.lit(36) + F.pmod(i, F.lit(16))).alias("midi_note"), "slice_id")


def kit_documents(slices: DataFrame, pads: DataFrame, analysis: Analysis) -> DataFrame:
    """song_id, kit: one JSON document a song. Its lists are bounded by the pads and backups."""
    p = pads.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("pad", "bank", "midi_note", "slice_id"))).alias("pads"))
    columns = ["kept_ord", *[c for c in slices.columns if c not in ("song_id", "kept_ord", "start", "end")]]
    s = slices.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: a["kept_ord"] - b["kept_ord"]).alias("slices"))
    facts = analysis.songs.select("song_id", F.struct(*[c for c in analysis.songs.columns if c != "song_id"]).alias("analysis"))
    every = facts.join(p, "song_id").join(s, "song_id", "left")
    name = F.concat("song_id", F.lit(" Kit")).alias("kit_name")
    return every.select("song_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), name, "analysis", "pads", "slices")).alias("kit"))


def swap_pad(pads: DataFrame, song, pad: int, slice_id: str | None) -> DataFrame:
    """Put another slice on one pad."""
    here = (F.col("song_id") == song) & (F.col("pad") == pad)
    return pads.withColumn("slice_id", F.when(here, F.lit(slice_id)).otherwise(F.col("slice_id")))


def pad_slices(pads: DataFrame, slices: DataFrame) -> DataFrame:
    """Pads with their slices; empty pads stay. The join has a task for each ``JOIN_ROWS`` slices, whatever the session's partitions."""
    by, n = ["song_id", "slice_id"], tasks(slices, JOIN_ROWS)
    return pads.repartition(n, *by).join(slices.withColumnRenamed("id", "slice_id").repartition(n, *by), by, "left")
