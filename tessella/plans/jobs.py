"""Stage status of jobs, as tables: latest rows, invalidation, queue and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import labels

STAGES = ("ingest", "separate", "analyze", "pick", "render", "split")
MODES = {"kit": ("ingest", "separate", "analyze", "pick", "render"), "split": ("ingest", "separate", "analyze", "split")}


#: What a stage is called while it runs.
LABELS = {
    "ingest": "Loading", "separate": "Separating stems", "analyze": "Analyzing tempo and key", "pick": "Finding the best moments",
    "render": "Building your kit", "split": "Writing the acapella and instrumental",
}


def stage_label(stage, mode: str):
    """A column of labels; a split only separates the vocals."""
    said = LABELS | ({"separate": "Separating the vocals"} if mode == "split" else {})
    return F.create_map(*[F.lit(x) for s in MODES[mode] for x in (s, said[s])])[F.col(stage)]


def latest_status(log: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key; one aggregation, no sort of a key's rows."""
    return log.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def with_validity(latest: DataFrame, *, job: str, stage: str, status: str, stages: int) -> DataFrame:
    """Add ``valid``: whether the stage and all before it are done."""
    first = latest.where(F.col(status) != "done").groupBy(job).agg(F.min(stage).alias("_first"))
    out = latest.join(first, job, "left")
    return out.withColumn("valid", F.col(stage) < F.coalesce("_first", F.lit(stages))).drop("_first")


def invalidate_from(stages: DataFrame, first: str) -> DataFrame:
    """Drop a stage and all later ones of the whole list."""
    return stages.where(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) < STAGES.index(first) + 1)


def still_valid(stages: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Stages of the jobs whose source is the same as before and that aren't forced; those of others all go.

    ``before`` is (song_id, source), ``now`` is (song_id, source, force).
    """
    old = before.select("song_id", F.col("source").alias("_old"))
    other = now.join(old, "song_id", "left").where(F.col("force") | (F.col("_old").isNotNull() & (F.col("_old") != F.col("source"))))
    return stages.join(other.select("song_id"), "song_id", "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys."""
    return table.join(changes, keys, "left_anti").unionByName(changes)


def recovered(records: DataFrame) -> DataFrame:
    """After a restart, what was queued or running has failed."""
    lost = F.col("status").isin("queued", "running")
    return records.withColumns({"error": F.when(lost, F.lit("interrupted")).otherwise(F.col("error")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def todo(done: DataFrame, mode: str) -> DataFrame:
    """(song_id, stage) still to run: of each song the first stage that isn't done, and all after it."""
    wanted = F.array(*map(F.lit, MODES[mode]))
    have = done.where(F.col("status") == "done").groupBy("song_id").agg(F.collect_set("stage").alias("_have"))
    songs = done.select("song_id").distinct().join(have, "song_id", "left")
    first = F.coalesce(F.get(F.filter(wanted, lambda s: ~F.array_contains(F.coalesce("_have", F.array().cast("array<string>")), s)), 0), F.lit(""))
    rest = F.when(first != "", F.slice(wanted, F.array_position(wanted, first).cast("int"), len(MODES[mode]))).otherwise(F.array().cast("array<string>"))
    return songs.select("song_id", F.explode(rest).alias("stage"))


def _words(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def run_plans(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Add to requests what their runs do: ``dropped`` stages, ``stages`` to run in order, ``error``.

    A request is (song_id, mode, only, start_at, force, source, previous,
    satisfied): one stage alone or all from one on, the input and that of the run
    before, and whether what has been separated is what the mode needs.
    ``status`` is (song_id, stage, status). With an error nothing runs.
    """
    done = status.where("status = 'done'").groupBy("song_id").agg(F.collect_set("stage").alias("_done"))
    rows = requests.join(done, "song_id", "left").withColumn("_done", F.coalesce("_done", _words(())))
    every = F.coalesce(*[F.when(F.col("mode") == m, _words(s)) for m, s in MODES.items()], _words(()))
    order = _words(STAGES)

    def onward(stage: Column) -> Column:
        place = F.array_position(order, stage)
        return F.when(place > 0, F.slice(order, F.greatest(place, F.lit(1)).cast("int"), len(STAGES))).otherwise(_words(()))

    anew = F.coalesce("force", F.lit(False)) | F.coalesce(F.col("source") != F.col("previous"), F.lit(False))
    only, start = F.col("only"), F.col("start_at")
    first = F.when(anew, order).otherwise(_words(()))
    first = F.array_union(first, F.when(only.isNotNull(), onward(only)).when(start.isNotNull(), onward(start)).otherwise(_words(())))
    rows = rows.withColumns({"_every": every, "_first": first})
    have = F.array_except("_done", "_first")
    again = only.isNull() & F.array_contains(have, "separate") & ~F.coalesce("satisfied", F.lit(True))
    depends = F.array_union(_words(("separate",)), F.array_intersect(F.col("_every"), _words(("pick", "render", "split"))))
    rows = rows.withColumn("_dropped", F.array_union("_first", F.when(again, depends).otherwise(_words(()))))
    rows = rows.withColumn("_have", F.array_except("_done", "_dropped"))
    todo = F.when(only.isNotNull(), F.array(only)).otherwise(F.array_except("_every", "_have"))
    before = F.slice("_every", 1, F.greatest(F.array_position("_every", only) - 1, F.lit(0)).cast("int"))
    rows = rows.withColumns({"_todo": todo, "_missing": F.when(only.isNotNull(), F.array_except(before, "_have")).otherwise(_words(()))})
    error = (
        F.when(F.size("_every") == 0, F.concat(F.lit("unknown mode "), F.coalesce("mode", F.lit("none"))))
        .when(only.isNotNull() & ~F.array_contains("_every", only), F.concat(F.lit("the "), F.col("mode"), F.lit(" mode has no stage "), only))
        .when(F.array_contains("_todo", "ingest") & F.col("source").isNull(), "no input")
        .when(F.size("_missing") > 0, F.concat(F.lit("can't run "), only, F.lit(" before "), F.array_join("_missing", ", ")))
    )
    refused = F.array_contains(F.array(F.size("_every") == 0, F.coalesce(only.isNotNull() & ~F.array_contains("_every", only), F.lit(False))), True)
    dropped = F.when(refused, _words(())).otherwise(F.array_sort(F.array_intersect("_dropped", "_done")))
    return rows.select(*requests.columns, dropped.alias("dropped"), F.when(error.isNull(), F.col("_todo")).otherwise(_words(())).alias("stages"), error.alias("error"))


def stage_runs(log: DataFrame) -> DataFrame:
    """song_id, stage, status, started, seconds, error of each stage's last run, of (song_id, stage, status, at, error).

    A run begins with 'running' and ends with 'done' or 'failed'; one that hasn't ended has no seconds.
    """
    last = log.where("status = 'running'").groupBy("song_id", "stage").agg(F.max("at").alias("started"))
    ended = F.struct(F.col("at"), F.col("status"), F.col("error"))
    own = log.where("status <> 'running'").join(last, ["song_id", "stage"], "left").where("started is null or at >= started")
    ends = own.groupBy("song_id", "stage").agg(F.max(ended).alias("e"))
    both = last.join(ends, ["song_id", "stage"], "full")
    seconds = F.round(F.col("e.at").cast("double") - F.col("started").cast("double"), 2)
    return both.select("song_id", "stage", F.coalesce("e.status", F.lit("running")).alias("status"), "started", seconds.alias("seconds"), "e.error")


def checked_options(forms: DataFrame) -> DataFrame:
    """Add ``options``, those that were set, and ``errors``, one for each rule that a form breaks.

    A form is (pads, model, format, hq_vocals, fast, normalize, include_stems).
    """
    given = {c: F.when(labels.stripped(c) != "", F.col(c)) for c in ("pads", "model", "format")}
    pairs = labels.pad_pairs("pads")
    count = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["count"], F.lit(0)))
    broken = labels.pad_split_error("pads")
    pads = F.when(broken.isNotNull(), F.concat(F.lit("pad split: "), broken)).when(~count.isin(16, 32, 64), F.concat(F.lit("pad split: "), count.cast("string"), F.lit(" pads; there are 16, 32 or 64")))
    errors = F.array(
        F.when(given["pads"].isNotNull(), pads),
        F.when(given["model"].isNotNull() & ~F.col("model").rlike(r"^[\p{L}\p{N}_.\-]+$"), "unknown model name"),
        F.when(given["format"].isNotNull() & ~F.col("format").isin("wav", "flac", "mp3"), "format must be wav, flac or mp3"),
    )
    flags = {c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit("true")) for c in ("hq_vocals", "fast", "normalize", "include_stems")}
    entries = F.array(*[F.struct(F.lit(c).alias("key"), v.alias("value")) for c, v in {**given, **flags}.items()])
    options = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return forms.withColumns({"options": options, "errors": F.array_compact(errors)})
