"""What a viewer asks of kits and jobs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranking

LANES = ("drums", "bass", "vocals", "other")


def lanes(slices: DataFrame, pads: DataFrame) -> DataFrame:
    """Slices with their lane (known stems first, others by name), place in it (longest first) and pads."""
    length = F.col("source_end_s") - F.col("source_start_s")
    place = F.array_position(F.array(*map(F.lit, LANES)), F.col("stem"))
    lane = F.concat(F.when(place > 0, place).otherwise(9).cast("string"), F.col("stem"))
    on = pads.where("slice_id is not null").groupBy("song_id", F.col("slice_id").alias("id")).agg(F.sort_array(F.collect_list("pad")).alias("on_pads"))
    rows = slices.withColumns({"lane": lane, "length_s": F.round(length, 4)}).join(on, ["song_id", "id"], "left")
    return ranking.stable_rank(rows, "place", ["song_id", "lane"], [F.desc("length_s"), "id"])


def durations(analysis: DataFrame, slices: DataFrame) -> DataFrame:
    """song_id, duration_s: the analysed one, else the end of the last slice."""
    last = slices.groupBy("song_id").agg(F.max("source_end_s").alias("last_s"))
    both = analysis.select("song_id", "duration_s").join(last, "song_id", "full")
    return both.select("song_id", F.coalesce("duration_s", "last_s").alias("duration_s"))


def bank_page(pads: DataFrame, bank: int) -> DataFrame:
    """The 16 pads of a bank, from 0."""
    return pads.where(F.col("pad").between(16 * bank + 1, 16 * bank + 16))  # a bound, so ranked pads are limited before they are dealt out


def progress(status: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """job, stage, state: done, failed, active or todo for every stage of every job; ``status`` is (job, stage, status)."""
    jobs = status.select("job").distinct()
    every = jobs.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    state = F.when(F.col("status") == "done", "done").when(F.col("status") == "failed", "failed").when(F.col("status") == "running", "active").otherwise("todo")
    return every.join(status, ["job", "stage"], "left").select("job", "stage", state.alias("state"))


def last_steps(steps: DataFrame, now_s: float, within_s: float = 86_400) -> DataFrame:
    """The last step each job told of, if that is recent: what it was doing when it stopped."""
    last = steps.groupBy("job").agg(F.max_by("step", "at_s").alias("step"), F.max("at_s").alias("at_s"))
    return last.where(F.lit(now_s) - F.col("at_s") < within_s)


def allowed_file(path: Column) -> Column:
    """Whether a job's file may be handed out."""
    return path.rlike(r"^(analysis\.json|work\.wav|slices/[^/]+\.wav|split/[^/]+\.(wav|flac|mp3))$")
