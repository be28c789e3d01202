"""Windows over event streams, and the state of jobs from their log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.plans.jobs import STAGES


def levels(events: DataFrame, *, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Root mean square of each type in tumbling or sliding windows; data later than ``late`` is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-10).alias("rms"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "rms", "n")


def sounding(events: DataFrame, *, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    """Each user's runs of events without a gap, as session windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_STATE = "done int, failed boolean"


def _advance(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, failed = state.get if state.exists else (0, False)
    for rows in groups:
        for r in rows.sort_values("at").itertuples(index=False):
            place = STAGES.index(r.stage) if r.stage in STAGES else -1
            if r.status == "done" and place >= 0:
                done, failed = done | 1 << place, False
            elif r.status in ("running", "failed") and place >= 0:
                done, failed = done & (1 << place) - 1, r.status == "failed"
    state.update((done, failed))
    first = next((s for i, s in enumerate(STAGES) if not done >> i & 1), None)
    yield pd.DataFrame({"job": [key[0]], "next_stage": [first], "n_done": [done.bit_count()], "failed": [failed]})


def job_progress(log: DataFrame) -> DataFrame:
    """A row for each job whenever its log (job, stage, status, at) goes on; a stage that runs again undoes later ones."""
    return log.groupBy("job").applyInPandasWithState(
        _advance, "job string, next_stage string, n_done int, failed boolean", _STATE, "update", GroupStateTimeout.NoTimeout
    )
