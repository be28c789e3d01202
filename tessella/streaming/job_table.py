"""The job table as the sink of a stream of requests and reports.

Each batch writes the rows that it changes, under its own number, and an answer
to each of its requests; the table is the newest row of every job. A batch is
judged on the rows of smaller numbers only, so replaying one writes the same
files again and changes nothing. Now and then the newest rows are put together
under the number of the last batch, and what they replace is removed one round
later, so readers of the old files are not cut off.

A job's events take effect in the order of ``at``, then ``seq``: 'submit' makes a
job, 'continue' runs another mode on a finished one and merges its options,
'delete' removes a finished one, 'start' and 'finish' report on it ('finish' with an
error makes it failed), 'mark' sets one stage, 'update' sets facts. What can't be
done is answered by 404 (no such job) or 409 (still running, or there already)
and has no effect.

Defined results: events of a null job are answered by 404; rows equal in
everything count one after the other; an unknown kind is answered by 400;
an empty batch writes empty files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.workers import prepare

EVENTS = "job string, at timestamp, seq long, kind string, name string, mode string, stage string, status string, error string, options map<string,string>, facts map<string,string>"
JOBS = (
    "job string, name string, mode string, status string, error string, created timestamp, started timestamp, finished timestamp, "
    "options map<string,string>, stages map<string,string>, facts map<string,string>, gone boolean"
)
ANSWERS = "job string, at timestamp, seq long, kind string, code int, said string"
#: Batches after which the newest rows are put together.
EVERY = 20
BUSY = ("queued", "running")
_NAMES = [x.split()[0] for x in JOBS.split(", ")]


def _none(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else v


def _map(v) -> dict:
    return dict(v) if v is not None and not isinstance(v, float) else {}


def step(row: dict | None, e: dict) -> tuple[dict | None, int, str]:
    """(the job after an event, the answer's code and words); a deleted job is a row that says so."""
    kind, there = e["kind"], row is not None and not row["gone"]
    if kind == "submit":
        if there or e["job"] is None:
            return row, 409 if there else 404, "there already" if there else "no such job"
        fresh = dict.fromkeys(_NAMES) | {"job": e["job"], "name": e["name"], "mode": e["mode"] or "kit", "status": "queued", "created": e["at"]}
        return fresh | {"options": _map(e["options"]), "stages": {}, "facts": _map(e["facts"]), "gone": False}, 200, "queued"
    if not there:
        return row, 404, "no such job"
    if kind in ("continue", "delete") and row["status"] in BUSY:
        return row, 409, "still running"
    if kind == "continue":
        again = {"mode": e["mode"] or row["mode"], "status": "queued", "error": None, "started": None, "finished": None}
        return row | again | {"options": row["options"] | _map(e["options"]), "stages": {}}, 200, "queued"
    if kind == "delete":
        return row | {"gone": True}, 200, "deleted"
    if kind == "start":
        return row | {"status": "running", "started": e["at"]}, 200, "running"
    if kind == "finish":
        status = "done" if e["error"] is None else "failed"
        return row | {"status": status, "error": e["error"], "finished": e["at"], "facts": row["facts"] | _map(e["facts"])}, 200, status
    if kind == "mark":
        return row | {"stages": row["stages"] | {e["stage"]: e["status"] or "done"}}, 200, "marked"
    if kind == "update":
        return row | {"facts": row["facts"] | _map(e["facts"])}, 200, "updated"
    return row, 400, f"no request {kind}"


def _stepped(key, old: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    row = None
    if len(old):
        row = {c: _none(v) for c, v in old.iloc[0].items() if c in _NAMES}
        row |= {c: _map(row[c]) for c in ("options", "stages", "facts")}
    answers = []
    for e in events.sort_values(["at", "seq"], kind="stable").to_dict("records"):
        e = {c: _none(v) for c, v in e.items()}
        row, code, said = step(row, e)
        answers.append((e["job"], e["at"], e["seq"], e["kind"], code, said))
    told = pd.DataFrame(answers, columns=["job", "at", "seq", "kind", "code", "said"])
    told["row"] = [None] * (len(told) - 1) + [row]
    return told


class JobTable:
    """The table under ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, every: int = EVERY) -> None:
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """Batches that are written whole."""
        top = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(top):
            return []
        found = [re.fullmatch(r"n=(\d+)", s.getPath().getName()) for s in self._fs.listStatus(top)]
        return sorted(int(m[1]) for m in found if m and self._fs.exists(self._path(f"{self.folder}/{name}/{m[0]}/_SUCCESS")))

    def _rows(self, before: int | None = None) -> DataFrame | None:
        """Written rows of batches below a number, from the last that holds all newest rows, with ``n``."""
        wholes = [n for n in self._numbers("whole") if before is None or n < before]
        base = wholes[-1] if wholes else -1
        paths = [f"{self.folder}/whole/n={base}"] if wholes else []
        paths += [f"{self.folder}/changes/n={n}" for n in self._numbers("changes") if n > base and (before is None or n < before)]
        return self.spark.read.schema(f"n long, {JOBS}").parquet(*paths) if paths else None

    def jobs(self, before: int | None = None, deleted: bool = False) -> DataFrame:
        """The newest row of each job; one aggregation."""
        rows = self._rows(before)
        if rows is None:
            return self.spark.createDataFrame([], JOBS)
        newest = rows.groupBy("job").agg(F.max_by(F.struct(*_NAMES), "n").alias("r")).select("r.*")
        return newest if deleted else newest.where("not gone")

    def answers(self) -> DataFrame:
        paths = [f"{self.folder}/answers/n={n}" for n in self._numbers("answers")]
        return self.spark.read.schema(ANSWERS).parquet(*paths) if paths else self.spark.createDataFrame([], ANSWERS)

    def apply(self, events: DataFrame, number: int) -> None:
        """Take in a batch: the function of ``foreachBatch``."""
        events = events.select(*[c.split()[0] for c in EVENTS.split(", ")])
        rows = self._rows(number)
        own = events.select("job").distinct()
        if rows is None:
            old = self.spark.createDataFrame([], JOBS)
        else:
            old = rows.join(own, "job", "left_semi").groupBy("job").agg(F.max_by(F.struct(*_NAMES), "n").alias("r")).select("r.*")
        row = F.struct(*_NAMES)
        kinds = f"{ANSWERS}, row struct<{JOBS.replace(', ', ',').replace(' ', ':')}>"
        told = old.select(F.col("job").alias("_job"), row.alias("_r")).select("_job", "_r.*").groupBy("_job").cogroup(events.withColumn("_job", F.col("job")).groupBy("_job"))
        told = told.applyInPandas(_stepped, kinds)
        # Answers are written last: a batch counts as answered only when its changes are there.
        told.write.mode("overwrite").parquet(f"{self.folder}/steps/n={number}")
        told = self.spark.read.schema(kinds).parquet(f"{self.folder}/steps/n={number}")
        changed = told.where("row is not null").select(F.lit(number).cast("long").alias("n"), "row.*")
        changed.write.mode("overwrite").parquet(f"{self.folder}/changes/n={number}")
        told.select("job", "at", "seq", "kind", "code", "said").write.mode("overwrite").parquet(f"{self.folder}/answers/n={number}")
        self._fs.delete(self._path(f"{self.folder}/steps/n={number}"), True)
        if number and number % self.every == 0:
            self.put_together(number)

    def put_together(self, number: int) -> None:
        """Write the newest rows of all batches up to a number; deleted jobs end here. Removes what the round before has replaced."""
        earlier = [n for n in self._numbers("whole") if n < number]
        newest = self.jobs(number + 1).select(F.lit(number).cast("long").alias("n"), *_NAMES)
        newest.write.mode("overwrite").parquet(f"{self.folder}/whole/n={number}")
        if earlier:
            for name, most in (("whole", earlier[-1] - 1), ("changes", earlier[-1])):
                for n in self._numbers(name):
                    if n <= most:
                        self._fs.delete(self._path(f"{self.folder}/{name}/n={n}"), True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """``stream.writeStream.foreachBatch(table.sink())``."""
        prepare(self.spark)
        return self.apply
