"""Removal of repeated runs of lines.

Every three consecutive lines of a text are a window, hashed to 128 bits. A
window that occurs before, in a smaller document id or further up in the same
text, is covered, and all covered lines are removed, overlaps merged. Windows
are judged on the input, not on what is left.

Each task keeps only the first of the equal windows that it meets; the others
are later ones for certain. So a boilerplate window costs a row per task in
the shuffle, however common it is.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; texts of fewer than three lines lose nothing; rows equal in id and
text are one document, each with its result; documents that share an id are
ordered by a hash of the text; null ids sort first; other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import common

WINDOW = 3
#: Windows that a task holds before it passes on the first of each kind.
HELD = 500_000
_ROWS = "h1 long, h2 long, key long, th long, line int, later boolean"


def _windows(each: int):
    def first_of_each(parts):
        h1, h2, key, th, line = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((line, th, key, h2, h1))
        h1, h2, key, th, line = (x[order] for x in (h1, h2, key, th, line))
        same = np.zeros(len(h1), bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        # Of equal windows at the same place, those of repeated rows, all are first.
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        later = same & ~((key == key[head]) & (th == th[head]) & (line == line[head]))
        names = ["h1", "h2", "key", "th", "line", "later"]
        for i in range(0, len(h1), 50_000):
            some = slice(i, i + 50_000)
            arrays = [pa.array(x[some]) for x in (h1, h2, key, th)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(line[some], pa.int32()), pa.array(later[some])], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, at = common.utf8(batch["text"])
            data = data.tobytes()
            found, counts = bytearray(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ends = list(_line_ends(data, a, b))
                n = max(0, len(ends) - each + 1)
                starts = [a, *[e + 1 for e in ends[: n - 1]]] if n else []
                for s, e in zip(starts, ends[each - 1 :], strict=True):
                    found += xxhash.xxh3_128_digest(data[s:e])
                counts.append(n)
            hashes = np.frombuffer(bytes(found), np.int64).reshape(-1, 2)
            key = np.repeat(common.ids64(batch["key"]), counts)
            th = np.repeat(common.ids64(batch["th"]), counts)
            line = np.concatenate([np.arange(n) for n in counts] or [np.zeros(0, np.int64)])
            parts.append((hashes[:, 0], hashes[:, 1], key, th, line))
            held += len(key)
            if held >= HELD:
                yield from first_of_each(parts)
                parts, held = [], 0
        if held:
            yield from first_of_each(parts)

    return run


def _line_ends(data: bytes, a: int, b: int):
    i = data.find(b"\n", a, b)
    while i >= 0:
        yield i
        i = data.find(b"\n", i + 1, b)
    yield b


def _kept(each: int):
    def run(batches):
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, starts in zip(batch["_text"].to_pylist(), batch["_starts"].to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    lines.append(0)
                    removed.append(0)
                    continue
                parts = text.split("\n")
                lines.append(len(parts))
                if starts:
                    keep = np.ones(len(parts), bool)
                    for s in starts:
                        keep[s : s + each] = False
                    parts = [parts[i] for i in np.flatnonzero(keep)]
                    text = "\n".join(parts)
                texts.append(text)
                removed.append(lines[-1] - len(parts))
            got = {"_text": pa.array(texts, pa.string()), "_lines": pa.array(lines, pa.int64()), "_removed": pa.array(removed, pa.int64())}
            rest = [c for c in batch.schema.names if c not in ("_text", "_starts")]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], *got.values()], names=[*rest, *got])

    return run


def remove_repeated_lines(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``documents`` with covered lines gone from the text, and ``_lines`` and ``_removed`` added."""
    common.prepare(documents.sparkSession)
    place = [F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("key"), F.xxhash64(text_col).alias("th")]
    light = documents.select(*place, F.col(text_col).alias("text"))
    windows = common.stored(light.mapInArrow(_windows(window), _ROWS), "line-windows")
    order = Window.partitionBy("h1", "h2").orderBy("key", "th", "line")
    firsts = windows.where("not later").withColumn("n", F.rank().over(order)).where("n > 1")
    covered = firsts.select("key", "th", "line").unionByName(windows.where("later").select("key", "th", "line"))
    covered = covered.groupBy("key", "th").agg(F.sort_array(F.collect_set("line")).alias("_starts"))

    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(documents.columns)]
    at = documents.columns.index(text_col)
    whole = documents.select(*named, *place).join(covered, ["key", "th"], "left").drop("key", "th")
    whole = whole.withColumn("_text", F.col(f"c{at}")).drop(f"c{at}")
    kept = [f for f in whole.schema if f.name not in ("_text", "_starts")]
    schema = T.StructType([*kept, T.StructField("_text", T.StringType()), T.StructField("_lines", T.LongType()), T.StructField("_removed", T.LongType())])
    out = whole.mapInArrow(_kept(window), schema)
    columns = [F.col("_text" if i == at else f"c{i}").alias(c) for i, c in enumerate(documents.columns)]
    return out.select(*columns, "_lines", "_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.source(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(documents).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS n FROM windows WHERE body IS NOT NULL
  ) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k)
), told AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id
"""
