"""Token-id files in word-aligned coding.

``write_token_files`` puts the ids of every text, each followed by an end id,
into segments in ascending order of the id column. A segment is one binary
value of a Parquet table in the folder given, so that any store Spark writes to
will do. It holds whole documents: ids and lengths of the documents, then the
coded words with the first word of every block, then the escaped values.

Rows of one id are parted among tasks by a hash of their text, so a null id, or
one that very many rows share, is no task's alone; rows equal in both pass
through a task one segment at a time.

Defined results: a null or empty text has the end id alone; rows that share an
id are ordered by a hash of their text and keep a line each; a null id sorts
first and comes back as null; ids that aren't integers are refused; an empty table gives empty files; other columns are left
aside. A text of any length stays in one segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simple8b, tokens

MAGIC = b"TS8B"
#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 1_000_000
#: With more segments than this, their starts are joined by a shuffle, not a broadcast.
BROADCAST_SEGMENTS = 100_000
_HEAD = struct.Struct("<4sIQQQQQ")
SEGMENTS = "part int, segment int, n_docs long, n_ids long, payload binary"


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The first ``nulls`` documents have null ids."""
    words, heads, escapes = simple8b.pack(ids)
    parts = (
        _HEAD.pack(MAGIC, simple8b.BLOCK, len(doc_ids), len(ids), len(words), len(escapes), nulls),
        doc_ids.astype("<i8"), lengths.astype("<u8"), heads.astype("<u4"), escapes.astype("<u8"), words.astype("<u8"),
    )
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, their lengths, all ids in a row, and how many of the first documents have null ids."""
    magic, block, docs, n, words, escapes, nulls = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, got = _HEAD.size, []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u4", -(-n // block) + 1), ("<u8", escapes), ("<u8", words)):
        got.append(np.frombuffer(payload, kind, count, at))
        at += got[-1].nbytes
    doc_ids, lengths, heads, escaped, coded = got
    return doc_ids, lengths.astype(np.int64), simple8b.unpack(coded, heads, escaped, n, block), nulls


def _segments(vocabulary: str, end_id: int, segment_ids: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        encode = tokens.encoder(vocabulary).encode
        for batch in tokens.gathered(batches):
            keys = common.ids64(batch["key"])
            ids, at = encode(batch["text"])
            ends = at[1:] + np.arange(1, len(at))  # with an end id each
            own = np.full(len(ids) + len(keys), end_id, np.uint32)
            inside = np.ones(len(own), bool)
            inside[ends - 1] = False
            own[inside] = ids
            begins = np.concatenate(([0], ends[:-1]))
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(ends, begins[i] + segment_ids, side="right")))
                some = own[begins[i] : ends[j - 1]]
                payload = encode_segment(keys[i:j], ends[i:j] - begins[i:j], some, batch["key"].slice(i, j - i).null_count)
                row = (pa.array([part], pa.int32()), pa.array([number], pa.int32()), [j - i], [len(some)], pa.array([payload], pa.binary()))
                yield pa.RecordBatch.from_pydict(dict(zip(("part", "segment", "n_docs", "n_ids", "payload"), row, strict=True)))
                i, number = j, number + 1

    return run


def write_token_files(
    documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every text to segments in ascending order of ``id_col``."""
    common.prepare(documents.sparkSession)
    if not isinstance(documents.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} doesn't hold integers")
    rows = documents.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    order = ("key", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    make = _segments(vocabulary or tokens.default_vocabulary(), end_id, segment_ids)
    rows.mapInArrow(make, SEGMENTS).write.parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, segment, start): the ids before each segment, from counts alone."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return (
        segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("inside")).alias("start"))
    )


def _documents(batches):
    for batch in batches:
        for start, payload in zip(batch["start"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            doc_ids, lengths, ids, nulls = decode_segment(payload)
            ids = ids.astype("<u4")
            ends = np.cumsum(lengths)
            begins = ends - lengths
            for i in range(0, len(doc_ids), 5000):
                some = slice(i, i + 5000)
                values = [ids[a:b] for a, b in zip(begins[some], ends[some], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids[some], pa.int64(), mask=np.arange(len(doc_ids))[some] < nulls),
                        "start": pa.array(begins[some] + start, pa.int64()),
                        "n_tokens": pa.array(lengths[some], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in values], pa.int64()),
                        "ids": pa.array([x.tobytes() for x in values], pa.binary()),
                    }
                )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit) of every document."""
    common.prepare(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    starts = segment_starts(segments.select("part", "segment", "n_ids"))
    if segments.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    rows = segments.select("part", "segment", "payload").join(starts, ["part", "segment"]).select("start", "payload")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    write_token_files(common.source(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
