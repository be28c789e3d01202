"""Best-fit packing of token pieces, planned over a histogram of lengths.

Texts become ids with an end id; those longer than a sequence are cut into
whole sequences behind a shorter first piece. The plan works on counts: for
each length, longest first, all pieces of that length go to the fullest
sequences that have room, many at a time. It has a row for each run of pieces of
one length in like sequences, and is broadcast only if these are few, which is
checked. Pieces then take the slots planned for their length in order of
their rank, which comes from counts by task and length, not from a sort.

Defined results: a null or empty text is one piece, the end id; repeated rows
and ids are packed like any other rows; an empty table gives no rows; null ids
stay null; other columns are left aside.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 1024
END_ID = 2
PIECES = "task int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of a plan (40 bytes each) that are sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_PLAN = 500_000
PLAN = "length long, low long, high long, first_sequence long, offset long"


def plan_best_fit(histogram: dict[int, int], capacity: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, low, high, first_sequence, offset), and the number of sequences.

    Piece number r of a length, low <= r < high, goes to sequence
    first_sequence + r - low, at the offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, count)
    free: list[int] = []  # the keys of room, in order
    plan: list[tuple[int, int, int, int, int]] = []
    total = 0

    def give(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append((first, count))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens can't be packed")
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                has = free[i]
                first, count = room[has].pop()
                used = min(count, left)
                if used < count:
                    room[has].append((first + used, count - used))
                if not room[has]:
                    del room[has]
                    free.pop(i)
                plan.append((length, rank, rank + used, first, capacity - has))
                give(has - length, first, used)
                rank, left = rank + used, left - used
            else:
                fit = capacity // length
                for each, count in ((fit, left // fit), (left % fit, 1)):
                    if each and count:
                        for k in range(each):
                            plan.append((length, rank, rank + count, total, k * length))
                            rank += count
                        give(capacity - each * length, total, count)
                        total += count
                left = 0
    return plan, total


def _pieces(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        encode = tokens.encoder(vocabulary).encode
        for batch in tokens.gathered(batches):
            rows: list[tuple] = []
            ids, at_ids = encode(batch["text"])
            ids, at_ids = ids.astype("<u4"), at_ids.tolist()
            for k, doc in enumerate(batch["doc_id"].to_pylist()):
                own = np.append(ids[at_ids[k] : at_ids[k + 1]], np.uint32(end_id))
                n = len(own)
                at, piece, size = 0, 0, n % capacity or capacity
                while at < n:
                    part = own[at : at + size]
                    rows.append((task, seen[size], doc, piece, at, size, zlib.crc32(part), part.tobytes() if with_ids else None))
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            names = ("task", "rank", "doc_id", "piece", "start", "length", "ids_crc32", "ids")
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            use = range(8 if with_ids else 7)
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in use], names=[names[i] for i in use])

    return run


def pack_documents(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    end_id: int = END_ID, capacity: int = SEQUENCE, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    spark = documents.sparkSession
    common.prepare(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    make = _pieces(vocabulary or tokens.default_vocabulary(), end_id, capacity, with_ids)
    pieces = common.stored(rows.mapInArrow(make, PIECES + ", ids binary" * with_ids), "pieces")

    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_best_fit(histogram, capacity)
    slots = spark.createDataFrame(plan, PLAN)
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("rank"))
    placed = ranked.join(F.broadcast(slots) if len(plan) <= BROADCAST_PLAN else slots, "length").where("rank >= low and rank < high")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *["ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the tokens of every sequence in a row; ``packed`` has ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.source(spark, sf_dir, "documents"))
