"""Shards of equal row counts by a two-pass external shuffle.

The first pass scatters records uniformly into buckets that fit a task's
memory, by a seeded hash of the key columns and the text. The second reads a bucket, puts it
in a fixed order, shuffles it by Fisher-Yates with a generator seeded by the
bucket, and writes it. The buckets in a row are one permutation of all records,
and shards are equal cuts of it, so their counts differ by one at most. There
are as many buckets as the records need; beyond ``common.MOST_PARTITIONS`` several
share a partition, one after the other, and only partitions' counts are known
to all tasks.

Rows equal in key and text share a bucket. Where they alone fill one, they are
scattered at random instead, and that choice is written to the shared folder, so
that a lost executor can't change it; such rows are alike, so it makes no
difference which of them goes where.

Defined results: null texts count no bytes; a null key is one like any other; an
empty table gives no rows; input columns named ``shard`` or ``slot`` come back as
``shard_in`` and ``slot_in``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from . import common

SHARDS = 40
BUCKET_BYTES = 24 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1; the swaps are drawn in one call."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, -1, -1), draws, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(bases: np.ndarray, buckets: int, shards: int, total: int, seed: int):
    """``bases``: the records before each partition."""
    # Cuts of 0..total whose sizes differ by one at most.
    cuts = np.arange(shards + 1) * total // shards

    def run(batches):
        part = start = None
        for pieces in common.groups(batches, ["_bucket"]):
            number = pieces["_bucket"][0].as_py()
            if (own := number * len(bases) // buckets) != part:
                part, start = own, int(bases[own])
            table = pieces.drop_columns(["_bucket"])
            order = fisher_yates(len(table), seed * 1_000_003 + number)
            for i in range(0, len(order), common.BATCH_ROWS):
                some = table.take(pa.array(order[i : i + common.BATCH_ROWS]))
                place = start + i + np.arange(len(some))
                shard = np.searchsorted(cuts, place, side="right") - 1
                some = some.append_column("shard", pa.array(shard, pa.int32()))
                yield from some.append_column("slot", pa.array(place - cuts[shard], pa.int64())).to_batches()
            start += len(order)

    return run


def write_shards(
    documents: DataFrame, path: str, *, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Write ``documents`` to ``path``/shard=N, each row with its slot in the shard."""
    common.prepare(documents.sparkSession)
    taken = {"shard", "slot", "_bucket", "_mark", "_hot"}
    rows = documents.toDF(*[f"{c}_in" if c in taken else c for c in documents.columns])
    text_col, key = (f"{text_col}_in" if text_col in taken else text_col), [f"{c}_in" if c in taken else c for c in key]
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 16
    total_size = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total_size // bucket_bytes))
    mark = F.xxhash64(F.lit(seed), *key, F.xxhash64(text_col))
    bucket = F.pmod(mark, F.lit(buckets)).cast("long")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))

    rows = rows.withColumn("_bucket", bucket)
    counts = counted(rows)
    heavy = common.stored(counts.where(F.col("bytes") > 2 * max(bucket_bytes, total_size // buckets)).select("_bucket"), "heavy-buckets")
    if not heavy.isEmpty():
        marked = rows.withColumn("_mark", mark).join(common.few(heavy), "_bucket", "left_semi")
        hot = marked.groupBy("_mark").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > bucket_bytes // 2) & (F.col("n") > 1))
        # At most two for each bucket.
        hot = common.stored(hot.select("_mark", F.lit(True).alias("_hot")), "hot-keys")
        rows = rows.withColumn("_mark", mark).join(common.few(hot), "_mark", "left")
        scattered = F.when(F.col("_hot"), F.floor(F.rand(seed) * buckets).cast("long")).otherwise(F.col("_bucket"))
        rows = common.stored(rows.withColumn("_bucket", scattered).drop("_mark", "_hot"), "scattered")
        counts = counted(rows)
    parts = min(buckets, common.MOST_PARTITIONS)
    told = counts.groupBy(F.expr(f"_bucket * {parts} div {buckets}").alias("part")).agg(F.sum("n").alias("n")).collect()
    filled = np.zeros(parts, np.int64)
    for r in told:
        filled[r["part"]] = r["n"]
    bases, total = np.cumsum(filled) - filled, int(filled.sum())
    schema = T.StructType([f for f in rows.schema if f.name != "_bucket"])
    schema = schema.add("shard", T.IntegerType()).add("slot", T.LongType())
    dealt = common.by_buckets(rows, buckets, *key, F.xxhash64(text_col), column="_bucket")
    dealt.mapInArrow(_shuffled(bases, buckets, shards, total, seed), schema).write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.source(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.new_path(spark, "shards")
    write_shards(documents, path)
    back = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    return back.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
