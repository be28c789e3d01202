"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import workers

#: Rows of an Arrow batch; documents are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000

#: What stands for a null id while numpy works on ids; sorts before all others.
NULL_ID = -(2**63)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep their batches small."""
    workers.prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, one is made in local mode only, as in tests,
    where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; set it")
        found = getattr(spark.sparkContext, "_tessella_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="spark-tessella-", dir="/tmp")
            spark.sparkContext._tessella_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors; the files stay until
    the folder is cleared, as the result is read lazily.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Remove what ``stored`` has written; nothing that is still to be computed may read it."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ids64(column: pa.Array) -> np.ndarray:
    """An integer column as int64, nulls as NULL_ID."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def chunks_by_bytes(offsets: np.ndarray, most: int):
    """Ranges of rows that hold ``most`` bytes at a time, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: A group is handed to all tasks with its facts only if there are no more such groups than this (32 bytes each, about).
BROADCAST_GROUPS = 500_000
#: Partitions of a shuffle at most; more buckets than this share partitions, sorted by bucket.
MOST_PARTITIONS = 10_000
#: Neighbours beyond which a node's rows are joined with their least by a broadcast, if there are few enough such nodes.
HUB = 5000


def _with_least(pairs: DataFrame, label: str) -> DataFrame:
    """Add to each (u, v) the least v of its u.

    The least values are aggregated on the map side. Nodes of over ``HUB``
    neighbours get theirs by a broadcast join, so that no task gathers a hub's
    rows; with more than ``BROADCAST_GROUPS`` of them each is a small share of
    all, and the adaptive skew join deals with what is uneven.
    """
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), f"{label}-least")
    hubs = least.where(F.col("degree") > HUB).select("u", F.col("m").alias("hub_m"))
    if not 0 < hubs.count() <= BROADCAST_GROUPS:
        return pairs.join(least.select("u", "m"), "u")
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    near = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    rest = marked.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return near.unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long or string nodes -> (node, root), root the least node reachable.

    Alternates large-star and small-star steps, each written to the shared
    folder, until nothing changes, which is after a number of rounds that grows
    with the square of the logarithm of the nodes at most. Nodes without edges are not returned; loops
    and repeated edges don't matter. Null nodes are dropped.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "cc-edges",
    )
    seen = None
    for k in itertools.count():
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        large = (
            _with_least(both, f"cc-large{k}")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small = _with_least(stored(large, f"cc-large{k}"), f"cc-small{k}")
        e = stored(
            small.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            f"cc-edges{k}",
        )
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of ``a`` and ``b``, pair by pair, in ``label``: the least place that each place hangs together with."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def groups(batches, keys: list[str]):
    """Tables of the rows of one key each; the batches come sorted by the keys, which are integers."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = np.stack([batch[c].to_numpy() for c in keys])
        bounds = [0, *(np.flatnonzero(np.diff(values, axis=1).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            key = tuple(values[:, a].tolist())
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_buckets(rows: DataFrame, buckets: int, *order, column: str = "bucket") -> DataFrame:
    """Deal out rows by a number of 0 to ``buckets`` - 1, buckets in a row to a partition where they are many, and sort by it and ``order``."""
    parts = min(buckets, MOST_PARTITIONS)
    part = F.expr(f"cast(cast({column} as bigint) * {parts} div {buckets} as int)")
    return rows.repartitionById(parts, part).sortWithinPartitions(column, *order)


def few(table: DataFrame) -> DataFrame:
    """The table, for a broadcast if it has no more than ``BROADCAST_GROUPS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def large_groups(rows: DataFrame, keys: list[str], most: int, label: str) -> tuple[DataFrame, int]:
    """(keys, n) of the groups of more than ``most`` rows, and how many there are."""
    found = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most), label)
    return found, found.count()


def in_tiles(rows: DataFrame, keys: list[str], mark, most: int, label: str, large: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Add ``part``, ``row`` and ``column``, so that a task that compares rows of a key has ``most`` at most, about.

    The rows of a larger group are parted by ``mark``, a hash, and each part
    meets each other (or itself) in the tile of their two numbers.
    """
    large, n = large or large_groups(rows, keys, most, label)
    if not n:
        return rows.withColumns({c: F.lit(0) for c in ("part", "row", "column")})
    large = large.select(*keys, F.ceil(F.col("n") / (most // 2)).cast("int").alias("parts"))
    tiled = rows.join(F.broadcast(large) if n <= BROADCAST_GROUPS else large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tiled = tiled.withColumn("part", F.pmod(mark, F.col("parts")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return tiled.withColumns({"row": F.least("part", "other"), "column": F.greatest("part", "other")}).drop("parts", "other")
