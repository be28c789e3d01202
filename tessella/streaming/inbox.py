"""Songs that arrive in a folder, as a stream: one row for each different content.

Files are named by Spark's file stream and read in tasks, headers and digest
only. Within ``within`` of an arrival the stream's state knows a content that
comes again; the table of songs knows all others, as a batch leaves out what it
has. A batch writes its songs under its own number, so one that is replayed
after a restart writes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources import wav

_FILES = "path string, modificationTime timestamp, length long, content binary"
SONGS = f"{wav.LISTED}, arrived timestamp"


def arriving(spark: SparkSession, inbox: str, *, rights_confirmed: bool, within: str = "1 day", **options) -> DataFrame:
    """A stream of ``wav.list_songs`` rows with ``arrived``, the first of each content; files that can't be taken all have theirs.

    Time is that of the arrival, not that of the file, so no old file is late.
    """
    found = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(inbox)
    rows = wav.facts(found.select("path", "length"), rights_confirmed=rights_confirmed, **options)
    key = F.coalesce(F.when(F.col("error").isNull(), F.col("sha256")), F.col("path"))
    rows = rows.withColumns({"arrived": F.current_timestamp(), "_key": key}).withWatermark("arrived", within)
    return rows.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def songs(spark: SparkSession, table: str) -> DataFrame:
    """What has been taken in so far."""
    if not _exists(spark, table):
        return spark.createDataFrame([], SONGS)
    return spark.read.schema(f"{SONGS}, batch long").parquet(table).drop("batch")


def take_in(spark: SparkSession, inbox: str, table: str, checkpoint: str, *, rights_confirmed: bool, **options) -> StreamingQuery:
    """Take in all that is there and go on from where the last run stopped; ends when nothing is left."""
    names = [x.split()[0] for x in SONGS.split(", ")]
    content = F.when(F.col("error").isNull(), F.col("sha256"))

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*names).withColumn("_content", content)
        if _exists(spark, table):
            # Of other batches: one that is replayed finds its own songs there.
            known = spark.read.schema(f"{SONGS}, batch long").parquet(table).where(F.col("batch") != number)
            fresh = fresh.join(known.select(content.alias("_content")).where("_content is not null").distinct(), "_content", "left_anti")
        first = Window.partitionBy(F.coalesce("_content", "path")).orderBy("path")
        fresh = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*names)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = arriving(spark, inbox, rights_confirmed=rights_confirmed, **options)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
