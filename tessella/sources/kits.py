"""Kit documents and job records: folders, zips and JSON."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.workers import prepare


class KitError(ValueError):
    pass


def _parsed(documents: DataFrame) -> DataFrame:
    """(source, kit struct) of (source, text); documents without pads or slices are refused."""
    kits = documents.select("source", F.from_json("text", schemas.KIT).alias("kit"))
    whole = F.col("kit.pads").isNotNull() & F.col("kit.slices").isNotNull()
    return kits.withColumn("kit", F.when(whole, F.col("kit")))


def read_kit_files(spark: SparkSession, path: str) -> DataFrame:
    """source, kit: the kit.json nearest to the top of each folder below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "kit.json").load(path)
    files = files.where(~F.col("path").contains("__MACOSX"))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    below = F.split(F.substring("path", len(root) + 2, 1 << 20), "/")
    top = F.when(F.size(below) > 1, below[0]).otherwise("")
    nearest = files.groupBy(top.alias("top")).agg(F.min(F.struct(F.length("path"), "path")).getField("path").alias("path"))
    chosen = files.join(nearest.select("path"), "path", "left_semi")
    return _parsed(chosen.select(F.col("path").alias("source"), F.col("content").cast("string").alias("text")))


def _from_zips(batches):
    for batch in batches:
        found = []
        for raw in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = [n for n in z.namelist() if n.split("/")[-1] == "kit.json" and "__MACOSX" not in n]
                name = min(names, key=lambda n: (len(n), n), default=None)
                prefix = name.removesuffix("kit.json") if name else ""
                files = {n.removeprefix(prefix): z.read(n) for n in z.namelist() if name and n.startswith(prefix) and n != name and not n.endswith("/")}
                found.append((z.read(name).decode() if name else None, list(files.items())))
        yield pd.DataFrame({"source": batch["path"], "text": [t for t, _ in found], "files": [[{"file": k, "content": v} for k, v in f] for _, f in found]})


def read_kit_zips(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, kit) and (source, file, content) of zips: the shortest path to a kit.json counts, and what lies beside it."""
    prepare(spark)
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    opened = zips.mapInPandas(_from_zips, "source string, text string, files array<struct<file: string, content: binary>>")
    files = opened.select("source", F.explode("files").alias("f")).select("source", "f.file", "f.content")
    return _parsed(opened.where("text is not null")), files


def pads_of(kits: DataFrame) -> DataFrame:
    return kits.select("source", F.explode("kit.pads").alias("p")).select("source", "p.*")


def slices_of(kits: DataFrame) -> DataFrame:
    return kits.select("source", F.posexplode("kit.slices").alias("kept_ord", "s")).select("source", "kept_ord", "s.*")


def _zipped(group: pd.DataFrame) -> pd.DataFrame:
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED) as z:
        for r in group.sort_values("file").itertuples(index=False):
            z.writestr(zipfile.ZipInfo(r.file), bytes(r.content))
    return pd.DataFrame({"song_id": [group["song_id"].iloc[0]], "file": [f"{group['song_id'].iloc[0]}.zip"], "content": [body.getvalue()]})


def zip_files(files: DataFrame) -> DataFrame:
    """song_id, file, content: one stored zip of each song's files; a kit's files are a few dozen short slices."""
    prepare(files.sparkSession)
    return files.select("song_id", "file", "content").groupBy("song_id").applyInPandas(_zipped, "song_id string, file string, content binary")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Records of status.json files; broken ones are left out, and what was queued or running has failed."""
    from tessella.plans.jobs import recovered

    raw = spark.read.schema(schemas.JOB + ", _broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").option("pathGlobFilter", "status.json").json(path)
    return recovered(raw.where("_broken is null and id is not null").drop("_broken"))
