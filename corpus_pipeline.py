"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, decontamination, language_id, line_dedup, near_duplicates, packing

#: A document is rejected if its language has less than this share of its letters.
MIN_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a known language; without any labels to learn from, none."""
    model = language_id.fit_documents(docs)
    if not model.langs:
        return docs
    inside = docs.toDF(*_plain(docs))  # the operator's columns can't clash with these
    text = inside.columns[docs.columns.index("text")]
    found = language_id.predict(inside, model, keep=tuple(inside.columns), text_col=text, spans=False)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.select(*inside.columns).toDF(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop runs of lines that occur before, and documents of which nothing is left."""
    names = dict(zip(docs.columns, _plain(docs), strict=True))
    found = line_dedup.remove_repeated_lines(docs.toDF(*names.values()), id_col=names["doc_id"], text_col=names["text"])
    found = found.where("_removed = 0 or _removed < _lines")
    if "n_chars" in names:
        found = found.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return found.select(*names.values()).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates.

    SimHash fingerprints of five-word shingles find them by their BK-trees, in shards
    and at radii that no pair escapes; Jaccard similarities of 0.8 or more link them.
    """
    last = F.lit(2**63 - 1)
    found = near_duplicates.near_components(docs, words_each=5, similarity=0.8)
    least = found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("key"), "th")).alias("kept"))
    kept = _marked(docs, last).join(least.select("kept.key", "kept.th"), ["key", "th"], "left_semi")
    # Rows equal in id and text are one document.
    if not kept.groupBy("key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "th"])
    return kept.select("row.*")


def _plain(docs: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(docs.columns))]


def _marked(docs: DataFrame, null_id: Column) -> DataFrame:
    """``row``, the columns of ``docs`` whatever their names, with ``key`` and ``th``, what a document is known by."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), null_id).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("th"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontamination.find_benchmark(docs, common.source(spark, sf_dir, "benchmark"))
    null_id = F.lit(common.NULL_ID)
    found = found.select(F.coalesce("doc_id", null_id).alias("key"), "th").distinct()
    return _marked(docs, null_id).join(found, ["key", "th"], "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and the sequences that they are packed in."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: The stages can't be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
