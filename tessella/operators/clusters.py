"""Leader clustering within groups, and cluster numbers across them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.workers import prepare


def _leaders(vector: str, score: str, ties: str, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, ties], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, np.float64) for v in group[vector]])
        norms = np.linalg.norm(vectors, axis=1)
        kept: list[int] = []  # the leaders so far
        leader, similarity = np.zeros(len(group), np.int64), np.full(len(group), np.nan)
        for i in range(len(group)):
            if kept:
                far = np.linalg.norm(vectors[kept] - vectors[i], axis=1) / (0.5 * (norms[kept] + norms[i]) + 1e-10)
                near = np.maximum(0.0, 1.0 - far)
                best = int(near.argmax())
                if near[best] >= threshold:
                    leader[i], similarity[i] = best, near[best]
                    continue
            leader[i] = len(kept)
            kept.append(i)
        group["leader"] = leader
        group["representative"] = np.isnan(similarity)
        group["similarity"] = pd.array(np.where(np.isnan(similarity), None, similarity))
        return group.drop(columns=[vector])

    return run


def leaders(df: DataFrame, *, group: list[str], vector: str, score: str, ties: str, threshold: float) -> DataFrame:
    """Visit each group by falling score; a row joins the most similar leader from ``threshold`` on, or leads.

    Adds leader (its number in the group), representative and similarity (null
    for leaders); the vector goes. The pass depends on its order, so a group
    runs in one task; groups are the few hundred candidates of one category of
    one song, and there are as many tasks as songs and categories.
    """
    prepare(df.sparkSession)
    kept = [f for f in df.schema if f.name != vector]
    schema = T.StructType([*kept, T.StructField("leader", T.LongType()), T.StructField("representative", T.BooleanType()), T.StructField("similarity", T.DoubleType())])
    return df.groupBy(*group).applyInPandas(_leaders(vector, score, ties, threshold), schema)


def numbered(df: DataFrame, *, group: list[str], ties: str, by: list[str] | None = None, name: str = "cluster") -> DataFrame:
    """Number clusters through all groups of ``by`` in the order of each group's least ``ties``."""
    sizes = df.groupBy(*(by or []), *group).agg(F.min(ties).alias("_first"), (F.max("leader") + 1).alias("_n"))
    before = Window.partitionBy(*(by or [])).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(by or []), *group, "_base")
    return df.join(offsets, [*(by or []), *group]).withColumn(name, F.col("_base") + F.col("leader")).drop("_base")
