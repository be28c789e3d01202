"""From blocks of many songs to kits, stage by stage; each stage can be written and read back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import frames as fr
from tessella.plans import analysis, candidates, kit, render, scores
from tessella.workers import prepare


@dataclass
class Kits:
    analysis: analysis.Analysis
    candidates: DataFrame
    slices: DataFrame
    pads: DataFrame

    def documents(self) -> DataFrame:
        return kit.kit_documents(self.slices, self.pads, self.analysis)


def keeper(spark: SparkSession, folder: str, told: str = "") -> Callable[[DataFrame, str], DataFrame]:
    """Stage outputs as Parquet under ``folder``; one that was written whole is read instead of made.

    ``told`` says what the stages depend on; other settings or inputs have
    folders of their own. Only a folder that Spark has marked as a success
    counts; what a run that was broken off has left is written again.
    """
    mark = hashlib.sha256(told.encode()).hexdigest()[:16]

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{mark}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def make_kits(mix: DataFrame, stems: DataFrame, cfg: dict, folder: str, source: str = "") -> Kits:
    """Kits of all songs whose mixes and stems are given as sample blocks; stages are kept under ``folder``.

    A run with the same settings, input files and ``source`` (a digest of the
    songs, say) goes on where the last one stopped; any other begins anew.
    """
    prepare(mix.sparkSession)
    told = json.dumps([cfg, source, sorted(mix.inputFiles()), sorted(stems.inputFiles())], sort_keys=True)
    a, keep = cfg["analysis"], keeper(mix.sparkSession, folder, told)
    found = analysis.analyse(keep(fr.features(mix, constant=True), "mix_frames"), analysis.song_facts(mix), keep, a["min_bpm"], a["max_bpm"])
    frames = keep(fr.features(stems), "stem_frames")
    raw = keep(candidates.find_candidates(frames, stems, found, cfg), "candidates")
    rated = keep(scores.score(raw, stems, cfg), "scores")
    chosen = keep(kit.choices(rated, cfg), "choices")
    pads, kept = kit.chosen_pads(chosen, cfg), kit.chosen_slices(chosen)
    notes = keep(render.find_notes(rated, kept, stems), "notes")
    slices, pads = kit.build(rated, pads, kept, found, cfg, notes)
    return Kits(found, rated, keep(slices, "slices"), keep(pads, "pads"))
