"""Numbered files of a kit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dsp, labels
from tessella.sources import wav
from tessella.workers import prepare


def export_plan(pads: DataFrame, slices: DataFrame, *, top_first: bool = True, extras: bool = False) -> DataFrame:
    """song_id, path, bank, number, pad, slice_id of every file.

    Every pad has a file, an empty one ``NN_Empty``, so numbers stay aligned.
    With ``extras`` slices on no pad follow; equal names get underscores in
    their order.
    """
    named = slices.select("song_id", F.col("id").alias("slice_id"), labels.export_clean("label").alias("_name"), "kept_ord")
    p = pads.join(named.drop("kept_ord"), ["song_id", "slice_id"], "left")
    i = F.col("pad") - 1
    number = labels.file_number(F.pmod(i, F.lit(16)), top_first)
    bank = labels.bank(i)
    file = F.concat(F.lit("Bank_"), bank, F.lit("/"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), F.coalesce("_name", F.lit("Empty")), F.lit(".wav"))
    plan = p.select("song_id", file.alias("path"), bank.alias("bank"), number.alias("number"), "pad", "slice_id")
    if not extras:
        return plan
    left = named.join(pads.where("slice_id is not null"), ["song_id", "slice_id"], "left_anti")
    again = F.row_number().over(Window.partitionBy("song_id", "_name").orderBy("kept_ord")) - 1
    left = left.withColumn("path", F.concat(F.lit("Extras/"), F.col("_name"), F.repeat(F.lit("_"), again), F.lit(".wav")))
    return plan.unionByName(left.select("song_id", "path", "slice_id"), allowMissingColumns=True)


def _exported(rate: int, bits: int):
    def run(batches):
        for batch in batches:
            files = []
            for raw in batch["content"]:
                if raw.is_valid:
                    own, x = wav.decode(raw.as_py())
                    files.append(wav.encode(dsp.resampled(x, own, rate), rate, bits))
                else:
                    files.append(wav.encode(wav.silence(rate), rate, bits))
            yield pa.RecordBatch.from_arrays([batch["song_id"], batch["file"], pa.array(files, pa.binary())], names=["song_id", "file", "content"])

    return run


def export_files(plan: DataFrame, rendered: DataFrame, readmes: DataFrame, *, rate: int = 48000, bits: int = 24) -> DataFrame:
    """song_id, file, content of every planned file at one rate, silence for empty pads, and README.txt.

    ``rendered`` is (song_id, id, content), ``readmes`` is (song_id, text).
    """
    prepare(plan.sparkSession)
    sound = rendered.select("song_id", F.col("id").alias("slice_id"), "content")
    files = plan.select("song_id", F.col("path").alias("file"), "slice_id").join(sound, ["song_id", "slice_id"], "left")
    made = files.select("song_id", "file", "content").mapInArrow(_exported(rate, bits), "song_id string, file string, content binary")
    text = readmes.select(F.col("song_id").cast("string").alias("song_id"), F.lit("README.txt").alias("file"), F.encode("text", "UTF-8").alias("content"))
    return made.unionByName(text)


def folder_name(kit_name, bpm, key_short):
    """A kit's folder: its cleaned name, tempo and key."""
    name = F.regexp_replace(labels.export_clean(kit_name), "_", " ")
    bits = F.concat_ws(" ", F.concat(F.bround(bpm, 0).cast("int").cast("string"), F.lit("bpm")), key_short)
    return F.when(bits != "", F.concat(name, F.lit(" - "), bits)).otherwise(name)


#: How the pads of a bank are numbered, by whether the top row comes first.
ORDERS = {True: ("top row first", "top-left"), False: ("bottom row first", "bottom-left")}
LOADING = (
    "How to load it", "--------------", "1. Unpack the archive on the device.",
    "2. In the sampler's browser open the folder Bank_A; add the folder as a place if it isn't listed.",
    "3. Select all of its files and drag them to the first free pad: they fill the pads in the order of their numbers.",
    "   Kits of 32 or 64 pads go on with Bank_B, Bank_C and Bank_D on the next banks.", "",
    "Elsewhere: the numbers are the order of the pads, and loops are whole bars at the tempo above.", "",
    "Samples of other people's recordings may need their consent before music with them is released.",
)


def pad_maps(plan: DataFrame, slices: DataFrame, width: int = 24) -> DataFrame:
    """song_id, bank, map: the 4 x 4 pads of each bank as lines of text, the top row first, cells of number and label ``width`` wide."""
    i = F.pmod(F.col("pad") - 1, F.lit(16))
    named = slices.select("song_id", F.col("id").alias("slice_id"), "label")
    p = plan.where("pad is not null").join(named, ["song_id", "slice_id"], "left")
    text = F.concat(F.lpad(F.col("number").cast("string"), 2, "0"), F.lit(" "), F.when(F.col("slice_id").isNull(), "(empty)").otherwise(F.coalesce("label", F.lit(""))))
    cells = p.select("song_id", "bank", (3 - F.floor(i / 4)).cast("int").alias("row"), F.pmod(i, F.lit(4)).cast("int").alias("column"), F.rpad(F.substring(text, 1, width), width, " ").alias("cell"))
    # A bank has 16 cells at most; a row that has some has four, blank ones where no pad is.
    banks = cells.groupBy("song_id", "bank").agg(F.map_from_entries(F.collect_list(F.struct(F.col("row") * 4 + F.col("column"), "cell"))).alias("own"))
    blank = F.lit(" " * width)
    line = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.concat(F.lit("  "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.coalesce(F.col("own")[r * 4 + c], blank)), " | ")))
    return banks.select("song_id", "bank", F.array_join(line, "\n").alias("map"))


def readmes(plan: DataFrame, slices: DataFrame, facts: DataFrame, *, top_first: bool = True, rate: int = 48000, bits: int = 24) -> DataFrame:
    """song_id, text: what a kit is, its banks as laid out on the pads, and how to load it; ``facts`` is (song_id, kit_name, bpm, key)."""
    number = int(rate / 1000) if rate % 1000 == 0 else rate / 1000
    order, corner = ORDERS[top_first]
    banks = pad_maps(plan, slices).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("bank", "map"))).alias("banks"))
    told = F.transform("banks", lambda b: F.concat(F.lit("Bank "), b["bank"], F.lit(" (as laid out on the pads):\n\n"), b["map"], F.lit("\n")))
    tempo = F.when(F.coalesce(F.col("bpm"), F.lit(0.0)) != 0, F.format_string("%.1f BPM", F.col("bpm").cast("double"))).otherwise("unknown")
    head = [
        F.col("kit_name"), F.repeat(F.lit("="), F.length("kit_name")), F.lit(""),
        F.concat(F.lit("Tempo: "), tempo, F.lit("    Key: "), F.coalesce("key", F.lit("unknown"))),
        F.lit(f"Audio: {'32-bit float' if bits == 32 else f'{bits}-bit'} WAV, {number} kHz, stereo"),
        F.lit(f"Pad order: {order} (file 01 is the {corner} pad)"), F.lit(""),
    ]
    text = F.concat(F.array_join(F.concat(F.array(*head), F.coalesce(told, F.array().cast("array<string>")), F.array(*map(F.lit, LOADING))), "\n"), F.lit("\n"))
    return facts.join(banks, "song_id", "left").select("song_id", text.alias("text"))


def summary_lines(pads: DataFrame, slices: DataFrame) -> DataFrame:
    """song_id, pad, line: what is on each pad, how long and how good."""
    s = slices.select("song_id", F.col("id").alias("slice_id"), "label", (F.col("source_end_s") - F.col("source_start_s")).alias("s"), "score")
    told = F.format_string("%2d  %-28s %5.2f s  %.2f", "pad", "label", "s", "score")
    return pads.join(s, ["song_id", "slice_id"], "left").select("song_id", "pad", F.when(F.col("label").isNull(), F.format_string("%2d  (empty)", "pad")).otherwise(told).alias("line"))
