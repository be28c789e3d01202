"""Names, labels and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import as_column

#: Pitch classes, spelt with flats but for F#.
PITCHES = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")


def letters(n) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 703 -> AAA, and so on; numbers below 1 have none."""
    n = as_column(n).cast("long")

    def digit(s, _):
        rest = s["n"] - 1
        letter = F.chr(F.lit(65) + F.pmod(rest, F.lit(26)))
        more = F.struct(F.floor(rest / 26).cast("long").alias("n"), F.concat(letter, s["name"]).alias("name"))
        return F.when(s["n"] > 0, more).otherwise(s)

    start = F.struct(F.coalesce(n, F.lit(0).cast("long")).alias("n"), F.lit("").alias("name"))
    return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda s: s["name"]))


def midi_note(hz) -> Column:
    """The nearest MIDI note, exact halves to the even one."""
    return F.bround(69.0 + 12.0 * F.log2(as_column(hz) / 440.0), 0).cast("int")


def pitch_name(midi) -> Column:
    midi = as_column(midi)
    names = F.array(*[F.lit(p) for p in PITCHES])
    return F.concat(F.element_at(names, F.pmod(midi, F.lit(12)) + 1), (F.floor(midi / 12) - 1).cast("string"))


def note_name(hz) -> Column:
    return pitch_name(midi_note(hz))


def separator_stem(file_stem, known) -> Column:
    """The stem that a separator's output file holds: its name, or what stands in its first brackets."""
    name = as_column(file_stem)
    inside = F.lower(F.regexp_extract(name, r"\(([^)]+)\)", 1))
    return F.when(F.lower(name).isin(*known) | (inside == ""), F.lower(name)).otherwise(inside)


def stripped(text) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(as_column(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sanitised_song(name) -> Column:
    return stripped(F.regexp_replace(as_column(name), r'[\\/:*?"<>|]+', "_"))


def upload_name(name) -> Column:
    """The stem of an upload, 80 characters at most and "song" if nothing is left of it, and its suffix in lower case.

    Letters and digits of all scripts stay. A name that begins or ends with its only full stop has no suffix.
    """
    last = F.element_at(F.split(as_column(name), "/"), -1)
    suffix = F.regexp_extract(last, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.substring(last, F.lit(1), F.length(last) - F.length(suffix))
    stem = stripped(F.regexp_replace(stem, r"[^\p{L}\p{N}_\- .()]+", "_"))
    return F.concat(F.when(stem == "", "song").otherwise(F.substring(stem, 1, 80)), F.lower(suffix))


def export_clean(text) -> Column:
    plain = F.regexp_replace(F.regexp_replace(as_column(text), r"[()]", ""), r"[^A-Za-z0-9]+", "_")
    return F.regexp_replace(plain, r"^_+|_+$", "")


def pad_pairs(text) -> Column:
    """'drums=6, vocals=4' as an array of (part, stem, count) in order; the count is null where a part isn't a name and a number."""

    def pair(p):
        name, value = stripped(F.regexp_extract(p, r"(?s)^([^=]*)", 1)), stripped(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))
        count = F.when((name != "") & value.rlike("^[0-9]+$"), value.try_cast("int"))
        return F.struct(p.alias("part"), name.alias("stem"), count.alias("count"))

    return F.transform(F.split(as_column(text), ","), pair)


def pad_split(text) -> Column:
    """'drums=6,vocals=4' as an array of (stem, count) in order, blank parts left out; null counts where a number is missing."""
    filled = F.filter(pad_pairs(text), lambda p: stripped(p["part"]) != "")
    return F.transform(filled, lambda p: F.struct(p["stem"].alias("stem"), p["count"].alias("count")))


def pad_split_error(text) -> Column:
    """What is wrong with a split written by hand: its first part, blank ones too, that isn't a name and a number; else null."""
    bad = F.get(F.filter(pad_pairs(text), lambda p: p["count"].isNull()), F.lit(0))
    return F.when(bad.isNotNull(), F.concat(F.lit("expected stem=count, got '"), bad["part"], F.lit("'")))


def file_number(index_in_bank, top_first: bool = True) -> Column:
    """1 to 16 for a pad of a 4 x 4 bank whose first is at the bottom left."""
    i = as_column(index_in_bank).cast("int")
    if not top_first:
        return i + 1
    return (3 - F.floor(i / 4).cast("int")) * 4 + F.pmod(i, F.lit(4)) + 1


def bank(pad_index) -> Column:
    return F.chr(F.lit(65) + F.floor(as_column(pad_index) / 16).cast("int"))


def clock(seconds) -> Column:
    """m:ss"""
    s = F.floor(as_column(seconds)).cast("int")
    return F.concat(F.floor(s / 60).cast("int").cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def suffix(bpm, key_short) -> Column:
    return F.concat(F.lit("_"), F.bround(as_column(bpm), 0).cast("int").cast("string"), F.lit("bpm"), F.coalesce(F.concat(F.lit("_"), as_column(key_short)), F.lit("")))


def bars_text(bars) -> Column:
    """A number without a needless fraction."""
    bars = as_column(bars).cast("double")
    return F.when(bars == F.floor(bars), bars.cast("long").cast("string")).otherwise(bars.cast("string"))


def slice_label(stem, kind, category, ordinal, bars, note) -> Column:
    """What a slice is called: 'Kick 1', 'Bass loop A (2 bar)', 'Vox chop 3 Ab4'."""
    stem, kind, category, n, note = map(as_column, (stem, kind, category, ordinal, note))
    title, number = F.initcap(stem), n.cast("string")
    noun = F.when(stem == "drums", "Drum").when(stem == "vocals", "Vox").otherwise(title)
    tail = F.coalesce(F.concat(F.lit(" "), note), F.lit(""))
    return (
        F.when(category.isin("kick", "snare", "hat", "perc"), F.concat(F.initcap(category), F.lit(" "), number))
        .when(kind == "loop", F.concat(noun, F.lit(" loop "), letters(n), F.lit(" ("), F.coalesce(bars_text(bars), F.lit("?")), F.lit(" bar)")))
        .when(category == "bass_note", F.concat(F.lit("Bass note "), number, tail))
        .when(category == "vox_chop", F.concat(F.lit("Vox chop "), number, tail))
        .when(category == "vox_phrase", F.concat(F.lit("Vox phrase "), number))
        .otherwise(F.concat(title, F.when(category == "stab", F.lit(" stab ")).otherwise(F.lit(" hit ")), number, tail))
    )


def slice_file(stem, kind, category, ordinal, bars, note, tag) -> Column:
    """The file name of a slice without folder and extension; ``tag`` is ``suffix``."""
    stem, kind, category, n, note = map(as_column, (stem, kind, category, ordinal, note))
    title, number = F.initcap(stem), n.cast("string")
    word = (
        F.when(category.isin("kick", "snare", "hat", "perc"), F.initcap(category))
        .when(kind == "loop", "Loop")
        .when(category == "bass_note", "Note")
        .when(category == "vox_chop", "Chop")
        .when(category == "vox_phrase", "Phrase")
        .when(category == "stab", "Stab")
        .otherwise("Hit")
    )
    which = F.when(kind == "loop", letters(n)).otherwise(number)
    noted = ~category.isin("kick", "snare", "hat", "perc", "vox_phrase") & (kind != "loop")
    last = F.when(kind == "loop", F.concat(bars_text(bars), F.lit("bar"))).when(noted, note)
    return F.concat(F.concat_ws("_", title, word, which, last), as_column(tag))
