"""Benchmark passages in documents, also where their parameters were changed.

Texts become templates: numbers, names and units are typed placeholders, and
equal placeholders in a row are one. Windows of ``window`` template tokens are
hashed, and those of the documents that a benchmark has too are joined with the
benchmark's on the hash. Windows that match with one shift between document and
item are one occurrence. Its slots, what the placeholders stand for, must be
consistent by kind: equal values of the item answer equal values of the
document, and unequal ones unequal ones. Windows with a slot that conflicts
with what most slots say are dropped. An item is found in a document if the consistent
occurrences hold ``coverage`` of its windows, or one of them ``run`` in a row.
Windows are those of two templates, and count by the word that they begin with.

A token is a run of letters, marks and digits, in lower case. A number begins
with a digit. A unit is a word of ``UNITS`` behind a number. A name is a word of
two letters or more, the first of them the only capital; one that begins a
sentence is a literal in the first template and a name in the second. A window needs ``literals`` tokens that aren't placeholders.

Benchmark windows, as rows and not as hashes only, are sent to all tasks in
blocks of about ``BLOCK_WINDOWS``; a larger benchmark takes more passes over the
documents. A block that is larger because very many items share a window is
joined by a shuffle. Units are English and international ones; words of other
languages' units are literals.

Defined results: null and empty texts match nothing, nor do items of fewer
tokens than ``literals``; items shorter than a window are one window of all
their tokens, and documents make windows of each such size that the benchmark
has; rows equal in id and text are one document, and rows that share
an id have a row for each text; equal items are each found; an empty table
gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: Windows in a row that are enough of a long item: 16 tokens, two windows side by side.
RUN = 9
BLOCK_WINDOWS = 1_000_000
CHARS_AT_ONCE = 1 << 19
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t oz lb lbs gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees hz khz mhz ghz kb mb gb tb "
    "w kw kwh v volt volts watt watts mph kmh"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (11, 12, 13))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@cache
def _tables():
    """By code point: lower-case code point, letter or mark or digit, digit, end of a sentence."""
    import unicodedata

    top = 0x40000
    lower, alnum, digit = np.arange(top, dtype=np.uint32), np.zeros(top, bool), np.zeros(top, bool)
    for c in range(top):
        kind = unicodedata.category(chr(c))
        alnum[c], digit[c] = kind[0] in "LMN", kind == "Nd"
        if kind[0] == "L" and len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    stop = np.zeros(top, bool)
    stop[[ord(c) for c in ".!?:;\n\r…。！？"]] = True
    return lower, alnum, digit, stop


_POWERS = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _token_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = _mixed(codes[np.repeat(starts, sizes) + inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 63]
    return _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes)) if len(sizes) else np.zeros(0, np.uint64)


@cache
def _unit_hashes() -> np.ndarray:
    codes = np.frombuffer("".join(UNITS).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in UNITS])
    return np.sort(_token_hashes(codes, ends - np.array([len(x) for x in UNITS]), ends))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def templates(texts: list[str], beginnings: bool = False):
    """Template tokens of all texts in a row: (text number, hash, is placeholder, first and last character in the texts joined, word).

    With ``beginnings``, a capital word that begins a sentence is a name too.
    """
    lower, alnum, digit, stop = _tables()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    safe = np.minimum(raw, len(lower) - 1)
    word = alnum[safe]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return joined, z, z.astype(np.uint64), z.astype(bool), z, z, z
    low = lower[safe]
    hashes = _token_hashes(low, starts, ends)
    capital = np.concatenate(([0], np.cumsum(low != safe)))
    stops = np.concatenate(([0], np.cumsum(stop[safe])))
    ends_of_sentences = np.concatenate(([0], np.cumsum(stop[safe] & (safe != 10) & (safe != 13))))
    before = np.concatenate(([0], ends[:-1]))
    begins = stops[starts] > stops[before]
    begins[0] = True
    number = digit[safe[starts]]
    name = (low[starts] != safe[starts]) & (capital[ends] - capital[starts] == 1) & (ends - starts > 1)
    if not beginnings:
        name &= ~begins
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~number[1:] & _among(hashes[1:], _unit_hashes())
    hashes[number], hashes[name & ~unit], hashes[unit] = _NUMBER, _NAME, _UNIT
    holder = number | name | unit
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, side="right")
    # Equal placeholders in a row are one. A word that begins a sentence stands alone, as it may
    # be no name; one that only begins a line goes on with a name before it.
    hard = ends_of_sentences[starts] > ends_of_sentences[before]
    alone = begins & name & ~unit
    alone[1:] &= hard[1:] | (hashes[:-1] != _NAME)
    first = np.ones(len(starts), bool)
    first[1:] = ~(holder[1:] & (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]) & ~alone[1:] & ~alone[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(starts)) - 1
    return joined, text[heads], hashes[heads], holder[heads], starts[heads], ends[tails], heads - np.searchsorted(text, np.arange(len(texts)))[text[heads]]


def windows(texts: list[str], size: int, literals: int, known: dict[int, np.ndarray] | None = None):
    """(text number, variant, place in the text, word there, tokens, hash, slots, their tokens in it) of each window.

    Both variants of the template are cut, names that begin a sentence as
    literals (0) and as placeholders (1).

    With ``known``, hashes by number of tokens, those of each such number; else
    windows of ``size``, or of all tokens of a shorter text.
    """
    return [x for variant in (0, 1) for x in _variant_windows(texts, variant, size, literals, known)]


def _variant_windows(texts, variant, size, literals, known):
    joined, text, hashes, holder, starts, ends, words = templates(texts, variant == 1)
    n = len(text)
    firsts = np.searchsorted(text, np.arange(len(texts) + 1))
    left = firsts[1:][text] - np.arange(n) if n else np.zeros(0, np.int64)
    own = np.minimum(np.diff(firsts), size)[text] if n else left
    value, taken, rows = np.zeros(n, np.uint64), np.zeros(n, np.int64), []
    for k in range(size):
        here = np.minimum(np.arange(n) + k, max(n - 1, 0))
        value = value * np.uint64(0xA0761D6478BD642F) + hashes[here]
        taken += ~holder[here]
        if known is not None and k + 1 not in known:
            continue
        mixed = _mixed(value + np.uint64(k + 1)).view(np.int64)
        good = (left > k) & (taken >= literals)
        good &= own == k + 1 if known is None else _among(mixed, known[k + 1])
        for i in np.flatnonzero(good).tolist():
            slots = [f"{hashes[x]}:{' '.join(joined[starts[x] : ends[x]].lower().split())}" for x in range(i, i + k + 1) if holder[x]]
            inside = [x for x in range(k + 1) if holder[i + x]]
            rows.append((int(text[i]), variant, i - int(firsts[text[i]]), int(words[i]), k + 1, int(mixed[i]), slots, inside))
    return rows


def _in_pieces(texts: list[str]):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHARS_AT_ONCE):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _windows(size: int, literals: int, known: dict[int, np.ndarray] | None):
    kinds = (*[pa.int64()] * 2, *[pa.int32()] * 4, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            keys, th = batch["id"].to_pylist(), batch["th"].to_pylist()
            rows = []
            for i, j in _in_pieces(texts):
                rows += [(keys[i + t], th[i + t], *rest) for t, *rest in windows(texts[i:j], size, literals, known)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "th", "variant", "place", "word", "tokens", "h", "slots", "inside"])

    return run


_ROWS = "id long, th long, variant int, place int, word int, tokens int, h long, slots array<string>, inside array<int>"


def mapping(places: list[dict]) -> dict[str, str]:
    """What each slot value of the item answers in the document, one to one, by most of the item's slots.

    Of pairs with as many slots, one that is unchanged comes first, then that of more windows.
    """
    at, count = defaultdict(set), Counter()
    for place in places:
        for slot in place["slots"]:
            at[slot["i"], slot["d"]].add(slot["at"])
        count.update({(x["i"], x["d"]) for x in place["slots"]})
    there, back = {}, {}
    for i, d in sorted(at, key=lambda p: (-len(at[p]), p[0] != p[1], -count[p], p)):
        if i not in there and d not in back:
            there[i], back[d] = d, i
    return there


def _consistent(batches):
    """Of each run the words where its windows begin that agree with the mapping, how many are in a row, and whether a slot differs."""
    for batch in batches:
        words, streaks, changed = [], [], []
        for places in batch["places"]:
            places = places.as_py()
            there = mapping(places)
            kept = [p for p in places if all(there.get(x["i"]) == x["d"] for x in p["slots"])]
            order = sorted({p["place"] for p in kept})
            now = most = 0
            for k, place in enumerate(order):
                now = now + 1 if k and place == order[k - 1] + 1 else 1
                most = max(most, now)
            words.append(sorted({p["word"] for p in kept}))
            streaks.append(most)
            told = places if 2 * len(kept) >= len(places) else kept
            changed.append(any(x["i"] != x["d"] for p in told for x in p["slots"]))
        columns = [pa.array(words, pa.list_(pa.int32())), pa.array(streaks, pa.int32()), pa.array(changed, pa.bool_())]
        names = ["id", "th", "item_id", "item_th"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *columns], names=[*names, "words", "streak", "changed"])


def find_benchmark(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, run: int = RUN,
) -> DataFrame:
    """doc_id, th (hash of the text), item_id, matched and item_windows (counts), changed (whether a slot differs)."""
    common.prepare(documents.sparkSession)

    def rows(df: DataFrame, key: str, text: str) -> DataFrame:
        text = F.col(text).cast("string")
        return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text is not null")

    items = common.stored(rows(benchmark, item_col, item_text_col).mapInArrow(_windows(window, literals, None), _ROWS), "item-windows")
    items = items.select(F.col("id").alias("item_id"), F.col("th").alias("item_th"), "variant", F.col("place").alias("item_place"), F.col("word").alias("item_word"), "tokens", "h", F.col("slots").alias("item_slots"), "inside")
    sizes = items.groupBy("item_id", "item_th").agg(F.countDistinct("item_word").alias("item_windows"))
    blocks = max(1, -(-items.count() // BLOCK_WINDOWS))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod("h", F.lit(blocks)) == b).distinct()
        block = F.broadcast(block) if block.count() <= 2 * BLOCK_WINDOWS else block
        known = {}
        for r in block.select("tokens", "h").distinct().collect():
            known.setdefault(r["tokens"], []).append(r["h"])
        known = {k: np.sort(np.array(v, np.int64)) for k, v in known.items()}
        hits = rows(documents, id_col, text_col).mapInArrow(_windows(window, literals, known), _ROWS).drop("inside")
        part = hits.join(block, ["h", "tokens", "variant"])
        found = part if found is None else found.unionByName(part)
    slots = F.arrays_zip(F.transform("inside", lambda x: x + F.col("item_place")).alias("at"), F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    held = F.struct(F.col("item_place").alias("place"), F.col("item_word").alias("word"), slots.alias("slots"))
    where = ["id", "th", "item_id", "item_th", "variant", (F.col("place") - F.col("item_place")).alias("shift")]
    runs = found.groupBy(*where).agg(F.collect_set(held).alias("places"))
    runs = runs.select("id", "th", "item_id", "item_th", "places").mapInArrow(
        _consistent, "id long, th long, item_id long, item_th long, words array<int>, streak int, changed boolean"
    )
    told = runs.groupBy("id", "th", "item_id", "item_th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("matched"),
        F.max("streak").alias("streak"),
        F.max("changed").alias("changed"),
    )
    told = told.join(sizes, (told["item_id"].eqNullSafe(sizes["item_id"])) & (told["item_th"] == sizes["item_th"])).select(
        F.col("id").alias("doc_id"), "th", told["item_id"], "matched", "item_windows", "changed", "streak"
    )
    return told.where((F.col("matched") >= F.lit(coverage) * F.col("item_windows")) | (F.col("streak") >= run)).drop("streak")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(common.source(spark, sf_dir, "documents"), common.source(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long"), F.col("item_windows").cast("long"), "changed")
