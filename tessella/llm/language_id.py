"""Language spans: script ranges, then Viterbi over word scores.

A word is a run of letters. Its script, from ranges of code points, narrows the
languages to those that were seen with it. Its score under each of these is the
sum of smoothed log-probabilities of its letter trigrams. The best path through
a text's words, with a penalty for every change of language, labels the spans
of a text that mixes languages; the text's language is that of the most letters,
and its score their share of all letters.

The trigram and script counts are learnt by Spark from a bounded sample:
``per_language`` texts of each language in expectation, whole texts, chosen by a
hash of the id. Prediction reads nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a text with letters only of scripts that no language was seen with gets the
language of the best trigrams, with score 0; ties go to the language that sorts
first; repeated rows have a result each; without any
training text all are ``und``; an empty table gives no rows. Spans count the
characters of the text as it is. A text of any length, or without a blank, is
read in chunks, and only its words' scores are held together.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PER_LANGUAGE = 3000
#: Log-probability that a change of language costs.
PENALTY = 9.0
#: Trigram buckets; with more than ``FULL`` languages half as many for each doubling, so a model takes 64 MB at most.
BUCKETS = 1 << 16
FULL = 256
#: A label column with more distinct values than this isn't one of languages, and is refused.
MOST_LANGUAGES = 1 << 14
SMOOTHING = 0.2
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Characters that are read at a time, and those of the texts that go through Viterbi in step.
CHARS_AT_ONCE = 1 << 18
CHARS_IN_STEP = 1 << 19

#: First and last code points of scripts; letters elsewhere are script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or a mark on one, its script, and its lower case (one code point always)."""
    top = 0x40000
    letter, script, lower = np.zeros(top, bool), np.zeros(top, np.uint8), np.arange(top, dtype=np.uint32)
    for c in range(top):
        letter[c] = unicodedata.category(chr(c))[0] in "LM"
        if letter[c]:
            lower[c] = ord(chr(c).lower()[0])
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return letter, script, lower


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a zero after each, and where each begins."""
    codes = np.frombuffer("".join(x + "\0" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))


def _words(codes: np.ndarray, a: int, b: int, buckets: int):
    """Of codes[a:b]: the letters' places, their trigram buckets, which of them begin words, and these words' scripts."""
    letter, script, lower = _tables()
    part = np.concatenate((codes[max(a - 1, 0) : a] if a else np.zeros(1, np.uint32), codes[a : b + 1], np.zeros(int(b >= len(codes)), np.uint32)))
    safe = np.minimum(part, len(letter) - 1)
    kept = np.where(letter[safe], np.where(part < len(letter), lower[safe], part), 0).astype(np.uint32)
    at = np.flatnonzero(kept[1:-1]) + 1
    before, after = kept[at - 1], kept[at + 1]
    mixed = before * np.uint32(0x9E3779B1) + kept[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64) & (buckets - 1)
    starts = np.flatnonzero(before == 0)
    return at - 1 + a, bucket, starts, script[safe[at[starts]]]


def _in_pieces(texts: list[str], most: int = 0):
    """Ranges of texts with ``CHARS_AT_ONCE`` characters, or one longer text."""
    i, most = 0, most or CHARS_AT_ONCE
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _counted(buckets: int):
    """(lang, kind, bucket, n): kind 0 counts trigrams, kind 1 letters by script."""

    def run(batches):
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, name in zip(texts, langs, strict=True) if name == lang]
                counts = np.zeros(buckets, np.int64), np.zeros(256, np.int64)
                for i, j in _in_pieces(own):
                    codes, _ = _code_points(own[i:j])
                    last = 0  # the script of the word that a chunk may go on with
                    for a in range(0, len(codes), CHARS_AT_ONCE):
                        _, bucket, starts, script = _words(codes, a, a + CHARS_AT_ONCE, buckets)
                        counts[0][:] += np.bincount(bucket, minlength=buckets)
                        bounds = np.concatenate(([0], starts, [len(bucket)]))
                        scripts = np.concatenate(([last], script))
                        counts[1][:] += np.bincount(scripts, np.diff(bounds), minlength=256).astype(np.int64)
                        last = scripts[-1]
                for kind, n in enumerate(counts):
                    used = np.flatnonzero(n)
                    m = len(used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * m, pa.string()), pa.array([kind] * m, pa.int32()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())],
                        names=["lang", "kind", "bucket", "n"],
                    )

    return run


class Model:
    """Languages, trigram log-probabilities (bucket, language), candidates by script."""

    def __init__(self, langs: list[str], scores: np.ndarray, allowed: np.ndarray) -> None:
        self.langs, self.scores, self.allowed = langs, scores, allowed


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (id, text, lang), of ``per_language`` texts of each language in expectation."""
    spark = labelled.sparkSession
    common.prepare(spark)
    labelled = labelled.where("text is not null and lang is not null")
    found = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels aren't languages")
    sizes = {r["lang"]: r["count"] for r in found}
    langs = sorted(sizes)
    buckets = BUCKETS
    while len(langs) * buckets > FULL * BUCKETS:
        buckets //= 2
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((256, 0), bool))
    rates = spark.createDataFrame([(x, min(1.0, per_language / sizes[x])) for x in langs], "lang string, rate double")
    chosen = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    sample = labelled.join(F.broadcast(rates), "lang").where(chosen).select("lang", "text")
    # At most ``buckets`` + 256 rows for each language.
    counts = sample.mapInArrow(_counted(buckets), "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((buckets, len(langs)), np.float32), np.zeros((256, len(langs)))
    column = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    for kind, table in enumerate((grams, scripts)):
        own = counts["kind"].to_numpy() == kind
        table[counts["bucket"].to_numpy()[own], column[own]] = counts["n"].to_numpy()[own]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0, dtype=np.float64) + SMOOTHING * buckets)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, scores, allowed & (scripts > 0))


def viterbi(emission: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; texts are the word ranges in ``bounds``.

    All texts go forward a word at a time in step, those with most words first
    so that the ones still going are a prefix.
    """
    n, k = emission.shape
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, sizes = bounds[:-1][order], lengths[order]
    going = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    came = np.zeros((n, k), np.int16)
    value = np.zeros((len(order), k), np.float32)
    for t, m in enumerate(going.tolist()):
        at = starts[:m] + t
        if t:
            v = value[:m]
            best = v.argmax(axis=1)
            switch = (v[np.arange(m), best] - penalty)[:, None]
            moved = v < switch
            came[at] = np.where(moved, best[:, None], np.arange(k))
            value[:m] = np.maximum(v, switch) + emission[at]
        else:
            value[:m] = emission[at]
    path = np.zeros(n, np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        at = starts[:m] + t
        path[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return path


def _scored(codes: np.ndarray, model: Model):
    """Of each word: its place, letters, script, and score by language. Words may be longer than a chunk."""
    place, size, script, score = [], [], [], []
    for a in range(0, len(codes), CHARS_AT_ONCE):
        places, bucket, starts, found = _words(codes, a, a + CHARS_AT_ONCE, len(model.scores))
        head = int(starts[0]) if len(starts) else len(bucket)
        if head:  # the rest of a word that a chunk before has begun
            k = max(i for i, x in enumerate(place) if len(x))
            size[k][-1] += head
            score[k][-1] += model.scores[bucket[:head]].sum(axis=0)
        place.append(places[starts])
        size.append(np.diff(np.append(starts, len(bucket))))
        script.append(found)
        score.append(np.add.reduceat(model.scores[bucket], starts, axis=0) if len(starts) else np.zeros((0, len(model.langs)), np.float32))
    return (np.concatenate(x) for x in (place, size, script, score))


def label(texts: list[str | None], model: Model, penalty: float = PENALTY, spans: bool = False):
    """(language, score, spans) of each text; a span is (start, end, language) in characters."""
    # Texts of like lengths go in step.
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    found = _labelled([texts[i] for i in order], model, penalty, spans)
    return [x for _, x in sorted(zip(order, found, strict=True), key=lambda p: p[0])]


def _labelled(texts: list[str | None], model: Model, penalty: float, spans: bool):
    k = len(model.langs)
    out: list[tuple[str, float, list | None]] = []
    for i, j in _in_pieces([x or "" for x in texts], max(1 << 12, CHARS_IN_STEP * 8 // max(8, k))):
        codes, at = _code_points([x or "" for x in texts[i:j]])
        if not k:
            out += [("und", 0.0, [] if spans else None)] * (j - i)
            continue
        starts, sizes, script, scores = _scored(codes, model)
        if not len(starts):
            out += [("und", 0.0, [] if spans else None)] * (j - i)
            continue
        allowed = model.allowed[script]
        known = allowed.any(axis=1)
        scores[~allowed & known[:, None]] = -1e6
        words = np.searchsorted(starts, at)
        path = viterbi(scores, words, penalty)
        text_of = np.repeat(np.arange(j - i), np.diff(words))
        letters, every = (np.bincount(text_of * k + path, n, minlength=(j - i) * k).reshape(-1, k) for n in (np.where(known, sizes, 0), sizes))
        total = np.bincount(text_of, sizes, minlength=j - i)
        best = np.where(letters.any(axis=1), letters.argmax(axis=1), every.argmax(axis=1))
        for t in range(j - i):
            most = letters[t, best[t]]
            found = None
            if spans:
                found = []
                for w in range(words[t], words[t + 1]):
                    first = int(starts[w] - at[t])
                    name = model.langs[path[w]] if known[w] else "und"
                    if found and found[-1][2] == name:
                        found[-1][1] = first + int(sizes[w])
                    else:
                        found.append([first, first + int(sizes[w]), name])
            text = texts[i + t] or ""
            named = any(map(str.isalpha, text))  # marks alone are no letters
            out.append((model.langs[best[t]] if named else "und", float(most / total[t]) if named and most else 0.0, found))
    return out


def _predicted(model: Model, penalty: float, spans: bool, text_col: str, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            got = label(batch[text_col].to_pylist(), model, penalty, spans)
            columns = {"lang_pred": pa.array([x[0] for x in got], pa.string()), "score": pa.array([x[1] for x in got], pa.float64())}
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                columns["spans"] = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in got], kind)
            rest = list(keep)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], *columns.values()], names=[*rest, *columns])

    return run


def predict(
    documents: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    penalty: float = PENALTY, spans: bool = True,
) -> DataFrame:
    """The columns ``keep``, then lang_pred, score and spans (start, end, lang in characters)."""
    common.prepare(documents.sparkSession)
    rows = documents.select(*dict.fromkeys((*keep, text_col)))
    schema = T.StructType([rows.schema[c] for c in keep]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    if spans:
        kind = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType())
        schema = schema.add("spans", T.ArrayType(kind))
    return rows.mapInArrow(_predicted(model, penalty, spans, text_col, keep), schema)


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def fit_documents(documents: DataFrame) -> Model:
    """Learn from the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    return fit(documents.where(_fold() != 0).select(F.col("doc_id").alias("id"), "text", "lang"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.source(spark, sf_dir, "documents")
    found = predict(documents.select("doc_id", "text"), fit_documents(documents), spans=False)
    return found.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
