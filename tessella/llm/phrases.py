"""Phrases of words that keep together, mined level by level.

Texts are cut into pieces and words; everything is counted by language. The
words that occur often enough are the first level. A pass over the texts for
each further level counts a phrase of k words only where both of its phrases of
k - 1 words are frequent, since no other can be. What is frequent is told to the
tasks as a table of bits at the hashes of its phrases: it has no false
negatives, the count decides about the rest, and its size has a bound
(``MOST_BITS``) however many phrases there are. With more phrases than the bits
can tell apart, more is counted in vain and the result is the same.

A task counts what it reads in chunks by sorting numbers; equal phrases are then
added up before and after one shuffle a level. Parts of a candidate get their
counts from the level tables: those of more than a ``HOT``-th of all words, of
which there can't be more than ``HOT``, by a broadcast, the others by a shuffle
in which no key has many candidates, as each occurs ``least`` times. Ranks come
from a sort by ranges and the counts of the ranges before, so no language meets
in one task.

Defined results: a null text is empty, an empty one has no words; a null
language is ``und``; rows equal in everything count on their own; ties in score
and count are ranked by the bytes of the phrase; an empty table gives no rows;
other columns are left aside.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 3
LEAST = 10
TOP = 2000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVER = 50
#: Bytes of text that are counted at a time.
CHUNK = 4 << 20
#: Bits for each frequent phrase, and bits at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: A part that makes up more than this share of all words is joined by a broadcast; so there are no more than this many.
HOT = 20_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    string.ascii_uppercase.encode() + _BREAKS + b"\t", string.ascii_lowercase.encode() + b"." * len(_BREAKS) + b" "
)
_COUNTS = "lang string, phrase string, f long"


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of the texts as numbers, and the words; pieces are parted by the word that is a full stop."""
    whole = b". " + b".".join(texts).translate(_TABLE).replace(b".", b" . ") + b" ."
    # Whitespace other than the blank has become a full stop.
    listed = pc.ascii_split_whitespace(pa.array([whole], pa.large_binary()).cast(pa.large_string()))
    words = listed.flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words], np.uint64)


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for the words of each phrase."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _told(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits at the hashes are set; the table has a power of two of bits, 64 a number."""
    at = hashes >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grams(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases that begin at ``at``: the place of one of each kind, and how many there are of it."""
    code = ids[at]
    for j in range(1, k):
        # Renumbered after each word, so that two numbers fit in one.
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code << 32 | ids[at + j]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return at[first], counts


def _counted(k: int, table):
    """Counts of the phrases of k words, by chunks; ``table`` is of those of k - 1."""

    def of_lang(lang: str, texts: list[bytes]):
        ids, words = _words(texts)
        if len(ids) < k:
            return
        stop = ids[0]
        runs = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids == stop, out=runs[1:])
        at = np.arange(len(ids) - k + 1)
        if k > 1:
            hashes = _hashes(lang, words.to_pylist())[ids]
            n = len(ids) - k + 2
            frequent = _told(table.value, _joined([hashes[j : n + j] for j in range(k - 1)]))
            at = at[frequent[:-1] & frequent[1:]]
        at = at[runs[at + k] == runs[at]]  # inside one piece
        if not len(at):
            return
        first, counts = _grams(ids, at, k)
        parts = [words.take(pa.array(ids[first + j])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))
        phrase = phrase.cast(pa.string())
        for i in range(0, len(counts), 20_000):
            n = len(counts[i : i + 20_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), phrase.slice(i, n), pa.array(counts[i : i + n], pa.int64())], names=["lang", "phrase", "f"]
            )

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            langs = batch["lang"].to_pylist()
            data, at = common.utf8(batch["text"])
            for i, lang in enumerate(langs):
                held.setdefault(lang, []).append(data[at[i] : at[i + 1]].tobytes())
                size += int(at[i + 1] - at[i])
                if size >= CHUNK:
                    for name, texts in held.items():
                        yield from of_lang(name, texts)
                    held, size = {}, 0
        for name, texts in held.items():
            yield from of_lang(name, texts)

    return run


def _placed(bits: int):
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches):
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            phrases = [p.split(" ") for p in batch["phrase"].to_pylist()]
            for lang in set(langs.tolist()):
                own = [phrases[i] for i in np.flatnonzero(langs == lang)]
                at = _joined([_hashes(lang, list(words)) for words in zip(*own, strict=True)]) >> shift
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    return run


def bits_of(frequent: DataFrame) -> np.ndarray:
    """The table of bits of (lang, phrase), all of one length."""
    n = frequent.count()
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * n).bit_length()))
    at = frequent.select("lang", "phrase").mapInArrow(_placed(bits), "at long")
    # A row for each 64 bits of the table at most.
    rows = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["i"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def levels_of(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """By length, (lang, phrase, f): all words, and the phrases of f >= ``least``."""
    spark = documents.sparkSession
    common.prepare(spark)
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        table = spark.sparkContext.broadcast(bits_of(found[-1].where(F.col("f") >= least))) if found else None
        counts = rows.mapInArrow(_counted(k, table), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found.append(common.stored(counts.where(F.col("f") >= (least if k > 1 else 1)), f"phrases-{k}"))
    return found


def phrases(
    documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    cover: int = COVER, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` first phrases of 2 to ``longest`` words."""
    levels = levels_of(documents, text_col=text_col, lang_col=lang_col, longest=longest, least=least)
    totals = common.stored(levels[0].groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    n_langs, every = totals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # What a longer candidate covers.
    longer = None
    for k in range(3, longest + 1):
        inside = F.array(*[F.concat_ws(" ", *[F.get(F.split("phrase", " "), i + j) for j in range(m)]) for m in range(2, k) for i in range(k - m + 1)])
        own = levels[k - 1].select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("f").alias("most"))
        longer = own if longer is None else longer.unionByName(own)
    candidates = levels[1].withColumn("k", F.lit(2))
    for k in range(3, longest + 1):
        candidates = candidates.unionByName(levels[k - 1].withColumn("k", F.lit(k)))
    if longer is not None:
        longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f"))).drop("most")
    candidates = common.stored(candidates, "phrase-candidates")

    # Each cut's two parts, and their counts.
    cuts = F.expr("sequence(1, k - 1)")
    asked = candidates.select("lang", "phrase", "f", "k", F.explode(cuts).alias("cut"))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', cut)").alias("part")),
        F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', cut - k)").alias("part")),
    )
    asked = asked.select("lang", "phrase", "f", "cut", F.inline(sides))
    parts = None
    for level in levels[:-1]:
        own = level.where(F.col("f") >= least).select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
        parts = own if parts is None else parts.unionByName(own)
    hot = F.col("n") * HOT > every * (longest - 1)  # of all phrases of any length, so fewer than HOT of them
    near = asked.join(F.broadcast(parts.where(hot).withColumnRenamed("n", "hot_n")), ["lang", "part"], "left")
    told = near.where("hot_n is not null").select("lang", "phrase", "f", "cut", "side", F.col("hot_n").alias("n"))
    rest = near.where("hot_n is null").drop("hot_n").join(parts.where(~hot), ["lang", "part"]).select("lang", "phrase", "f", "cut", "side", "n")
    of = {s: [F.max(F.when((F.col("cut") == k) & (F.col("side") == s), F.col("n"))).alias(f"{s}{k}") for k in range(1, longest)] for s in "lr"}
    scored = told.unionByName(rest).groupBy("lang", "phrase", F.col("f").alias("a")).agg(*of["l"], *of["r"])
    # Counts of below 10^16 keep a million times their square within 38 digits.
    exact = "cast(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(38,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))"
    choices = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(exact.format(l=f"l{k}", r=f"r{k}")).cast("long").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, longest)
    ]
    best = F.array_min(F.array_compact(F.array(*choices)))
    scored = common.stored(scored.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "phrase-scores")

    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    ranges = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = common.stored(ranges.withColumn("part", F.shiftright("at", 33)), "phrase-ranges")
    firsts = ranges.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("lang", "part", (F.col("first") - F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("zero"))
    # A range has many languages, or a language many ranges: the two numbers' sum bounds the rows.
    few = n_langs + ranges.select("part").distinct().count() <= common.BROADCAST_GROUPS
    ranked = ranges.join(F.broadcast(firsts) if few else firsts, ["lang", "part"]).withColumn("rank", F.col("at") - F.col("zero") + 1)
    ranked = ranked.where(F.col("rank") <= top).join(F.broadcast(totals) if n_langs <= common.BROADCAST_GROUPS else totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(common.source(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), word AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece
), f1 AS (
  SELECT lang, w[i] AS p, count(*) AS f FROM word GROUP BY ALL
), f2 AS (
  SELECT lang, w[i] AS p1, w[i + 1] AS p2, count(*) AS f FROM word WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}
), f3 AS (
  SELECT lang, w[i] AS p1, w[i + 1] AS p2, w[i + 2] AS p3, count(*) AS f FROM word WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}
), total AS (
  SELECT lang, sum(f) AS n FROM f1 GROUP BY lang
), longer AS (
  SELECT lang, p1, p2, max(f) AS most FROM (SELECT lang, p1, p2, f FROM f3 UNION ALL SELECT lang, p2, p3, f FROM f3) GROUP BY ALL
), cut AS (
  SELECT f2.lang, f2.p1 || ' ' || f2.p2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 LEFT JOIN longer USING (lang, p1, p2) JOIN f1 x ON x.lang = f2.lang AND x.p = f2.p1 JOIN f1 y ON y.lang = f2.lang AND y.p = f2.p2
  WHERE most IS NULL OR 100 * most < {COVER} * f2.f
  UNION ALL
  SELECT f3.lang, f3.p1 || ' ' || f3.p2 || ' ' || f3.p3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.p = f3.p1 JOIN f2 y ON y.lang = f3.lang AND y.p1 = f3.p2 AND y.p2 = f3.p3
  UNION ALL
  SELECT f3.lang, f3.p1 || ' ' || f3.p2 || ' ' || f3.p3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.p1 = f3.p1 AND x.p2 = f3.p2 JOIN f1 y ON y.lang = f3.lang AND y.p = f3.p3
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
) JOIN total USING (lang) WHERE rank <= {TOP}
"""
