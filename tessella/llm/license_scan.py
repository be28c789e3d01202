"""License notices: an exact set-similarity join of text blocks with templates.

A block holds a template if it has at least ``threshold`` of the template's
distinct words (containment). Blocks are windows of words, whatever the lines:
templates fall in classes by length, a class of up to L words has blocks of 2 L
words that begin every L words, so a passage of a template's length lies whole
in one of them.

Words are ordered by the number of documents of the whole corpus that have
them, rarest first. A block can reach the overlap that a template needs only if
it has one of the template's rarest words (prefix filter), has as many of the
class's words as the overlap (length filter), and has enough words left behind
the first common one, in both orders (positional filter). What passes is
counted exactly. Blocks have only words of the templates, as no other can add to
an overlap; texts are read once, and only blocks that pass the length filter
are written down, so a text is never shuffled.

All of it is DataFrame functions. Templates are a parameter, of ``MOST_WORDS``
words together at most, so what is broadcast has a bound whatever the corpus.

Defined results: a null or empty text has no words and no label; a text shorter
than a block is one block; rows equal in id and text count on their own; null
ids stay null; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Words of all templates together, which are literals of the plan and are broadcast.
MOST_WORDS = 20_000
#: The shortest class: templates of up to so many words.
LEAST = 8
#: What stands between words, as Java's and RE2's patterns.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand in a row, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices as their licenses word them, and their labels.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is
     distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
     for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
     later version."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
     warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met"""),
    ("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
     disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
     publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
     purpose, commercial or non-commercial, and by any means."""),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "the author has waived all copyright and related or neighboring rights to this work"),
)

_STORED = "array<struct<block: long, words: array<string>>>"


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def classes_of(templates: Sequence[tuple[str, str]], threshold: float) -> dict[int, list[dict]]:
    """By class (its block's words are twice its name): number, label, distinct words and needed overlap of its templates."""
    found: dict[int, list[dict]] = {}
    for number, (label, text) in enumerate(templates):
        words = _words_of(text)
        if not words:
            raise ValueError(f"template {number} ({label}) has no word")
        size = max(LEAST, 1 << (len(words) - 1).bit_length())
        own = sorted(set(words))
        need = max(1, math.ceil(round(threshold * len(own), 9)))
        found.setdefault(size, []).append({"template": number, "label": label, "words": own, "need": need})
    if sum(len(t["words"]) for own in found.values() for t in own) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    return found


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _blocks(words: Column, n: Column, tokens: Column, size: int, own: list[dict]) -> Column:
    """The blocks of a class with as many of its words as its least demanding template needs."""
    vocabulary = _strings(sorted({w for t in own for w in t["words"]}))
    need = min(t["need"] for t in own)
    last = F.greatest(F.ceil(n / size) - 2, F.lit(0)).cast("long")
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.struct(i.alias("block"), F.array_intersect(F.slice(words, (i * size + 1).cast("int"), 2 * size), vocabulary).alias("words")),
    )
    may = F.size(F.array_intersect(tokens, vocabulary)) >= need  # of the whole text, so of each block
    return F.when(may, F.filter(each, lambda b: F.size(b["words"]) >= need)).otherwise(F.array().cast(_STORED))


def _places(words: Column, n: Column, low: Column, phrase: str) -> Column:
    """Where the phrase's words stand in a row."""
    own = _words_of(phrase)
    here = F.filter(
        F.sequence(F.lit(0), n - len(own)),
        lambda i: _all(F.get(words, i + k) == w for k, w in enumerate(own)),
    )
    may = (n >= len(own)) & F.contains(low, F.lit(max(own, key=len)))
    return F.when(may, here).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _listed(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def scanned(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Written down, a row per document: ``row``, ``doc_id``, n_words, phrases' places, distinct template words, blocks by class."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = documents.select(F.col(id_col).alias("doc_id"), low.alias("low"))
    rows = rows.select("doc_id", "low", F.array_remove(F.split("low", BETWEEN), "").alias("words"))
    classes = classes_of(templates, threshold)
    every = _strings(sorted({w for own in classes.values() for t in own for w in t["words"]}))
    rows = rows.select("doc_id", "low", "words", F.size("words").alias("n"), F.array_intersect("words", every).alias("tokens"))
    col = {c: F.col(c) for c in ("words", "n", "low", "tokens")}
    places = [_places(col["words"], col["n"], col["low"], p).alias(f"p{i}") for i, p in enumerate(phrases)]
    blocks = [_blocks(col["words"], col["n"], col["tokens"], size, own).alias(f"b{size}") for size, own in classes.items()]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n").cast("long").alias("n_words"), *places, "tokens", *blocks)
    return common.stored(rows, "license-blocks")


def matching_blocks(
    scan: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """row, first_word, n_block_words, template, label, containment of every block of ``scanned`` that holds a template."""
    spark = scan.sparkSession
    classes = classes_of(templates, threshold)
    # A row for each word of the templates at most.
    known = {w for own in classes.values() for t in own for w in t["words"]}
    told = scan.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    seen = dict.fromkeys(known, 0) | {r["word"]: r["n"] for r in told}
    order = sorted(known, key=lambda w: (seen[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for size, own in classes.items():
        for t in own:
            words = sorted(t["words"], key=rank.__getitem__)
            shared = {"size": size, "template": t["template"], "label": t["label"], "need": t["need"], "of": len(words), "all": words}
            index += [shared | {"word": w, "i": i} for i, w in enumerate(words[: len(words) - t["need"] + 1])]
    found = None
    for size in classes:
        own = _listed(spark, [x for x in index if x["size"] == size], "word: string, i: int, template: int, label: string, need: int, of: int, all: array<string>")
        blocks = scan.where(F.size(f"b{size}") > 0).select("row", F.explode(f"b{size}").alias("b"))
        blocks = blocks.select("row", F.col("b.block").alias("block"), F.array_intersect(_strings(order), F.col("b.words")).alias("words"))
        prefix = blocks.select("row", "block", "words", F.posexplode("words").alias("j", "word")).join(F.broadcast(own), "word")
        m = F.size("words")
        may = (m >= F.col("need")) & (1 + F.least(F.col("of") - F.col("i") - 1, m - F.col("j") - 1) >= F.col("need"))
        prefix = prefix.where(may).withColumn("common", F.array_intersect("words", "all"))
        # Counted at the first common word only, so once.
        held = prefix.where((F.get("common", F.lit(0)) == F.col("word")) & (F.size("common") >= F.col("need")))
        held = held.select(
            "row", (F.col("block") * size).alias("first_word"), F.lit(2 * size).cast("long").alias("n_block_words"), "template", "label",
            (F.size("common") / F.col("of")).alias("containment"),
        )
        found = held if found is None else found.unionByName(held)
    if found is None:
        raise ValueError("there are no templates")
    return found


def license_labels(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The score is 1 where a phrase stands, else the largest containment of a
    block that holds a template, else 0.
    """
    scan = scanned(documents, id_col=id_col, text_col=text_col, phrases=phrases, templates=templates, threshold=threshold)
    held = matching_blocks(scan, templates=templates, threshold=threshold)
    held = held.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("containment").alias("most"))
    every = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))])) if phrases else F.array().cast("array<int>")
    labels = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    base = F.array_distinct(F.array_compact(F.array(*labels))) if labels else F.array().cast("array<string>")
    rows = scan.select("row", "doc_id", "n_words", every.alias("places"), base.alias("base")).join(held, "row", "left")
    n = F.size("places")
    return rows.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(common.source(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Without any filter: each block's words are joined with each template's and counted."""
    classes = classes_of(TEMPLATES, THRESHOLD)
    words = ", ".join(f"({size}, {t['template']}, '{t['label']}', {t['need']}, {len(t['words'])}, '{w}')" for size, own in classes.items() for t in own for w in t["words"])
    said = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM seq WHERE " + " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(_words_of(phrase)))
        for phrase, label in PHRASES.items()
    )
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{BETWEEN.replace("[", "[^")}') AS words
  FROM documents
), word AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM split
), seq AS (
  SELECT doc_id, i, w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), said AS ({said}), base AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM said GROUP BY doc_id
), template(size, template, label, need, of, w) AS (VALUES {words}
), last AS (
  SELECT doc_id, size, greatest(0, ceil(len(words) / size)::BIGINT - 2) AS last
  FROM split, (SELECT DISTINCT size FROM template)
), block AS (
  SELECT DISTINCT word.doc_id, t.size, template, label, need, of, word.w, least(word.i // t.size, last) - k AS block
  FROM word JOIN template t ON word.w = t.w JOIN last ON last.doc_id = word.doc_id AND last.size = t.size, (VALUES (0), (1)) AS v(k)
  WHERE least(word.i // t.size, last) - k >= 0 AND word.i < (least(word.i // t.size, last) - k + 2) * t.size
), held AS (
  SELECT doc_id, label, count(*) / of AS containment FROM block
  GROUP BY doc_id, size, block, template, label, need, of HAVING count(*) >= need
), named AS (
  SELECT doc_id, max(containment) AS most FROM held GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names
  FROM (SELECT doc_id, label FROM held UNION ALL SELECT doc_id, label FROM said) GROUP BY doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(base.names, '') AS base_labels, coalesce(every.names, '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(most, 0) END::DOUBLE AS score
FROM split s LEFT JOIN base ON s.doc_id = base.doc_id LEFT JOIN named ON s.doc_id = named.doc_id LEFT JOIN every ON s.doc_id = every.doc_id
"""


ORACLE = _oracle()
