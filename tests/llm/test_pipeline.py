"""The pipeline on a small corpus against plain Python, and its contract."""

import random
import re

import pytest

import corpus_pipeline
from tessella.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    words = {"en": "the and house dog with that this have from they river stone light", "de": "der und haus hund mit dass dies haben von sie fluss stein licht"}
    texts, langs = [], []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        lines = [" ".join(rng.choices(words[lang].split(), k=12)) for _ in range(8)]
        texts.append("\n".join(lines))
        langs.append(lang)
    items = [" ".join(rng.choices(words["en"].split(), k=25)) for _ in range(3)]
    texts[10] = texts[3]  # an exact copy
    texts[11] = texts[5].rsplit(" ", 1)[0] + " stone"  # a near copy
    texts[12] += "\n" + items[0]  # a leak
    texts[13] = "\n".join([*texts[7].split("\n")[:4], *texts[13].split("\n")[4:]])  # repeated lines
    texts[14], texts[15], texts[16] = None, "", "12 34 !!"
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), texts


def test_stages(spark, corpus, tmp_path):
    folder, texts = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    every = set(range(len(texts)))
    assert set(kept["language_id"]) == every - {14, 15, 16}
    lines = kept["line_dedup"]
    assert 10 not in lines and lines[13] == "\n".join(texts[13].split("\n")[4:])
    # The near copy keeps its own last lines only, as the others are repeated lines.
    assert lines[11] == "\n".join(texts[11].split("\n")[-1:])
    same = {i: t for i, t in lines.items() if i not in (11, 13)}
    assert all(same[i] == texts[i] for i in same)
    assert set(kept["simhash_near_dedup"]) == set(lines)
    assert set(kept["benchmark_decontamination"]) == set(lines) - {12}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(lines) - {12}
    again = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_near_duplicate_stage_keeps_one_of_each(spark):
    rng = random.Random(8)
    base = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(400)) + " "
    rows = [(5, base, None, "s", 0), (3, base + "end", None, "s", 0), (9, base, None, "s", 0), (7, "quite another text it is", None, "s", 0), (7, "quite another text it is", None, "s", 0), (None, "alone here", None, "s", 0)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((repr(r.doc_id), r.text[-4:]) for r in got) == [("3", " end"), ("7", "t is"), ("None", "here")]


def test_stage_names_and_empty_tables(spark, corpus):
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "line", "simhash", "benchmark", "best"]
    empty = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus[0]).count() == 0
    assert packing.pack_documents(empty).columns[:2] == ["doc_id", "piece"]
