"""Vector codes, license scan and phrases against plain Python, on tables of their own and on the smallest given ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import common, license_scan, phrases, vector_codes

DATA = "/root/testdata/sf0.001"


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) of vectors that are taken, in the order of ids."""
    ints = [[int(np.floor(4096.0 * x)) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    cut = np.array(ints, object).reshape(len(rows), parts, width)
    books = [cut[:entries, p].copy() for p in range(parts)]

    def nearest():
        d2 = [((cut[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)]
        return [d.argmin(1) for d in d2], sum(d.min(1) for d in d2)

    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                own = cut[codes[p] == k, p]
                if len(own):
                    books[p][k] = [int(s) // len(own) for s in own.sum(0)]
    codes, errors = nearest()
    sums = Counter()
    for (_, _, label), e in zip(rows, errors.tolist(), strict=True):
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{codes[p][i]:02x}" for p in range(parts)), errors[i], sums[r[2]], sha) for i, r in enumerate(rows)]


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_codes_of_the_given_vectors(spark):
    rows = sorted(pq.read_table(f"{DATA}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in rows if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    assert by_id(vector_codes.op11_vector_codes(spark, DATA).collect()) == by_id(plain_codes(rows))


KIND = "vec_id long, embedding array<double>, label int, code string"


def test_codes_with_ties_copies_and_large_components(spark):
    rng = random.Random(3)
    kinds = [[rng.choice([-1.0, 0.0, 0.5, 2.0**40, 1 / 3]) for _ in range(16)] for _ in range(40)]
    rows = [(i, rng.choice(kinds), rng.choice([1, 2, None])) for i in range(300)]
    bad = [(400, None, 1), (401, [float("nan")] * 16, 1), (402, [None] * 16, 1), (403, [float("inf")] * 16, None), (404, [1e300] * 16, None)]
    odd = [(405, [1.0, 2.0], 2), (406, [], None)]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad + odd], KIND).repartition(7)
    want = plain_codes(rows)
    most = (1 << 63) - 1
    want = [(i, c, e if e <= most else None, s, sha) for i, c, e, s, sha in want]
    sums = defaultdict(int)
    for (_, _, label), (_, _, e, _, _) in zip(rows, want, strict=True):
        sums[label] += e or 0
    want = [(i, c, e, sums[r[2]] if sums[r[2]] <= most else None, sha) for r, (i, c, e, _, sha) in zip(rows, want, strict=True)]
    got = by_id(vector_codes.vector_codes(table).collect())
    assert [r for r in got if r[0] < 400] == by_id(want)
    assert [(r[0], r[1], r[2]) for r in got if r[0] >= 400] == [(405, None, None), (406, None, None)]


def test_few_vectors_repeated_ids_and_no_vectors(spark):
    rows = [(1, [0.1] * 8, None), (1, [0.2] * 8, None), (None, [0.3] * 8, 5), (1, [0.1] * 8, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    ordered = [rows[0], rows[3], rows[1], rows[2]]
    assert by_id(vector_codes.vector_codes(table).collect()) == by_id(plain_codes(ordered))
    assert vector_codes.vector_codes(table.where("false")).count() == 0
    assert [tuple(r)[:3] for r in vector_codes.vector_codes(spark.createDataFrame([(1, [1.0], 2, "x")], KIND)).collect()] == [(1, None, None)]


def test_bounds_spare_most_of_the_work_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    book = x[:16].copy()
    group, state, moved, looked = vector_codes.groups_of(book), (None, None), None, []
    for _ in range(6):
        code, bounds, best, n = vector_codes.assign(x, book, group, *state, moved)
        d2 = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (code == d2.argmin(1)).all() and (best == d2.min(1)).all()
        for g in np.unique(group):
            others = np.where((np.arange(16)[None] == code[:, None]) | (group != g)[None], np.inf, np.sqrt(d2))
            assert (bounds[:, g] <= others.min(1)).all()
        looked.append(n)
        new = np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else book[k] for k in range(16)])
        moved, book, state = np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-12), new, (code, bounds)
    assert looked[0] == 16 * 4000 and looked[-1] < looked[0] / 3


def test_sums_by_label_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 1)
    monkeypatch.setattr(common, "HUB", 20)
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(8)], rng.choice([7, 7, 7, None, i % 9])) for i in range(80)]
    table = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    assert by_id(vector_codes.vector_codes(table).collect()) == by_id(plain_codes(rows))


# License scan

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_labels(text, templates=license_scan.TEMPLATES, phrases=license_scan.PHRASES):
    words = WORD.findall(lower(text))
    places, base, own, most = [], set(), set(), 0.0
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, body in templates:
        t = WORD.findall(lower(body))
        size = 8
        while size < len(t):
            size *= 2
        blocks = [words[i : i + 2 * size] for i in range(0, max(1, len(words) - size), size)]
        held = max(len(set(b) & set(t)) / len(set(t)) for b in blocks)
        if held >= 0.8:
            own.add(label)
            most = max(most, held)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else most)


def test_license_labels(spark):
    rng = random.Random(6)
    common_words = sorted({w for _, body in license_scan.TEMPLATES for w in WORD.findall(lower(body))})
    fill = lambda n: " ".join(rng.choice(["Öl", "stone", "river42", "the", "of", "license", *common_words[:20]]) for _ in range(n))
    texts = [None, "", "!!! --- \n", "mit", "MIT License", "MIT-License; mit license", "the GNU General Public License general public license", "K license mIt licenSe"]
    for _, body in license_scan.TEMPLATES:
        words = body.split()
        texts += [body, body.upper(), fill(300) + "\n# " + body.replace("\n", "\n# ") + fill(40)]
        for share in (0.1, 0.19, 0.25, 0.5):
            some = [w for w in words if rng.random() > share]
            rng.shuffle(some)
            texts.append(fill(rng.randrange(50)) + " ".join(some) + fill(rng.randrange(300)))
    texts.append(" ".join(license_scan.TEMPLATES[0][1].split()[:20]) + fill(20_000) + license_scan.TEMPLATES[3][1])
    rows = [(i % 50, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, texts[8], "x", 1.0), (3, texts[3], "x", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(5)
    got = license_scan.license_labels(table).collect()
    assert by_id(got) == by_id([(r[0], *plain_labels(r[1])) for r in rows])
    assert {x for r in got for x in r.labels.split(",")} == {"", *(label for label, _ in license_scan.TEMPLATES)}
    assert license_scan.license_labels(table.where("false")).count() == 0


def test_license_blocks_and_templates(spark):
    table = spark.createDataFrame([(7, "a b c d e f g h " * 3 + license_scan.TEMPLATES[-2][1])], "doc_id long, text string")
    scan = license_scan.scanned(table)
    held = license_scan.matching_blocks(scan).collect()
    assert {(r.template, r.label, r.first_word, r.containment) for r in held} == {(len(license_scan.TEMPLATES) - 2, "cc", 16, 1.0)} | {(len(license_scan.TEMPLATES) - 2, "cc", 24, 1.0) for r in held if r.first_word == 24}
    with pytest.raises(ValueError, match="no word"):
        license_scan.license_labels(table, templates=(("x", "--"),))
    with pytest.raises(ValueError, match="more than"):
        license_scan.license_labels(table, templates=(("x", " ".join(map(str, range(30_000)))),))


def test_license_plan_has_no_python_and_no_cross_join(spark):
    plan = license_scan.op12_license_scan(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# Phrases


def plain_phrases(rows, longest=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * covered[p] < cover * a or not covered[p]:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "York", "City", "Öl", "öl", "a b", "ß", "x1", "—", "\x00z", "n't"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(words) if rng.random() < 0.6 else "new york city" for _ in range(rng.randrange(1, 40))]
        texts.append("".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", " ", " "]) for p in parts))
    return [(rng.choice(["en", "en", "en", None, "und", "de"]), t) for t in texts] + [("en", None), ("fr", ""), (None, None), ("fr", "...")]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases(spark, monkeypatch, longest):
    monkeypatch.setattr(phrases, "CHUNK", 3000)
    monkeypatch.setattr(phrases, "HOT", 40)  # so that parts are joined either way
    rows = corpus(longest)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(6)
    got = phrases.phrases(table, longest=longest).collect()
    want = plain_phrases(rows, longest)
    assert by_id(got) == by_id(want) and any(w[2].count(" ") == longest - 1 for w in want)
    assert by_id(phrases.phrases(table, longest=longest, top=7, least=3, cover=80).collect()) == by_id(plain_phrases(rows, longest, 3, 80, 7))


def test_phrases_of_nothing_and_of_one_word(spark):
    table = spark.createDataFrame([("en", "a"), (None, "b c")], "lang string, text string")
    assert phrases.phrases(table.where("false")).count() == 0 and phrases.phrases(table).count() == 0
    one = [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.phrases(table, least=1).collect()]
    assert one == [("und", 1, "b c", 1, 1, 1, 2, 1_000_000)]


def test_phrases_with_full_bits_are_the_same(spark, monkeypatch):
    rows = corpus(9)
    table = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert by_id(phrases.phrases(table).collect()) == by_id(plain_phrases(rows))


# Buckets that share partitions, and vectors of extreme components


def test_buckets_that_share_partitions(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.llm import sharding, suffix_dedup

    rng = random.Random(11)
    passage = " ".join(rng.choice(["stone", "river", "light", "house"]) + str(rng.randrange(50)) for _ in range(60))
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(60)) + (passage if i % 5 == 0 else "")) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards, spans = [], []
    for most in (10_000, 3):
        monkeypatch.setattr(common, "MOST_PARTITIONS", most)
        path = str(tmp_path / str(most))
        sharding.write_shards(table, path, shards=7, bucket_bytes=3000)
        shards.append(sorted(map(tuple, spark.read.parquet(path).select("doc_id", "text", "shard", "slot").collect())))
        gone = suffix_dedup.remove_repeats(table, bucket_bytes=4000).select("doc_id", "n_removed", F.md5("kept"))
        spans.append(sorted(map(tuple, gone.collect())))
    assert shards[0] == shards[1] and spans[0] == spans[1] and sum(r[1] for r in spans[0]) > 50 * 100
    counts = Counter(r[2] for r in shards[0])
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r[3] for r in shards[0] if r[2] == k) == list(range(n)) for k, n in counts.items())


def test_vectors_of_extreme_components(spark):
    from tessella.llm import embeddings

    base = [0.3, -0.7, 0.64]
    rows = [(0, base), (1, [x * 1e200 for x in base]), (2, [x * 1e-200 for x in base]), (3, [5e-324, 0.0, 0.0]), (4, [1.7e308, 1e300, 0.0]), (5, [-x * 1e250 for x in base]), (6, [0.0] * 3), (7, [float("inf"), 0.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)]
