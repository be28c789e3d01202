"""The near-duplicate stage against brute force on exact Jaccard similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import near_duplicates, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    """Texts with copies whose similarities lie around 0.8, and bases that share a key or two."""
    rng = random.Random(12)
    made = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        made.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 8):
            words = list(base)
            for at in rng.sample(range(len(words)), max(1, changes * len(words) // 250)):
                words[at] = f"x{rng.randrange(5000)}"
            made.append(" ".join(words))
    return made


@pytest.mark.parametrize("tile", [500, 2])
def test_near_duplicate_stage_is_the_jaccard_of_five_words(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    between = 0
    for i in range(len(texts)):
        for j in range(i):
            if (s := jaccard(texts[i], texts[j])) >= 0.8:
                between += s < 0.95
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert between > 100
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(texts)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(5), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(i) for i in range(len(texts))})


def test_links_below_the_similarity_are_refused(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[50] = "x"  # 91 of 101 shingles
    for at in (20, 40, 60):  # 81 of 111
        far[at] = "y"
    rows = [(i, " ".join(w), None, "s", 0) for i, w in enumerate((words, near, far))] + [(8, "", None, "s", 0), (9, None, None, "s", 0)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 8]


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_links_come_from_the_fingerprints(spark, texts):
    """Of the pairs that are similar enough, those further apart than the radius are not linked: the trees find what is linked."""
    every = {t: simhash.fingerprint_of(near_duplicates.shingles(t.encode(), 5)) for t in texts}
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if 0.8 <= jaccard(a, b) < 1]
    far = [bits(every[a], every[b]) for a, b in pairs]
    assert max(far) <= near_duplicates.RADIUS
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = []
    for radius in (0, sorted(far)[len(far) // 2]):
        up = {t: t for t in texts}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for (a, b), n in zip(pairs, far, strict=True):
            if n <= radius:
                up[find(a)] = find(b)
        groups.append(len({find(t) for t in texts}))
        assert near_duplicates.near_components(docs, radius=radius).select("component").distinct().count() == groups[-1]
    assert groups[1] < groups[0]


@pytest.mark.parametrize("sides", [False, True])
def test_tree_of_a_tile_against_all_pairs(sides):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = np.concatenate([base, base, base ^ rng.integers(0, 2**20, 12, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)])
    side = rng.random(len(prints)) < 0.5 if sides else None
    got = near_duplicates.within(prints, side, 28)
    for i, a in enumerate(prints.tolist()):
        for j, b in enumerate(prints.tolist()):
            assert got[i, j] == (bits(a, b) <= 28 and not (sides and side[i] == side[j]))


def nine(i):
    """Nine words, five shingles, of which the first eight words have four."""
    return [f"{i}{c}" for c in "abcdefghi"]


def test_no_link_is_left_to_chance(spark):
    """Similar texts, 4 of 5 shingles, whose fingerprints are 29 and 30 bits apart, and some of which no band of MinHashes agrees."""
    seeds = [705848, 864916, 1083592, 193328, 325719]
    far = [bits(*(simhash.fingerprint_of(near_duplicates.shingles(" ".join(w).encode(), 5)) for w in (nine(i), nine(i)[:8]))) for i in seeds]
    assert far[:3] == [30, 29, 29]
    rows = [(10 * k + j, " ".join(words), None, "s", 0) for k, i in enumerate(seeds) for j, words in enumerate((nine(i), nine(i)[:8], nine(i)[:7] + ["other"] * 9))]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(10 * k + j for k in range(5) for j in (0, 2))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1])
def test_reach_and_shards_hold_every_similar_pair(spark, similarity):
    """Random sets of 1 to 60 shingles: no similar pair differs in more bits than the reach of either, and each is linked."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(words))
        for _ in range(4):
            some = words[rng.randint(0, len(words) // 4) : len(words) - rng.randint(0, len(words) // 4)]
            texts.append(" ".join(some + [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 3))]))
    texts = sorted(set(texts))
    sets = [near_duplicates.shingles(t.encode(), 5) for t in texts]
    prints = [simhash.fingerprint_of(s) for s in sets]
    reaches = [near_duplicates.reach(simhash.ones_of(s), len(s), similarity) for s in sets]
    assert all((n == 0) == (similarity == 1) for n, s in zip(reaches, sets, strict=True) if len(s) > 20)
    up, found = list(range(len(texts))), 0

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= similarity:
                found += 1
                assert bits(prints[i], prints[j]) <= min(reaches[i], reaches[j])
                up[find(i)] = find(j)
    assert found > 50 or similarity == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_duplicates.near_components(docs, similarity=similarity).collect()
    assert {r.doc_id: r.component for r in got}.keys() == set(range(len(texts)))
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(find(r.doc_id))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(i) for i in up})
