"""Operators against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import (
    common, decontamination, embeddings, language_id, line_dedup, packing, sharding, simhash, simple8b, suffix_dedup, token_files, tokens,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, th long, found string, rank long"


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, None, "s", 0, 7, "k", 1, "f", 2) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "Ünder", "cat", "sat", "on", "a", "mat.", "no,", "\nYes", "42", "Bob", "km", "ß", "don't", "x\t", "\n\n", "of"]
    made = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(60)]
    made += [made[7], made[7] + " tail", "lead " + made[9], None, "", "a" * 700, "b\n" * 90, "x", "é" * 120, "the end."]
    made += ["\n".join(["same line one of the block", "same line two of it", "and a third line here", str(k)]) for k in range(5)]
    return made


def doc_frames(spark, texts):
    """The rows in a few partitions, with a repeated row and a null id."""
    every = rows(texts) + rows([texts[8]], [8]) + rows([texts[8]], [None])
    return every, spark.createDataFrame(every, DOCS).repartition(5)


def test_encoder_agrees_with_the_library(texts, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    rng = random.Random(1)
    signs = " ,.\n\n  abéñ1 '\"-_\t\x01́\xa0\x1c\x85s​﻿　"
    some = [t or "" for t in texts] + ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)] + ["<|endoftext|>", "so <|endoftext|> it, ends<|endoftext|>"]
    some += [" ".join(filter(None, some)), "no blanks" * 900]
    wanted = library.encode_batch(some, add_special_tokens=False)
    encoder = tokens.Encoder(tokens.default_vocabulary())
    for at_once, remembered in ((tokens.AT_ONCE, tokens.REMEMBERED), (3000, 20_000)):  # long texts in pieces, words forgotten
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        ids, at = encoder.encode(pa.array(some))
        for i, want in enumerate(wanted):
            assert ids[at[i] : at[i + 1]].tolist() == want.ids, some[i][:200]


def ids_of(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [0, 1, 9, 50257, 2**45, 2**64 - 1])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
    values[rng.random(n) < 0.3] = 0
    words, heads, escapes = simple8b.pack(values)
    assert (simple8b.unpack(words, heads, escapes, n) == values).all()


def test_token_files(spark, texts, tmp_path):
    every, df = doc_frames(spark, texts)
    token_files.write_token_files(df, str(tmp_path / "t"), segment_ids=700)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for row, want in zip(got, order, strict=True):
        ids = [*ids_of(want[1]), 0]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (want[0], start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_packing(spark, texts):
    every, df = doc_frames(spark, texts)
    got = packing.pack_documents(df, capacity=64, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= 1.02 * -(-sum(r.length for r in got) // 64) + 1
    found = sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got)
    want = []
    for row in every:
        ids = [*ids_of(row[1]), 2]
        size, at, piece = len(ids) % 64 or 64, 0, 0
        while at < len(ids):
            raw = struct.pack(f"<{size}I", *ids[at : at + size])
            want.append((repr(row[0]), piece, at, size, zlib.crc32(raw), raw))
            at, piece, size = at + size, piece + 1, 64
    assert found == sorted(want)
    packed = spark.createDataFrame([(0, 0, b"ab"), (0, 1, b"c"), (5, 0, b"")], "sequence_id long, offset long, ids binary")
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()} == {0: b"abc", 5: b""}


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        histogram = {n: sizes.count(n) for n in set(sizes)}
        plan, total = packing.plan_best_fit(histogram, 30)
        bins, free = [], []
        for n in sorted(sizes, reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(30 - n)
        assert total == len(free)
        places = [[] for _ in range(total)]
        for n, low, high, first, offset in plan:
            for r in range(low, high):
                places[first + r - low].append((offset, n))
        for p in places:
            at = 0
            for offset, n in sorted(p):
                assert offset == at
                at += n
        assert sorted(n for p in places for _, n in p) == sorted(sizes), bins


def test_sharding(spark, texts, tmp_path):
    every, df = doc_frames(spark, texts)
    sharding.write_shards(df, str(tmp_path / "a"), shards=7, bucket_bytes=3000)
    sharding.write_shards(df.repartition(3), str(tmp_path / "b"), shards=7, bucket_bytes=3000)
    got, again = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1 and sum(counts) == len(every)
    for r in got.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect():
        assert r.slots == list(range(len(r.slots)))
    assert "shard_in" in got.columns
    place = {(r.shard, r.slot): (r.doc_id, r.text) for r in got.collect()}
    assert place == {(r.shard, r.slot): (r.doc_id, r.text) for r in again.collect()}
    assert sorted(map(repr, place.values())) == sorted(repr((r[0], r[1])) for r in every)
    order = [repr(place[k]) for k in sorted(place)]
    assert order != sorted(order)


def test_line_dedup(spark, texts):
    every, df = doc_frames(spark, texts)
    got = line_dedup.remove_repeated_lines(df)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "_lines", "_removed"]
    distinct = sorted({(r[0], r[1]) for r in every}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), {}
    for key, text in distinct:
        lines = None if text is None else text.split("\n")
        covered = set()
        for i in range(len(lines or []) - 2):
            window = tuple(lines[i : i + 3])
            covered |= {i, i + 1, i + 2} if window in seen else set()
            seen.add(window)
        kept = None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in covered)
        want[key, text] = (kept, len(lines or []), len(covered))
    assert sorted((repr(r.doc_id), repr(r.text), r._lines, r._removed) for r in got.collect()) == sorted(
        (repr(r[0]), repr(want[r[0], r[1]][0]), *want[r[0], r[1]][1:]) for r in every
    )


def slow_fingerprint(text, each):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    every, df = doc_frames(spark, texts)
    got = simhash.simhash_components(df).collect()
    mask = (1 << 64) - 1
    fps = {r[1]: slow_fingerprint(r[1], 3) for r in every}
    up = {f: f for f in fps.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for r in every:
        if r[0] is not None:
            root = find(fps[r[1]])
            least[root] = min(least.get(root, r[0]), r[0])
    want = [(repr(r[0]), fps[r[1]], least[find(fps[r[1]])]) for r in every]
    assert sorted((repr(r.doc_id), r.fp & mask, r.component_id) for r in got) == sorted(want)


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(600)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:100]]
    values = list(dict.fromkeys(values))
    tree = simhash.BKTree(np.array(values, np.uint64))
    # The tree that inserting one after another makes.
    kids = {0: {}}
    for new in range(1, len(values)):
        at = 0
        while (child := kids[at].setdefault((values[at] ^ values[new]).bit_count(), new)) != new:
            at = child
        kids[new] = {}
    assert {(at, d): k for at, edges in kids.items() for d, k in edges.items()} == {divmod(s, 65): k for s, k in zip(tree.slots.tolist(), tree.kids.tolist(), strict=True)}
    q, node = tree.near(np.array(values, np.uint64), 3)
    want = [(i, j) for i, v in enumerate(values) for j, x in enumerate(values) if (x ^ v).bit_count() <= 3]
    assert sorted(zip(q.tolist(), node.tolist(), strict=True)) == want
    assert len(values) < tree.visited < 0.8 * len(values) ** 2
    assert list(simhash.BKTree(np.zeros(0, np.uint64)).near(np.array([1], np.uint64), 3)[0]) == []


@pytest.mark.parametrize(("shard", "crowded"), [(512, 8192), (4, 10), (1 << 20, 40)])
def test_shards_hold_all_links(spark, shard, crowded):
    """Trees of many nodes, also where shards are crowded and searched part by part."""
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(150)] + [0]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for v in values[:60] for _ in range(2)]
    values += [values[0] ^ (1 << b) for b in range(40)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    dealt = simhash._sharded(spark.createDataFrame([(v,) for v in signed], "fp long"), shard, crowded)
    dealt = dealt.repartition("key", "row", "column").sortWithinPartitions("key", "row", "column", "fp")
    edges = [(r.a, r.b) for r in dealt.mapInArrow(simhash._links(3), "a long, b long").collect()]
    sizes = [r["count"] for r in dealt.groupBy("key", "row", "column").count().collect()]
    assert max(sizes) > 1 and (crowded > 100 or max(sizes) <= 2 * crowded)

    def components(pairs):
        label, at = np.arange(len(values)), {v: i for i, v in enumerate(signed)}
        a = np.array([[at[x], at[y]] for x, y in pairs] or np.zeros((0, 2)), np.int64)
        common.join_labels(label, a[:, 0], a[:, 1])
        return label.tolist()

    want = [(signed[i], signed[j]) for i, v in enumerate(values) for j, x in enumerate(values) if i < j and (x ^ v).bit_count() <= 3]
    assert components(edges) == components(want) and len(set(components(want))) < len(values)


def slow_repeats(pairs, length):
    seen, out = set(), {}
    for key, data in pairs:
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for k in range(len(data)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[key, data] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("common_anchor", [2_000, 1])
def test_suffix_dedup(spark, texts, common_anchor):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=170))
    more = ["".join(rng.choices("uvwxyz ", k=60)) + passage[a:b] + "".join(rng.choices("uvwxyz ", k=60)) for a, b in ((0, 170), (0, 170), (20, 130), (35, 170), (0, 99), (60, 165))]
    every = rows([*texts, *more, passage * 3])
    every += rows([texts[8]], [8]) + rows([texts[9]], [None])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(every, DOCS).repartition(4), common_anchor=common_anchor).collect()
    distinct = sorted({(r[0], (r[1] or "").encode()) for r in every}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = slow_repeats(distinct, 100)
    found = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert found == sorted((repr(r[0]), *want[r[0], (r[1] or "").encode()]) for r in every)
    assert sum(r.n_removed for r in got) > 1000


def test_deep_shallow_sort():
    rng = random.Random(6)
    data = np.frombuffer(("".join(rng.choices("ab", k=300)) * 2 + "ab" * 90).encode(), np.uint8)
    starts = np.arange(len(data) - 99)
    raw = data.tobytes()
    groups = {}
    for i in starts.tolist():
        groups.setdefault(raw[i : i + 100], []).append(i)
    want = sorted(v for v in groups.values() if len(v) > 1)
    got = suffix_dedup.equal_suffixes(data, starts)
    assert sorted(sorted(g) for g in got) == want
    assert [raw[g[0] : g[0] + 100] for g in got] == sorted(raw[g[0] : g[0] + 100] for g in got)


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 16))
    near = np.repeat(base[:60], 4, axis=0) + 0.06 * rng.standard_normal((240, 16))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate((base, near, base[:5], base[:5]))]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 3, [None] + [1.0] * 15, []]
    data = [(i, v, 1, "c") for i, v in enumerate(vectors)] + [(9000 + i, v, 1, "c") for i, v in enumerate(odd)] + [(None, vectors[0], 1, "c")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf_size=40).collect()}
    unit = np.array([*vectors, vectors[0]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    true = linked.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(vectors))] + [got[None].n_links])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() and true.sum() > 1000
    for i in range(len(odd)):
        assert (got[9000 + i].n_links, got[9000 + i].component_id, got[9000 + i].kept) == (0, 9000 + i, True)
    if found.sum() == true.sum():  # all links are found, so components are those of brute force
        label = np.arange(len(unit))
        common.join_labels(label, *np.nonzero(linked))
        assert [got[i].component_id for i in range(len(vectors))] == label[: len(vectors)].tolist()
    for i in range(len(vectors)):
        c = got[i].component_id
        assert c <= i and got[i].kept == (c == i)
    tiled = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf_size=2000, big=64).collect()}
    exact = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf_size=2000).collect()}
    assert tiled == exact and [exact[i].n_links for i in range(len(vectors))] == true[:-1].tolist()
    label = np.arange(len(unit))
    common.join_labels(label, *np.nonzero(linked))
    assert [exact[i].component_id for i in range(len(vectors))] == label[: len(vectors)].tolist()
    assert all(exact[i].kept == (exact[i].component_id == i) for i in range(len(vectors)))
    empty = embeddings.near_duplicates(df.where("false"))
    assert empty.count() == 0


def test_forest_of_many_levels():
    """Leaves have a bounded number, are the same in any batch, and keep near vectors together at any depth."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3000, 64))
    near = base[:800] + 0.3 * rng.standard_normal((800, 64)) * np.linalg.norm(base[:800], axis=1, keepdims=True) / 8
    unit = np.concatenate((base, near))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = embeddings.fit_forest(unit[::20], 12, embeddings.trees_of(12))
    every = embeddings.leaves_of(unit, forest)
    few = embeddings.leaves_of(unit[100:107], forest)
    for (row, leaf), (r, n) in zip(every, few, strict=True):
        assert np.bincount(row).max() <= 4 and len(np.unique(leaf)) > 400
        assert [sorted(n[r == k]) for k in range(7)] == [sorted(leaf[row == 100 + k]) for k in range(7)]
    pairs = np.einsum("ij,ij->i", unit[:800], unit[3000:]) >= 0.95
    met = np.zeros(800, bool)
    for row, leaf in every:
        names = [set() for _ in range(len(unit))]
        for r, x in zip(row.tolist(), leaf.tolist(), strict=True):
            names[r].add(x)
        met |= np.array([bool(names[i] & names[3000 + i]) for i in range(800)])
    assert pairs.sum() > 100 and met[pairs].mean() > 0.9


def test_ties_at_the_threshold(spark):
    """A cosine of exactly the threshold links; single precision alone would not tell."""
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.6, 0.8 + 1e-7], [0.6 - 1e-7, 0.8], [-1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, threshold=0.6).collect()}
    assert got == {0: 1, 1: 3, 2: 2, 3: 2, 4: 0}


def test_embeddings_of_several_sizes(spark):
    rng = np.random.default_rng(4)
    most, few = rng.standard_normal((90, 16)), rng.standard_normal((60, 5))
    near = few[:10] + 0.001 * rng.standard_normal((10, 5))
    vectors = [v.tolist() for part in (most, few, few[:7], near, most[:3]) for v in part]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf_size=500).collect()}
    for i, v in enumerate(vectors):
        same = [j for j, w in enumerate(vectors) if i != j and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95]
        assert got[i].n_links == len(same)
        assert len(same) == 0 or got[i].component_id <= min(same)
    assert got[150].component_id == 90 and got[150].n_links >= 2
    parts = embeddings.near_duplicates(df, leaf_size=20).collect()
    assert {r.vec_id for r in parts if r.n_links} >= set(range(150, 157))


def test_language_id(spark, texts):
    english = "the cat and the dog were in the house with that other thing they thought about "
    german = "der hund und die katze sind nicht in dem haus und das ist auch schön für dich "
    russian = "это очень хороший день и мы идём домой "
    train = [(i, t * 3, name) for i, (t, name) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 10)]
    model = language_id.fit(spark.createDataFrame(train, "id long, text string, lang string"))
    mixed = english + german
    some = ["the dog thought about that house", "die katze und das haus für dich", "мы идём", None, "", "123 !?", "ελλάδα", mixed]
    df = spark.createDataFrame(rows(some), DOCS)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "ru", "und", "und", "und"]
    assert got[6].lang_pred in ("en", "de", "ru") and got[6].score == 0
    assert language_id.label(["\u0301 \u0301", "a"], model)[0][:2] == ("und", 0.0)
    assert [s.lang for s in got[7].spans] == ["en", "de"]
    assert abs(got[7].spans[1].start - len(english)) <= 4
    assert all(0 <= got[i].score <= 1 for i in got)
    nobody = language_id.fit(spark.createDataFrame([], "id long, text string, lang string"))
    assert language_id.label(["abc"], nobody)[0][:2] == ("und", 0.0)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    bounds = np.array([0, 0, 5, 6, 10])
    emission = rng.standard_normal((10, 3)).astype(np.float32) * 3
    path = language_id.viterbi(emission, bounds, 2.0)
    import itertools

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def value(p):
            return sum(emission[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))

        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(best) - value(path[a:b])) < 1e-4


def test_decontamination(spark):
    question = "If Maria buys 12 apples and Peter eats 5 of them, how many apples does Maria have left after 3 days of eating?"
    changed = question.replace("Maria", "Jonas").replace("12", "40").replace("Peter", "Anna").replace("3 days", "9 hours")
    wrong = question.replace("Peter eats 5", "Maria eats 5").replace("does Maria", "does Peter")
    filler = "it was a long and quiet road through the woods that nobody had taken for years"
    docs = rows([f"{filler}. {question} {filler}.", f"{filler}. {changed} {filler}", f"{filler}. {wrong}", filler, None, "", question.upper(), question[:60]])
    docs += rows([docs[0][1]], [0])
    items = [(1, question, "c"), (2, "short one", "c"), (3, None, "c"), (4, filler + " once more with feeling", "c"), (1, question, "c"), (5, question, "c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = decontamination.find_benchmark(spark.createDataFrame(docs, DOCS), benchmark).collect()
    told = {(r.doc_id, r.item_id): r.changed for r in got}
    assert told[0, 1] is False and told[1, 1] is True and told[0, 5] is False
    assert not {k for k in told if k[0] in (4, 5, 7)} and (2, 1) not in told
    assert {k[0] for k in told if k[1] == 4} == {0, 1, 2, 3}
    assert len(got) == len(set((r.doc_id, r.item_id) for r in got))


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(df).count() == 0
    token_files.write_token_files(df, str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert line_dedup.remove_repeated_lines(df).count() == 0
    assert simhash.simhash_components(df).count() == 0
    assert suffix_dedup.remove_repeats(df).count() == 0
    sharding.write_shards(df, str(tmp_path / "s"))
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontamination.find_benchmark(df, items).count() == 0
    assert decontamination.find_benchmark(df, items.where("false")).count() == 0


def found_items(spark, texts, items):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_benchmark(spark.createDataFrame(rows(texts), DOCS), benchmark).collect()
    return {(r.doc_id, r.item_id): r.changed for r in got}


def test_short_items_inside_long_documents(spark):
    filler = "it was a long and quiet road through the woods that nobody had taken for years"
    items = ["What is the capital of France?", "name the largest ocean", "how far is it to 3 lakes"]
    texts = [f"{filler}. {items[0]} {filler}", f"{filler}. Please {items[1]} now. {filler}", f"{filler}, {items[2].replace('3', '8')}", filler]
    assert found_items(spark, texts, items) == {(0, 0): False, (1, 1): False, (2, 2): True}


def test_names_that_begin_a_sentence(spark):
    item = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    changed = item.replace("Tom", "Anna").replace("5", "7").replace("3", "4")
    texts = [f"Look.\n{changed} Well.", f"so {item}", "Tom has gone. How many apples does it take for the others to be now here?"]
    assert found_items(spark, texts, [item]) == {(0, 0): True, (1, 0): False}


def test_verbatim_excerpts_of_long_items(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(55)]
    texts = ["before it " + " ".join(words[17:37]) + " after it", "before it " + " ".join(words[17:27]) + " after it"]
    assert found_items(spark, texts, [" ".join(words)]) == {(0, 0): False}


def test_a_conflicting_slot_drops_its_windows_only(spark):
    item = "Sam has 3 pens and 3 books. The teacher asks how many things there are in the bag that he brought to school."
    texts = [item.replace("3 pens", "4 pens").replace("3 books", "7 books"), "so it is"]
    twice = "we saw that John Smith was here and later we heard again that John Smith would go to the sea"
    texts += [twice.replace("John Smith", "John\nSmith", 1), twice]
    assert found_items(spark, texts, [item, item.replace("3 books", "5 books"), twice]) == {(0, 0): True, (0, 1): True, (2, 2): False, (3, 2): False}
    assert found_items(spark, [item], [item.replace("3 books", "5 books")]) == {(0, 0): True}


def test_slots_keep_no_line_feeds():
    rows = decontamination.windows(["we saw John\n Smith was here and gone to sea"], 8, 4)
    slots = {x.partition(":")[2] for r in rows for x in r[-2]}
    assert "john smith" in slots and not any("\n" in x for x in slots)


def test_more_languages_than_a_byte_holds():
    rng = np.random.default_rng(0)
    k = 300
    model = language_id.Model([f"l{i:03}" for i in range(k)], np.log(rng.random((1 << 12, k))).astype(np.float32), np.ones((256, k), bool))
    model.scores[:, 280] = 0
    assert language_id.label(["hello there"], model)[0][:2] == ("l280", 1.0)


def test_spans_count_the_texts_own_characters(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], np.log(rng.random((1 << 12, 2))).astype(np.float32), np.ones((256, 2), bool))
    text = "İstanbul İİ x" + "y" * 40
    whole = language_id.label([text, "ab cd"], model, spans=True)
    assert whole[0][2][0][0] == 0 and whole[0][2][-1][1] == len(text)
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 5)  # words longer than what is read at a time
    assert [(x[0], x[2]) for x in language_id.label([text, "ab cd"], model, spans=True)] == [(x[0], x[2]) for x in whole]


def test_sharding_of_equal_rows(spark, tmp_path):
    """Null and equal keys that fill buckets: all rows, gapless slots, counts at most one apart."""
    every = [(None, None)] * 3000 + [(7, "x" * 50)] * 2000 + [(i, f"text {i}") for i in range(1000)]
    sharding.write_shards(spark.createDataFrame(every, "doc_id long, text string").repartition(6), str(tmp_path / "s"), shards=7, bucket_bytes=8000)
    got = spark.read.parquet(str(tmp_path / "s")).toPandas()
    assert len(got) == len(every) and got.doc_id.isna().sum() == 3000 and (got.doc_id == 7).sum() == 2001
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()


def test_token_files_of_null_and_extreme_ids(spark, tmp_path):
    least = -(2**63)
    every = [(None, f"null {i}") for i in range(50)] + [(least, "least")] * 2 + [(3, "three"), (None, None)]
    token_files.write_token_files(spark.createDataFrame(every, "doc_id long, text string").repartition(4), str(tmp_path / "t"))
    got = token_files.read_token_files(spark, str(tmp_path / "t")).toPandas().sort_values("start")
    assert got.doc_id.isna().sum() == 51 and [int(x) for x in got.doc_id.iloc[51:]] == [least, least, 3]
    with pytest.raises(ValueError):
        token_files.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "u"))


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, agree = suffix_dedup.multikey_sorted(words)
    rows_in_order = [tuple(words[i]) for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(500)) and rows_in_order == sorted(map(tuple, words))
    counts = {}
    for w in map(tuple, words):
        counts[w] = counts.get(w, 0) + 1
    assert [b - a for a, b in agree] == [n for w, n in sorted(counts.items()) if n > 1]


def test_a_bucket_that_one_anchor_fills():
    """Contexts are passed on as they come, none is lost, and equal ones still go."""
    rng = np.random.default_rng(5)
    n = 4000
    ctx = rng.integers(1, 600, n).astype(np.uint64)
    akey = np.where(rng.random(n) < 0.8, 11, rng.integers(100, 2000, n)).astype(np.uint64)
    key = np.arange(n, dtype=np.int64)
    x = {"akey": akey, "ctx": ctx * np.uint64(1 << 20) + akey, "key": key, "th": np.zeros(n, np.int64), "s": np.zeros(n, np.int32), "e": np.zeros(n, np.int32)}

    def batches():
        for i in range(0, n, 100):
            yield suffix_dedup._blobs([(0, 0, {k: v[i : i + 100] for k, v in x.items()})])

    found = {0: [], 1: []}
    for batch in suffix_dedup._reduce_contexts(100, 50, most=500)(batches()):
        for kind, a in zip(batch["kind"].to_pylist(), batch["key"].to_pylist(), strict=True):
            found[kind].append(a)
    firsts = {}
    for i in range(n):
        firsts.setdefault((int(akey[i]), int(x["ctx"][i])), i)
    later = set(range(n)) - set(firsts.values())
    assert set(found[1]) <= later and len(found[1]) == len(set(found[1])) > 0
    several = {a for a, _ in firsts if sum(1 for b, _ in firsts if b == a) > 1}
    want = {i for (a, _), i in firsts.items() if a in several}
    assert want <= set(found[0]) and not set(found[0]) & set(found[1]) and later <= set(found[0]) | set(found[1])
