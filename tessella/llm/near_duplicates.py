"""Near-duplicates by SimHash fingerprints and Burkhard-Keller trees, each link verified by the exact Jaccard similarity; no link is lost.

A text's words and the bits of its fingerprint are those of the SimHash rule
(``simhash.py``); its shingles are the distinct XXH64 hashes of ``words_each``
words in a row. Texts of equal shingles are one class, with one fingerprint.

Two classes of the similarity share that part of the shingles of either, so
they can be told from others without a guess, in two passes:

1. Of the least ``size - need + enough`` shingles of each, by hash, they share
   ``enough``; a class that shares fewer with all others has no neighbour.
2. Of those left, whose shingles are counted, a class that shares fewer than
   ``need`` with all others has none either. The others' rarest
   ``size - need + 1`` shingles name the shards: two similar classes have one of
   these in common. Shingles of the same classes name one shard.

First each class is held against the root of its trees, the least class of each
of its shards, if at most ``RADIUS`` bits apart. That mostly joins all the
classes of a shard; only shards that still hold several components get their
whole trees, first each class in its largest shard, then those that hold several
even so. A class searches at its ``reach``, the number of bits that a text of the
similarity can change: those whose majority is no larger than the shingles that
may differ. That is about 20 of 64 bits for 5 shingles and nearly all from a hundred
on, where a tree finds its whole shard and the similarity decides. Trees are
dealt out in tiles of about ``TILE`` classes, so no task holds a large shard's
classes. The shared shingles of what a tile's tree finds are counted by a matrix
product, and it returns a link for each class that it joins to another, never
the pairs. The time of a shard whose classes aren't near each other grows with
their number's square.

Defined results: null texts and texts without words have no shingles and are
one class; fewer words than a shingle make one shingle; a null id belongs to a
component but names none; an empty table gives no rows; other columns are left
aside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

#: Bits in which a class differs at most from a root that it is held against; what differs more is found by the trees.
RADIUS = 28
#: Classes of a shard that a task compares with each other.
TILE = 512
#: Shingles of a tile that are counted at a time.
SHARED_AT_ONCE = 1 << 12
#: Share of a class's shingles that the first pass takes beyond the least it must, and finds in other classes if they are similar.
MORE = 0.06


def shingles(text: bytes, words_each: int) -> np.ndarray:
    """The distinct shingles of UTF-8 bytes in rising order."""
    return np.unique(simhash.shingle_hashes(text, words_each))


def shared_at_least(size: int, similarity: float) -> int:
    """How many of ``size`` shingles are shared with any set of the similarity."""
    return math.ceil(size * similarity - 1e-9)


def reach(ones: np.ndarray, size: int, similarity: float) -> int:
    """In how many bits the fingerprint can differ from that of any set of the similarity; ``ones`` counts the shingles that set a bit."""
    changed = math.floor(size * (1 - similarity) / similarity + 1e-9)  # shingles in one of both sets only
    majority = 2 * ones - size
    return int(((-changed < majority) & (majority <= changed)).sum())


def _class(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED) - 2**63


def _texts(batch: pa.RecordBatch):
    data, at = common.utf8(batch["text"])
    data = data.tobytes()
    return (data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view(np.int64)))


def _sets_of(column) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column]


def _classes(words_each: int, similarity: float, radius: int):
    def run(batches):
        for batch in batches:
            names, counts, needs, prints, reaches, first = [], [], [], [], [], [np.zeros(0, np.uint64)]
            for text in _texts(batch):
                found = shingles(text, words_each)
                size, ones = len(found), simhash.ones_of(found)
                need = shared_at_least(size, similarity)
                names.append(_class(found))
                counts.append(size)
                needs.append(need)
                prints.append(simhash.majority(ones, size))
                reaches.append(min(radius, reach(ones, size, similarity)))
                first.append(found[: size - need + min(need, math.ceil(size * MORE))])
            longs = [pa.array(x, pa.int64()) for x in (names, counts, needs, prints, reaches)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["th"], *longs, _lists(first)[1:]],
                names=["doc_id", "th", "class", "size", "need", "fp", "reach", "first"],
            )

    return run


def _sets(words_each: int):
    def run(batches):
        for batch in batches:
            found = _lists([np.zeros(0, np.uint64), *(shingles(x, words_each) for x in _texts(batch))])[1:]
            yield pa.RecordBatch.from_arrays([batch["class"], found], names=["class", "found"])

    return run


def _near(similarity: float):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(*(_sets_of(batch[c]) for c in ("found_a", "found_b")), strict=True):
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(both / (len(x) + len(y) - both) >= similarity)
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(good), batch["b"].filter(good)], names=["a", "b"])

    return run


def within(prints: np.ndarray, side: np.ndarray | None, radius: int | np.ndarray) -> np.ndarray:
    """Which pairs of a tile's classes a BK-tree of their fingerprints finds at most ``radius`` bits apart, that of either; across ``side``, if given."""
    own, asking = (np.arange(len(prints)),) * 2 if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    values, node_of = np.unique(prints[own], return_inverse=True)
    queries, query_of = np.unique(prints[asking], return_inverse=True)
    tree, hit, far = simhash.BKTree(values), np.zeros((len(queries), len(values)), bool), np.zeros(len(queries), np.int64)
    np.maximum.at(far, query_of, np.broadcast_to(radius, len(prints))[asking])
    for i in range(0, len(queries), simhash.QUERIES):
        q, node = tree.near(queries[i : i + simhash.QUERIES], far[i : i + simhash.QUERIES])
        hit[i + q, node] = True
    close = np.zeros((len(prints), len(prints)), bool)
    close[np.ix_(asking, own)] = hit[np.ix_(query_of, node_of)]
    return close | close.T


def similar(found: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have the similarity, counted on the whole sets."""
    n, sizes = len(found), np.array([len(x) for x in found], np.float32)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    names, place, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = counts > 1  # others are in one set only
    place, owner = (np.cumsum(shared) - 1)[place[shared[place]]], owner[shared[place]]
    order = np.argsort(place, kind="stable")
    place, owner, both = place[order], owner[order], np.zeros((n, n), np.float32)
    for i in range(0, int(shared.sum()), SHARED_AT_ONCE):
        a, b = np.searchsorted(place, (i, i + SHARED_AT_ONCE))
        member = np.zeros((n, min(SHARED_AT_ONCE, int(shared.sum()) - i)), np.float32)
        member[owner[a:b], place[a:b] - i] = 1
        both += member @ member.T
    return both.astype(np.float64) / (sizes[:, None] + sizes[None] - both) >= similarity


def tile_links(found: list[np.ndarray], prints: np.ndarray, roots: np.ndarray, side: np.ndarray | None, similarity: float, radius: int | np.ndarray) -> np.ndarray:
    """The least place that each set hangs together with by similar pairs that the tree finds, of different roots (and sides, if given)."""
    label = np.arange(len(found))
    close = within(prints, side, radius) & (roots[:, None] != roots[None])
    some = np.flatnonzero(close.any(axis=0))
    if len(some):
        near = similar([found[i] for i in some], similarity) & close[np.ix_(some, some)]
        common.join_labels(label, *(some[x] for x in np.nonzero(np.triu(near, 1))))
    return label


def _compared(similarity: float):
    def run(batches):
        for table in common.groups(batches, ["key", "row", "column"]):
            if len(table) < 2:
                continue
            found = _sets_of(table["found"])
            row, column = table["row"][0].as_py(), table["column"][0].as_py()
            side = None if row == column else table["part"].to_numpy() == row
            prints, roots, reaches = (table[c].to_numpy() for c in ("fp", "root", "reach"))
            label = tile_links(found, prints.view(np.uint64), roots, side, similarity, reaches)
            names, moved = table["class"].to_numpy(), np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(names[label[moved]]), pa.array(names[moved])], names=["a", "b"])

    return run


def _met(rows: DataFrame) -> DataFrame:
    """The rows of a key that another class has too, with their number ``n``."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _shards(sets: DataFrame, facts: DataFrame) -> DataFrame:
    """class, size, fp, reach, key, least (and its size and fingerprint) and n: the shards of all classes that may have a neighbour."""
    own = Window.partitionBy("class")
    named = _met(sets.select("class", F.explode("found").alias("key")))
    named = named.withColumns({"place": F.row_number().over(own.orderBy("n", "key")), "shared": F.count("*").over(own)})
    # A class's other shingles, which no other class has, are rarer and so come before.
    named = named.join(facts, "class").where("place <= shared - need + 1").select("class", "size", "fp", "reach", "key")
    named = common.stored(named, "near-prefixes")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "class")).alias(f"mark{i}") for i in range(2)]
    least = named.groupBy("key").agg(
        F.min("class").alias("least"), F.min_by("size", "class").alias("least_size"), F.min_by("fp", "class").alias("least_fp"), F.count("*").alias("n"), *marks
    )
    least = least.where("n > 1").groupBy("least", "least_size", "least_fp", "n", "mark0", "mark1").agg(F.min("key").alias("key")).drop("mark0", "mark1")
    return common.stored(named.join(least, "key"), "near-keys")


def near_components(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, similarity: float = 0.8, radius: int | None = None
) -> DataFrame:
    """doc_id, th (hash of the text), class, component (its least class) of every row.

    Links whose fingerprints differ in more than ``radius`` bits are left out, if it is given.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is more than 0 and at most 1")
    radius = 64 if radius is None else radius
    spark = documents.sparkSession
    common.prepare(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    schema = "doc_id long, th long, class long, size long, need long, fp long, reach long, first array<long>"
    marked = common.stored(rows.mapInArrow(_classes(words_each, similarity, radius), schema), "near-classes")
    some = marked.where("size > 0").select("class", (F.size("first") - F.col("size") + F.col("need")).alias("enough"), "first").dropDuplicates(["class"])
    some = _met(some.select("class", "enough", F.explode("first").alias("key"))).groupBy("class", "enough").count().where("count >= enough")
    # Equal texts have equal classes; one text of each class has its shingles.
    facts = marked.join(some.select("class"), "class", "left_semi").groupBy("class", "size", "need", "fp", "reach").agg(F.min("th").alias("th"))
    facts = common.stored(facts, "near-wanted")
    texts = rows.select("th", "text").join(facts.select("th", "class"), "th").dropDuplicates(["class"]).select("class", "text")
    sets = common.stored(texts.mapInArrow(_sets(words_each), "class long, found array<long>"), "near-sets")
    keyed = _shards(sets, facts.drop("th"))
    # Sets whose sizes differ by more can't be as similar.
    fits = "least(size_a, size_b) >= {} * greatest(size_a, size_b)".format(similarity)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = pairs.where(fits).select("a", "b").distinct()
        both = pairs.join(sets.select(F.col("class").alias("a"), F.col("found").alias("found_a")), "a")
        both = both.join(sets.select(F.col("class").alias("b"), F.col("found").alias("found_b")), "b")
        return common.stored(both.mapInArrow(_near(similarity), "a long, b long"), label)

    at_root = (F.col("class") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least_fp"))) <= min(RADIUS, radius))
    pairs = keyed.where(at_root).select(F.col("least").alias("a"), F.col("class").alias("b"), F.col("least_size").alias("size_a"), F.col("size").alias("size_b"))
    links = verified(pairs, "near-links")
    roots = common.connected_components(links)

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))

    keyed = keyed.select("class", "fp", "reach", "key", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "key")).alias("place"))
    for label, shards in (("near-largest", keyed.where("place = 1")), ("near-rest", keyed)):
        rest = common.stored(rooted(shards.drop("place")), f"{label}-rooted")
        several = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        rest = rest.join(several.select("key"), "key", "left_semi")
        tiles = common.in_tiles(rest, ["key"], F.xxhash64(F.lit(5), "class"), TILE, f"{label}-tiles").join(sets, "class")
        tiles = tiles.select("key", "row", "column", "part", "class", "fp", "reach", "root", "found").repartition("key", "row", "column").sortWithinPartitions("key", "row", "column")
        more = common.stored(tiles.mapInArrow(_compared(similarity), "a long, b long"), label)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = common.connected_components(links)
    by_class = rooted(marked.select("class").distinct()).select("class", F.col("root").alias("component"))
    return marked.select("doc_id", "th", "class").join(common.stored(by_class, "near-components"), "class")
