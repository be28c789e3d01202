"""Near-duplicates by SimHash fingerprints and Burkhard-Keller trees.

A fingerprint has 64 bits; a bit is set where it is set in over half of the
XXH64 hashes of a text's word shingles. Distinct fingerprints at most
``radius`` bits apart are linked.

The trees are built by shard. With at most ``radius`` = 3 differing bits one of
four 16-bit bands agrees, so a fingerprint goes to four shards, each named by a
band's leading bits: as many of them as make shards of about ``SHARD``
fingerprints, so trees stay as large, and the share of them that a search visits
as small, at any size of the corpus. A crowded shard is named anew by the whole
band and one of four 12-bit parts of the other 48 bits, one of which agrees too;
what is crowded even then is searched part by part, each part's tree by each
part. A tree keys children by their integer Hamming distance to the parent, and
a search follows only edges that the triangle inequality allows; both work on a
whole level of the tree at a time. The shards are dealt out to tasks instead of
being broadcast: all trees together grow with the corpus, so a broadcast of them
has no bound. A shard returns, for each fingerprint, one link to the least one
it reaches there, so copies are never expanded into pairs.

Defined results: a null text or one without words has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle; equal rows have
equal fingerprints and one component; a null id belongs to a component but
doesn't name one, unless all its ids are null; an empty table gives no rows;
other columns are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Fingerprints of a shard, about, and those that a task's tree has at most.
SHARD = 512
CROWDED = 8192
#: Fingerprints that search a tree at a time.
QUERIES = 256
#: A node's edges are numbered from this times its number.
_EDGES = 65


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """The XXH64 hash of each shingle of UTF-8 bytes; none without words."""
    words = text.lower().split()  # both know ASCII letters and blanks only, as the rule asks
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - words_each + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[words_each - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The fingerprint of UTF-8 bytes, as a signed 64-bit integer."""
    return fingerprint_of(shingle_hashes(text, words_each))


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that are set in over half of ``n`` hashes, as a signed 64-bit integer."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes, as a signed 64-bit integer."""
    return majority(ones_of(hashes), len(hashes))


def _fingerprints(words_each: int):
    def run(batches):
        for batch in batches:
            data, at = common.utf8(batch["text"])
            data = data.tobytes()
            got = [fingerprint(data[a:b], words_each) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(got, pa.int64())], names=["doc_id", "th", "fp"])

    return run


class BKTree:
    """Distinct values as nodes, children keyed by their Hamming distance to the parent.

    It is the tree that inserting the values in their order makes, built level by
    level: of the values that wait at a node with one distance to it the first is
    the child there, and the others go on to it. ``slots`` are the edges, parent
    and distance in one number, in rising order, and ``kids`` their children.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.visited = values, 0
        slots, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        waiting = np.arange(1, len(values))
        at = np.zeros(len(waiting), np.int64)
        while len(waiting):
            slot = at * _EDGES + np.bitwise_count(values[waiting] ^ values[at])
            names, first = np.unique(slot, return_index=True)
            slots.append(names)
            kids.append(waiting[first])
            on = np.ones(len(waiting), bool)
            on[first] = False
            waiting, at = waiting[on], waiting[first][np.searchsorted(names, slot[on])]
        slots, kids = np.concatenate(slots), np.concatenate(kids)
        order = np.argsort(slots)
        self.slots, self.kids = slots[order], kids[order]

    def near(self, queries: np.ndarray, radius: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all values at most ``radius`` away from the queries, or each query's own."""
        radius = np.broadcast_to(radius, len(queries))
        found_q, found_n = [], []
        q = np.arange(len(queries) if len(self.values) else 0)
        node = np.zeros(len(q), np.int64)
        while len(q):
            self.visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            r = radius[q]
            hit = d <= r
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.slots, node * _EDGES + np.maximum(d - r, 0))
            n = np.searchsorted(self.slots, node * _EDGES + np.minimum(d + r, 64), side="right") - low
            q = np.repeat(q, n)
            node = self.kids[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(q))]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_n))


def shard_links(values: np.ndarray, searching: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], int]:
    """(value, least value it reaches inside the shard) of all that reach another, and the nodes visited.

    ``values`` (unsigned) are the tree's, and ``searching`` those that search it.
    """
    tree = BKTree(values)
    every = np.unique(np.concatenate((values, searching)))
    label = np.arange(len(every))
    places, asking = np.searchsorted(every, values), np.searchsorted(every, searching)
    for i in range(0, len(searching), QUERIES):
        q, node = tree.near(searching[i : i + QUERIES], radius)
        common.join_labels(label, asking[i + q], places[node])
    moved = np.flatnonzero(label != np.arange(len(every)))
    return list(zip(every[moved].tolist(), every[label[moved]].tolist(), strict=True)), tree.visited


def _links(radius: int):
    def run(batches):
        for group in common.groups(batches, ["key", "row", "column"]):
            values = group["fp"].to_numpy().view(np.uint64)
            own = group["part"].to_numpy() == group["row"][0].as_py()
            if len(values) < 2:
                continue
            apart = group["row"][0].as_py() != group["column"][0].as_py()
            found, _ = shard_links(values[own], values[~own] if apart else values, radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _bits(fp, first: int, n: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def _wide_keys(fp, bits: int) -> list:
    """The shards of a fingerprint, named by a band and ``bits`` of it; one if there is one shard only."""
    return [F.lit(band << 16).bitwiseOR(_bits(fp, 16 * band + 16 - bits, bits)) if bits else F.lit(0).cast("long") for band in range(4 if bits else 1)]


def _narrow_keys(fp, bits: int) -> list:
    """For each wide key, the four shards named by its band and a part of the rest; all 16 where one shard is all."""
    found = []
    for band in range(4):
        joined = F.lit(0).cast("long")
        for i, b in enumerate(x for x in range(4) if x != band):
            joined = joined.bitwiseOR(F.shiftleft(_bits(fp, 16 * b, 16), 16 * i))
        own = []
        for part in range(4):
            name = F.lit((1 << 40) | (4 * band + part) << 28).bitwiseOR(F.shiftleft(_bits(fp, 16 * band, 16), 12))
            own.append(name.bitwiseOR(_bits(joined, 12 * part, 12)))
        found.append(own)
    return [F.array(*x) for x in found] if bits else [F.array(*sum(found, []))]


def _sharded(classes: DataFrame, shard: int, crowded: int) -> DataFrame:
    """fp, key, part, row, column: all fingerprints that search a tree, or are in it, with each other."""
    n = classes.count()
    bits = min(16, max(0, (n // max(shard, 1)).bit_length()))
    fp = F.col("fp")
    keys = F.array(*[F.struct(wide.alias("key"), narrow.alias("narrow")) for wide, narrow in zip(_wide_keys(fp, bits), _narrow_keys(fp, bits), strict=True)])
    keyed = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.key", "k.narrow")
    full, n_full = common.large_groups(keyed, ["key"], crowded, "crowded-shards")
    if not n_full:
        return keyed.select("fp", "key", *[F.lit(0).alias(c) for c in ("part", "row", "column")])
    full = full.select("key")
    full = F.broadcast(full) if n_full <= common.BROADCAST_GROUPS else full
    narrow = keyed.join(full, "key").select("fp", F.explode("narrow").alias("key"))
    keyed = keyed.join(full, "key", "left_anti").select("fp", "key").unionByName(narrow)
    return common.in_tiles(keyed, ["key"], F.xxhash64(F.lit(5), "fp"), crowded, "crowded-parts")


def simhash_components(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 3,
    shard: int = SHARD, crowded: int = CROWDED,
) -> DataFrame:
    """doc_id, th (hash of the text), fp (signed long), component (a fingerprint), component_id of every row."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards hold all links of at most 3 bits")
    spark = documents.sparkSession
    common.prepare(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    marked = common.stored(rows.mapInArrow(_fingerprints(words_each), "doc_id long, th long, fp long"), "fingerprints")
    classes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-classes")
    shards = _sharded(classes, shard, crowded).repartition("key", "row", "column").sortWithinPartitions("key", "row", "column", "fp")
    roots = common.connected_components(shards.mapInArrow(_links(radius), "a long, b long"))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = common.stored(named.select("fp", "root").join(least, "root"), "fp-components")
    return marked.join(by_fp, "fp").select("doc_id", "th", "fp", F.col("root").alias("component"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(common.source(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
