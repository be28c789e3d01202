"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one class, found by grouping, so copies cost nothing below.
Each tree splits the space again and again at the median of a random
projection, fitted on a bounded sample of the classes; a vector close to a cut
goes to both sides (spill overlap), ``SPILLS`` times on its way through a tree
at most. Deeper trees part more near pairs, so there are more of them
(``trees_of``); a class has at most ``2 ** SPILLS`` leaves a tree. A
node that no sample reaches splits at the sample of the nearest node above.
All classes are indexed. Within a leaf all pairs are compared in blocks, and
those near the threshold by exact cosine in double precision; a leaf of more
than ``BIG`` classes is dealt out in tiles over many tasks. A pair counts in the
first leaf that it shares only, which is worked out again from the forest, so
rows carry a leaf and a vector and nothing else. A leaf returns, for each class,
its links' total and one edge to the least class it reaches there, never the
pairs.

Projections are of vectors rounded to integers, whose sums are exact, so a
vector has the same leaves wherever they are worked out.

Defined results: a vector that is null, zero, empty, or has null or non-finite
components, links with nothing; vectors of different numbers of components
aren't compared, each number has a forest of its own; a row of an equal id and
vector counts as another vector; a null id is never the name of a component
unless all are null; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Classes of a leaf, about, and the depth of a tree at most (its cuts are 1 MB then).
LEAF = 400
DEPTH = 17
#: Width of the band at a cut that goes to both sides, in the projections' standard deviation.
SPILL = 0.15
SPILLS = 2
#: Classes that the trees are fitted on at most (in expectation).
SAMPLE = 20_000
THRESHOLD = 0.95
#: Classes of a leaf that one task compares; the tiles of a larger leaf have as many.
BIG = 8192
#: Rows compared with rows at a time.
TILE = 1024
#: A leaf's number is this times the vectors' components, and more.
DIM = 1 << 40
#: What vectors and directions are multiplied by before they are rounded to integers.
SCALE = 1 << 14


def trees_of(depth: int) -> int:
    """Trees of a depth: 1 of no levels, 3 of up to 5, one more for each level more, 15 of the most."""
    return max(3, depth - 2) if depth else 1


def _placeable(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit * SCALE)


def fit_forest(sample: np.ndarray, depth: int, trees: int, spill: float = SPILL, seed: int = 11):
    """Directions (tree, level, dim) and, by tree, a cut for each inner node and its band's half width.

    Nodes are numbered as in a heap. A node's cut is the median of its part of
    the sample, so cuts follow dense regions.
    """
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, max(depth, 1), sample.shape[1]))
    directions = _placeable(directions / np.linalg.norm(directions, axis=2, keepdims=True))
    sample = _placeable(sample)
    cuts, bands = np.zeros((trees, 1 << depth), np.float32), np.zeros((trees, 1 << depth), np.float32)
    for t in range(trees):
        row, node = np.arange(len(sample)), np.ones(len(sample), np.int64)
        for level in range(depth):
            every = sample @ directions[t, level]
            order = np.lexsort((every[row], node))
            row, node = row[order], node[order]
            p = every[row]
            names, starts, counts = np.unique(node, return_index=True, return_counts=True)
            cuts[t, names] = (p[starts + (counts - 1) // 2] + p[starts + counts // 2]) / 2
            mean = np.add.reduceat(p, starts) / counts
            spread = np.sqrt(np.add.reduceat((p - np.repeat(mean, counts)) ** 2, starts) / counts)
            bands[t, names] = spill * np.where(spread > 0, spread, every.std())
            node = 2 * node + (p > cuts[t, node])
            # A side without sample takes its sibling's.
            bare = np.setdiff1d(np.concatenate((2 * names, 2 * names + 1)), node)
            again = np.flatnonzero(np.isin(node, bare ^ 1))
            row, node = np.concatenate((row, row[again])), np.concatenate((node, node[again] ^ 1))
    return directions, cuts, bands


def leaves_of(unit: np.ndarray, forest, spills: int = SPILLS, trees: range | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree (row numbers, leaves), rows in order; a row has a leaf or more."""
    directions, cuts, bands = forest
    depth = cuts.shape[1].bit_length() - 1
    vectors, found = _placeable(unit), []
    for t in trees or range(len(directions)):
        row, node, left = np.arange(len(vectors)), np.ones(len(vectors), np.int64), np.full(len(vectors), spills)
        projected = vectors @ directions[t].T
        for level in range(depth):
            p = projected[row, level] - cuts[t, node]
            right = p > 0
            both = (np.abs(p) <= bands[t, node]) & (left > 0)
            left = left - both
            row = np.concatenate((row, row[both]))
            node = np.concatenate((2 * node + right, 2 * node[both] + ~right[both]))
            left = np.concatenate((left, left[both]))
        order = np.lexsort((node, row))
        found.append((row[order], node[order]))
    return found


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return _normed(vectors)


def _normed(vectors: np.ndarray) -> np.ndarray:
    """Of length 1. Divided by a power of two near the largest component first, which changes no digit and keeps squares in range."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = np.ldexp(vectors, -np.frexp(largest)[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch):
    """(number of components, rows) of a batch."""
    dims = pc.list_value_length(batch["vector"]).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def _names(unit: np.ndarray, forest, spills: int, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row number, leaf's number) of all leaves, or of those of numbers below ``before``."""
    dim = unit.shape[1]
    trees = range(len(forest[0]) if before is None else (before % DIM >> 32) + 1)
    per_tree = leaves_of(unit, forest, spills, trees)
    rows = np.concatenate([r for r, _ in per_tree])
    names = np.concatenate([dim * DIM + (t << 32) + leaf for t, (_, leaf) in enumerate(per_tree)])
    return (rows, names) if before is None else (rows[names < before], names[names < before])


def _assigned(forests: dict, spills: int):
    def run(batches):
        for dim, batch in (x for batch in batches for x in _by_dim(batch)):
            rows, names = _names(_unit(batch["vector"], dim), forests[dim], spills)
            for i in range(0, len(rows), 5000):
                at = pa.array(rows[i : i + 5000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i : i + 5000]), *(batch[c].take(at) for c in ("rep", "copies", "vector"))],
                    names=["leaf", "rep", "copies", "vector"],
                )

    return run


def _counted(forests: dict, spills: int):
    def run(batches):
        for dim, batch in (x for batch in batches for x in _by_dim(batch)):
            names, counts = np.unique(_names(_unit(batch["vector"], dim), forests[dim], spills)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["leaf", "n"])

    return run


def _near(unit: np.ndarray, single: np.ndarray, rows: slice, columns: slice, threshold: float) -> np.ndarray:
    """Which rows and columns are near: by single precision, and by double where that isn't sure."""
    told = single[rows] @ single[columns].T
    unsure = (unit.shape[1] + 8) * 2.0**-23
    near = told >= threshold
    i, j = np.nonzero(np.abs(told - np.float32(threshold)) <= unsure)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        near[a, b] = np.einsum("ij,ij->i", unit[rows][a], unit[columns][b]) >= threshold
    return near


def compare_leaf(leaf: int, reps, copies, unit: np.ndarray, forest, threshold: float, spills: int = SPILLS, side=None):
    """(rep, links, root) of each class of the leaf that has a link in it.

    Tiles of near pairs are handled as matrices: a pair counts here unless the
    product of the two sides' memberships in earlier leaves says that it has
    met before. With ``side``, booleans by class, only pairs of both sides count.
    """
    n = len(reps)
    labels, links, linked = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    single, known = unit.astype(np.float32), None
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            near = _near(unit, single, slice(i, i + TILE), slice(j, j + TILE), threshold)
            if i == j:
                near = np.triu(near, 1)
            if side is not None:
                near &= side[i : i + TILE, None] != side[None, j : j + TILE]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            if known is None:  # (row, leaf) of all leaves before this one
                row, name = _names(unit, forest, spills, leaf)
                order = np.argsort(row, kind="stable")
                name = np.unique(name[order], return_inverse=True)[1]
                known = name, np.searchsorted(row[order], np.arange(n + 1))
            near = near[np.ix_(rows, columns)]
            rows, columns = rows + i, columns + j
            both = np.unique(np.append(rows, columns))
            starts, ends = known[1][both], known[1][both + 1]
            where = np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(int((ends - starts).sum()))
            before = np.unique(known[0][where], return_inverse=True)[1]
            member = np.zeros((len(both), int(before.max()) + 1 if len(before) else 1), np.float32)
            member[np.repeat(np.arange(len(both)), ends - starts), before] = 1
            met = member[np.searchsorted(both, rows)] @ member[np.searchsorted(both, columns)].T > 0
            new = (near & ~met).astype(np.int64)
            links[rows] += new @ copies[columns]
            links[columns] += new.T @ copies[rows]
            linked[rows] = linked[columns] = True
            a, b = np.nonzero(near)
            common.join_labels(labels, rows[a], columns[b])
    return [(int(reps[i]), int(links[i]), int(reps[labels[i]])) for i in np.flatnonzero(linked).tolist()]


def _compared(forests: dict, threshold: float, spills: int):
    def run(batches):
        for table in common.groups(batches, ["leaf", "row", "column"]):
            table = table.take(pa.array(np.argsort(table["rep"].to_numpy())))
            leaf, row, column = (table[c][0].as_py() for c in ("leaf", "row", "column"))
            dim = leaf // DIM
            side = None if row == column else table["part"].to_numpy() == row
            unit = _unit(table["vector"].combine_chunks(), dim)
            rows = compare_leaf(leaf, table["rep"].to_numpy(), table["copies"].to_numpy(), unit, forests[dim], threshold, spills, side)
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["rep", "links", "root"])

    return run


def near_duplicates(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    trees: int | None = None, leaf_size: int = LEAF, spill: float = SPILL, spills: int = SPILLS, sample: int = SAMPLE, big: int = BIG,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = embeddings.sparkSession
    common.prepare(spark)
    raw = F.col(vector_col)
    sound = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(raw, lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # A row finds its class by two hashes of the vector, 128 bits in all; a class has a number of its own.
    marks = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")}
    grouped = rows.where("sound").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = common.stored(grouped.withColumns(marks).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    forests = {}
    for dim, n in classes.groupBy(F.size("vector")).count().collect():
        depth = min(DEPTH, max(0, math.ceil(math.log2(n / leaf_size))))
        fitted = np.zeros((1, dim))
        if depth:
            rate = min(1.0, sample / n)
            picked = classes.where((F.size("vector") == dim) & (F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1 << 30)) < int(rate * (1 << 30))))
            fitted = np.array([r["vector"] for r in picked.orderBy("h1", "h2").select("vector").collect()], np.float64).reshape(-1, dim)
            if not len(fitted):
                depth, fitted = 0, np.zeros((1, dim))
            else:
                fitted = _normed(fitted)
        forests[dim] = fit_forest(fitted, depth, trees or trees_of(depth), spill)

    kind = classes.schema["vector"].dataType.simpleString()
    placed = classes.select("rep", "copies", "vector").mapInArrow(_assigned(forests, spills), f"leaf long, rep long, copies long, vector {kind}")
    # Leaves of very many classes are dealt out in tiles of two parts each.
    counts = classes.select("vector").mapInArrow(_counted(forests, spills), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    large = common.stored(counts.where(F.col("n") > big), "large-leaves")
    placed = common.in_tiles(placed, ["leaf"], F.xxhash64(F.lit(5), "rep"), big, "", (large, large.count()))
    placed = placed.repartition("leaf", "row", "column").sortWithinPartitions("leaf", "row", "column")
    found = common.stored(placed.mapInArrow(_compared(forests, threshold, spills), "rep long, links long, root long"), "leaf-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = common.connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("rep", "copies", "first_id", "h1", "h2").join(totals, "rep", "left")
    named = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select(
        "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = common.stored(named, "vector-links")
    keyed = rows.withColumns(marks).select("vec_id", "sound", "h1", "h2")
    out = keyed.where("sound").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.source(spark, sf_dir, "embeddings"))
