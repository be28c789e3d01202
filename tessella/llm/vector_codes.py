"""Vectors as short codes: product quantisation with codebooks fitted by Yinyang Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part's
place has a codebook. A round assigns every part to its nearest entry and moves
entries to the floored mean of their parts. Entries are clustered into groups;
for each part a row keeps one lower bound a group, of the distance to the
group's entries other than the part's own. A round lowers a bound by the
farthest that an entry of its group has moved, and only groups whose bound falls
below the distance to the part's own entry are scanned. Bounds are floating and
err on the low side; what is scanned is compared by integer squared distances,
ties to the lower index, so the codes are those of plain rounds.

All rows take part in all rounds. A round is one pass: tasks assign their rows,
write codes and bounds next to the integers, and give sums and counts by entry,
which Spark adds up; the driver holds the codebooks only. The last round's table
is removed when the next one is whole.

Defined results: a vector that is null, or has null or non-finite components,
or some of 2^50 or more in size (no 64-bit integer holds them), has no row; the
number of components is that of the smallest id's vector whose number divides
into parts; vectors of other numbers have a null code and error; a null id sorts
last among ids, ties by the vector; rows equal in everything count on their own;
an error or sum of errors past 64 bits is null; with fewer vectors than entries
the codebooks are shorter; an empty table gives no rows; other columns than the
label are left aside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Groups that a codebook's entries are clustered into.
GROUPS = 4
#: Components from which a vector is no longer taken.
LARGEST = 2.0**50
#: Integers up to which squared distances of ``MOST_DIMS`` components keep within 63 bits.
SAFE = 1 << 27
MOST_DIMS = 128


def groups_of(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """For each entry its group: by a few rounds of its own, from entries far from each other."""
    points = book.astype(np.float64)
    picked = [0]
    for _ in range(min(groups, len(points)) - 1):
        far = ((points[:, None] - points[None, picked]) ** 2).sum(-1).min(1)
        picked.append(int(far.argmax()))
    centres = points[picked]
    for _ in range(rounds):
        group = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([points[group == g].mean(0) if (group == g).any() else centres[g] for g in range(len(centres))])
    return group


def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows and entries, of any size."""
    if x.dtype != object and max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) >= SAFE or x.shape[1] > MOST_DIMS:
        x, book = x.astype(object), book.astype(object)
    return ((x[:, None] - book[None]) ** 2).sum(-1)


def _below(d2: np.ndarray) -> np.ndarray:
    """The roots, not above them."""
    return np.sqrt(d2.astype(np.float64)) * (1 - 1e-12)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, code=None, bounds=None, moved=None):
    """(codes, bounds by group, integer squared distances, entries looked at) of parts.

    ``code`` and ``bounds`` are those of the round before, and ``moved`` is how
    far each entry has gone since, not below it; without them all are scanned.
    """
    n, names = len(x), np.arange(int(group.max()) + 1)
    if code is None:
        d2 = _squared(x, book)
        code = d2.argmin(1)  # the first of equal ones
        best = d2[np.arange(n), code]
        others = np.where(np.arange(len(book))[None] == code[:, None], np.inf, _below(d2))
        bounds = np.stack([others[:, group == g].min(1, initial=np.inf) for g in names], 1)
        return code, bounds, best, d2.size
    bounds = np.maximum(bounds - np.array([moved[group == g].max(initial=0) for g in names])[None], 0)
    was, best, looked = code, np.zeros(n, object if x.dtype == object else np.int64), n
    for k in np.unique(code):
        at = np.flatnonzero(code == k)
        d2 = _squared(x[at], book[k : k + 1])[:, 0]
        if d2.dtype == object:
            best = best.astype(object)
        best[at] = d2
    own, code = best.copy(), code.copy()
    above = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    bounds = bounds.copy()
    for g in names:
        at = np.flatnonzero(bounds[:, g] <= above)
        if not len(at):
            continue
        entries = np.flatnonzero(group == g)
        d2 = _squared(x[at], book[entries])
        looked += d2.size
        if d2.dtype == object:
            best = best.astype(object)
        first = d2.argmin(1)
        least = d2[np.arange(len(at)), first]
        closer = (least < best[at]) | (least == best[at]) & (entries[first] < code[at])
        code[at[closer]], best[at[closer]] = entries[first[closer]], least[closer]
        # Of the entries other than the one that the part had.
        bounds[at, g] = np.where(entries[None] == was[at, None], np.inf, _below(d2)).min(1)
    # The entry that a part has left counts in its group, and the new one no longer does.
    left = np.flatnonzero(code != was)
    np.minimum.at(bounds, (left, group[was[left]]), _below(own[left]))
    for g in np.unique(group[code[left]]):
        at = left[group[code[left]] == g]
        entries = np.flatnonzero(group == g)
        d2 = _below(_squared(x[at], book[entries]))
        bounds[at, g] = np.where(entries[None] == code[at, None], np.inf, d2).min(1)
        looked += d2.size
    return code, bounds, best, looked


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    raw = b"".join(batch["ints"].to_pylist())
    return np.frombuffer(raw, np.int64).reshape(-1, dims)


def _floored(scale: int):
    """The vectors' components as integers, in bytes."""

    def run(batches):
        for batch in batches:
            flat = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ints = np.floor(scale * flat).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(batch["vector"]).to_numpy())))
            rows = [ints[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(rows, pa.binary())], names=["vec_id", "label", "ints"])

    return run


def _round(books: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None, last: bool):
    """Codes and bounds of every row; in the last pass codes and errors."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, parts * width).reshape(len(batch), parts, width)
            codes, bounds, errors = [], [], []
            if moved is not None:
                before = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                kept = np.frombuffer(b"".join(batch["bounds"].to_pylist()), np.float64).reshape(len(batch), -1)
                at = np.concatenate(([0], np.cumsum([int(g.max()) + 1 for g in groups])))
            for p in range(parts):
                old = (None,) * 3 if moved is None else (before[:, p], kept[:, at[p] : at[p + 1]], moved[p])
                code, bound, best, _ = assign(x[:, p], books[p], groups[p], *old)
                codes.append(code)
                bounds.append(bound)
                errors.append(best.astype(object))
            codes = np.stack(codes, 1)
            if last:
                total = [e if e < 1 << 63 else None for e in sum(errors).tolist()]
                said = [row.astype(np.uint8).tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(said, pa.string()), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                rows = [pa.array([r.tobytes() for r in own], pa.binary()) for own in (codes.astype(np.uint8), np.concatenate(bounds, 1))]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["ints"], *rows], names=["vec_id", "label", "ints", "code", "bounds"])

    return run


def _summed(parts: int, width: int, entries: int):
    """(slot, n, sums as text): by part and entry, the parts' number and componentwise sums of a task's rows."""

    def run(batches):
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, parts * width).reshape(-1, width)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            slot = (code + entries * np.arange(parts)[None]).ravel()
            n += np.bincount(slot, minlength=parts * entries)
            order = np.argsort(slot, kind="stable")
            names, starts = np.unique(slot[order], return_index=True)
            # Halves of the numbers add up within 63 bits for any batch.
            high, low = x >> 24, x & (1 << 24) - 1
            for half, unit in ((high, 1 << 24), (low, 1)):
                sums[names] += np.add.reduceat(half[order], starts, axis=0).astype(object) * unit
        for at in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([int(n[at])]), pa.array([list(map(str, sums[at]))])], names=["slot", "n", "sums"])

    return run


def fit(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after the rounds, and vec_id, label, code, error of every row of (vec_id, label, ints)."""
    spark, (parts, entries, width) = rows.sparkSession, books.shape
    groups, moved, state = [groups_of(book) for book in books], None, rows
    for k in range(rounds):
        step = _round(books, groups, moved, last=False)
        after = common.stored(state.mapInArrow(step, "vec_id long, label string, ints binary, code binary, bounds binary"), f"codes-{k}")
        if k:
            common.discard(state)
        state = after
        told = state.select("ints", "code").mapInArrow(_summed(parts, width, entries), "slot long, n long, sums array<string>")
        told = told.select("slot", "n", F.posexplode("sums").alias("i", "v"))
        # parts x entries x width rows, whatever the input.
        told = told.groupBy("slot", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        new = books.copy()
        for r in told:
            new[r["slot"] // entries, r["slot"] % entries, r["i"]] = int(r["v"]) // r["n"]
        gone = (new.astype(object) - books.astype(object)) ** 2
        moved, books = np.sqrt(gone.sum(-1).astype(np.float64)) * (1 + 1e-12), new
    done = state.mapInArrow(_round(books, groups, moved, last=True), "vec_id long, label string, code string, error long")
    return books, done


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """Add the sum of the errors of each label, nulls together."""
    rows = common.stored(rows.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    told = common.stored(rows.groupBy("key").agg(total.alias("t"), F.count("*").alias("n")), "label-errors")
    told = told.select("key", F.expr("try_cast(t as bigint)").alias("label_error"), "n")
    hot = told.where(F.col("n") > common.HUB).select("key", F.col("label_error").alias("hot_error"), F.lit(True).alias("hot"))
    if told.count() <= common.BROADCAST_GROUPS:
        return rows.join(F.broadcast(told), "key")
    marked = rows.join(F.broadcast(hot) if hot.count() <= common.BROADCAST_GROUPS else hot, "key", "left")
    near = marked.where("hot").select(*rows.columns, F.col("hot_error").alias("label_error"))
    rest = marked.where("hot is null").select(*rows.columns).join(told, "key").select(*rows.columns, "label_error")
    return near.unionByName(rest)


def vector_codes(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits, so codebooks have 1 to 256 entries")
    spark = embeddings.sparkSession
    common.prepare(spark)
    vector = F.col(vector_col)
    sound = F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False))), F.lit(False))
    named = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector")).where(sound)
    size = F.size("vector")
    order = (F.asc_nulls_last("vec_id"), "vector")
    first = named.where((size > 0) & (size % parts == 0)).orderBy(*order).limit(1).select(size.alias("n")).collect()
    none = F.lit(None)
    if not first:
        books, coded, other = np.zeros((parts, 0, 0), np.int64), None, named
    else:
        dims = first[0]["n"]
        taken = named.where(size == dims)
        starts = taken.orderBy(*order).limit(entries).select("vector").collect()
        ints = np.floor(scale * np.array([r["vector"] for r in starts], np.float64)).astype(np.int64)
        books = np.ascontiguousarray(ints.reshape(len(ints), parts, dims // parts).swapaxes(0, 1))
        rows = taken.mapInArrow(_floored(scale), "vec_id long, label string, ints binary")
        books, coded = fit(rows, books, rounds)
        other = named.where(size != dims)
    other = other.select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    rows = _with_label_errors(other if coded is None else coded.unionByName(other))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(common.source(spark, sf_dir, "embeddings"))
