"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a smaller document id, or further up in the same text. Sorting the suffixes
of a whole corpus isn't needed for that, only of places that may repeat:

1. Every string of ``length`` bytes has an anchor, its 32-byte gram of the
   least hash; equal strings have equal anchors at equal places. Strings in a
   row with one anchor make a context of at most 2 * length - 32 bytes.
2. Anchors are dealt out by hash. Of equal contexts all but the first go.
   Anchors with one context are done; those with several are candidates.
3. The candidates' suffixes are sorted: multikey quicksort, eight bytes at a
   time, to a shallow depth; groups that still agree are long common prefixes,
   and a blind trie (Patricia) orders each of them and finds suffixes that
   agree over the full length. Of those all but the first go. Contexts of an
   anchor with more than ``COMMON_ANCHOR`` of them are dealt out window by
   window, by a hash of the window, after each task has kept the first of equal
   ones.

Equal contexts are told by 128 bits of hash, 64 of the anchor and 64 of the
context; suffixes byte by byte. Each task first drops all but the first of the
equal contexts that it meets, so that a passage costs a row a task. Buckets of
anchors hold the contexts of ``BUCKET_BYTES`` of text, and a task passes on the
contexts of an anchor that fills one as they come.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; matches don't cross documents; rows equal in id and text are one
document, each with its result, and documents that share an id are ordered by a
hash of the text; null ids sort first; an empty table gives no rows; other
columns are left aside. Removed bytes may cut a character, so what is kept is
binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 32
#: Bytes that are hashed at a time, and contexts that a task holds before it passes them on.
BYTES_AT_ONCE = 1 << 19
HELD = 1_000_000
#: Suffixes sorted at a time, and the depth of the shallow sort in 8-byte words.
SUFFIXES_AT_ONCE = 200_000
SHALLOW = 4
#: An anchor with more contexts than this is dealt out window by window.
COMMON_ANCHOR = 2_000
#: Bytes of text whose contexts make a bucket.
BUCKET_BYTES = 16 << 20

_PLACE = 20  # bits of a place in a buffer of BYTES_AT_ONCE


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice the size."""
    out = h[:-size] * np.uint64(0xD6E8FEB86659FD93)
    out += h[size:]
    return _mixed(out)


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def contexts(data: np.ndarray, length: int = LENGTH):
    """Runs of strings with one anchor: (first start, last start, anchor's hash, context's hash).

    ``data`` is one text, or a part that overlaps the next by length - 1 bytes.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h = _BYTE[data]
    for size in (1, 2, 4, 8, 16):
        h = _doubled(h, size)
    gram, half = h, _doubled(h, 32)  # of 32 and of 64 bytes
    # The least gram of each string: its hash above, its place below, so the first of equals wins.
    least = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(gram), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [n])) - 1
    at = anchor[first]
    far = length - 64
    told = (last - first).astype(np.uint64) << np.uint64(32) | (at - first).astype(np.uint64)
    for part in (half[first], half[first + far], half[last], half[last + far]):
        told = _mixed(told * np.uint64(0xD6E8FEB86659FD93) + part)
    return first, last, gram[at], told


def merged(group: list[np.ndarray], start: np.ndarray, end: np.ndarray):
    """Intervals [start, end) of equal ``group`` columns, joined where they meet; returns (rows, start, end)."""
    if not len(start):
        return np.zeros(0, np.int64), start, end
    order = np.lexsort((start, *group[::-1]))
    s, e = start[order], end[order]
    new = np.ones(len(s), bool)
    same = np.ones(len(s) - 1, bool)
    for g in group:
        same &= g[order][1:] == g[order][:-1]
    # The furthest end so far in the group: a running maximum over group number and end.
    number = np.concatenate(([0], np.cumsum(~same)))
    span = int(e.max()) + 1
    furthest = np.maximum.accumulate(number * span + e) - number * span
    new[1:] = ~same | (s[1:] > furthest[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(s)) - 1
    return order[heads], s[heads], furthest[tails]


_BLOB = "bucket int, kind int, akey binary, ctx binary, key binary, th binary, s binary, e binary"
_NAMES = ("akey", "ctx", "key", "th", "s", "e")
_KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)


def _blobs(rows: list[tuple[int, int, dict]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    for name, kind in zip(_NAMES, _KINDS, strict=True):
        columns.append(pa.array([r[2][name].astype(kind).tobytes() if name in r[2] else b"" for r in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", *_NAMES])


def _keep_first(x: dict) -> tuple[dict, dict]:
    """Of equal contexts the first; and the strings of the others as intervals."""
    order = np.argsort(x["ctx"], kind="stable")
    c = x["ctx"][order]
    same = c[1:] == c[:-1]
    several = np.zeros(len(c), bool)
    several[1:] |= same
    several[:-1] |= same
    some = order[several]
    some = some[np.lexsort((x["s"][some], x["th"][some], x["key"][some], x["akey"][some], x["ctx"][some]))]
    new = np.ones(len(some), bool)
    new[1:] = (x["ctx"][some][1:] != x["ctx"][some][:-1]) | (x["akey"][some][1:] != x["akey"][some][:-1])
    head = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    # Repeated rows have the same places; those are no later ones.
    same_place = (x["key"][some] == x["key"][head]) & (x["th"][some] == x["th"][head]) & (x["s"][some] == x["s"][head])
    later, again = some[~new & ~same_place], some[~new & same_place]
    stay = np.ones(len(c), bool)
    stay[later] = stay[again] = False
    gone = {k: x[k][later] for k in ("key", "th", "s", "e")}
    return {k: v[stay] for k, v in x.items()}, gone


def _joined_gone(gone: dict, length: int) -> dict:
    rows, s, e = merged([gone["key"], gone["th"]], gone["s"].astype(np.int64), gone["e"].astype(np.int64) + length)
    return {"key": gone["key"][rows], "th": gone["th"][rows], "s": s, "e": e}


def _map_contexts(length: int, buckets: int):
    def flush(parts):
        x = {k: np.concatenate([p[k] for p in parts]) for k in _NAMES}
        x, gone = _keep_first(x)
        bucket = (x["akey"] >> np.uint64(16)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        rows = [(int(b), 0, {k: v[own] for k, v in x.items()}) for b, own in zip(used, np.split(order, starts[1:]), strict=True)]
        gone = _joined_gone(gone, length)
        for i in range(0, len(gone["s"]), 20_000):
            some = {k: v[i : i + 20_000] for k, v in gone.items()}
            rows.append((int(some["key"][0]) % buckets, 1, some))
        for i in range(0, len(rows), 256):
            yield _blobs(rows[i : i + 256])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, at = common.utf8(batch["text"])
            keys, th = common.ids64(batch["key"]), common.ids64(batch["th"])
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for p in range(a, b - length + 1, BYTES_AT_ONCE - length + 1):
                    first, last, akey, ctx = contexts(data[p : min(b, p + BYTES_AT_ONCE)], length)
                    n = len(first)
                    parts.append({"akey": akey, "ctx": ctx, "key": np.full(n, keys[i]), "th": np.full(n, th[i]), "s": (first + (p - a)).astype(np.int32), "e": (last + (p - a)).astype(np.int32)})
                    held += n
                if held >= HELD:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


_FOUND = "kind int, akey long, key long, th long, s int, e int"


def _found(kind: int, x: dict):
    n = len(x["s"])
    akey = x["akey"].astype(np.uint64).view(np.int64) if "akey" in x else np.zeros(n, np.int64)
    for i in range(0, n, 50_000):
        part = slice(i, i + 50_000)
        m = len(x["s"][part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), pa.array(akey[part]), pa.array(x["key"][part]), pa.array(x["th"][part]), pa.array(x["s"][part].astype(np.int32)), pa.array(x["e"][part].astype(np.int32))],
            names=["kind", "akey", "key", "th", "s", "e"],
        )


def _with_others(akey: np.ndarray) -> np.ndarray:
    """The places, sorted by anchor, of those whose anchor has others."""
    order = np.argsort(akey, kind="stable")
    same = akey[order][1:] == akey[order][:-1]
    several = np.zeros(len(akey), bool)
    several[1:] |= same
    several[:-1] |= same
    return order[several]


def _reduce_contexts(length: int, common_anchor: int, most: int = HELD):
    """Per bucket: kind 1, intervals that go; kind 0, contexts whose anchor has others."""

    class Bucket:
        def __init__(self) -> None:
            self.parts: list[dict] = []
            self.held, self.limit, self.full = 0, most, np.zeros(0, np.uint64)

        def add(self, x: dict):
            self.parts.append(x)
            self.held += len(x["s"])
            if self.held >= self.limit:
                yield from self.settle()
                self.limit = self.held + most

        def settle(self, last: bool = False):
            """Of equal contexts all but the first go; anchors that fill the bucket are passed on, in the end all are."""
            if not self.parts:
                return
            x = {k: np.concatenate([p[k] for p in self.parts]) for k in _NAMES}
            if last:
                some = np.union1d(_with_others(x["akey"]), np.flatnonzero(np.isin(x["akey"], self.full)))
                x = {k: v[some] for k, v in x.items()}
            x, gone = _keep_first(x)
            yield from _found(1, _joined_gone(gone, length))
            if last:
                on = np.zeros(len(x["s"]), bool)
                on[_with_others(x["akey"])] = True
            else:
                names, counts = np.unique(x["akey"], return_counts=True)
                self.full = np.union1d(self.full, names[counts > common_anchor])
                on = np.zeros(len(x["s"]), bool)
            on |= np.isin(x["akey"], self.full)
            yield from _found(0, {k: v[on] for k, v in x.items()})
            self.parts = [{k: v[~on] for k, v in x.items()}]
            self.held = int((~on).sum())

    def run(batches):
        now, bucket = None, Bucket()
        for batch in batches:
            for i, b in enumerate(batch["bucket"].to_pylist()):
                if b != now:
                    yield from bucket.settle(last=True)
                    now, bucket = b, Bucket()
                x = {k: np.frombuffer(batch[k][i].as_buffer(), kind) for k, kind in zip(_NAMES, _KINDS, strict=True)}
                if batch["kind"][i].as_py():
                    yield from _found(1, {k: x[k] for k in ("key", "th", "s", "e")})
                else:
                    yield from bucket.add(x)
        yield from bucket.settle(last=True)

    return run


_CUT = "akey long, key long, th long, s int, e int, bytes binary"


def _cut_contexts(length: int):
    """The bytes of each candidate context; those of very common anchors window by window.

    Windows of a common anchor are dealt out by a hash of their bytes. Of equal
    ones a task passes on the first only; the others go for certain, and come
    out as intervals [s, e) without bytes.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ("akey", "key", "th", "s", "e", "bytes")

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    def split(hot: list[tuple]):
        """Single windows of (akey, key, th, s, text), the first of each kind."""
        texts = [x[4] for x in hot]
        sizes = np.array([len(t) for t in texts])
        counts = sizes - length + 1
        context = np.repeat(np.arange(len(hot)), counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[context] + inside
        whole = b"".join(texts)
        later, again = set(), set()  # equal windows at later places, and at the same place in a repeated row
        for run in equal_suffixes(np.frombuffer(whole, np.uint8), starts, length):
            place = [(hot[context[i]][1:3], hot[context[i]][3] + inside[i]) for i in run]
            first = min(place)
            keep = run[place.index(first)]
            later |= {i for i, p in zip(run, place, strict=True) if p != first}
            again |= {i for i, p in zip(run, place, strict=True) if p == first and i != keep}
        out = []
        for i, (c, k, at) in enumerate(zip(context.tolist(), inside.tolist(), starts.tolist(), strict=True)):
            akey, key, th, start, _ = hot[c]
            if i in later:
                out.append((key, key, th, start + k, start + k + length, b""))
            elif i not in again:
                window = whole[at : at + length]
                out.append((xxhash.xxh64_intdigest(window, akey & 0xFFFF) - (1 << 63), key, th, start + k, start + k, window))
        for i in range(0, len(out), 20_000):
            yield rows_of(out[i : i + 20_000])

    def run(batches):
        hot: list[tuple] = []
        windows = 0
        for batch in batches:
            rows: list[tuple] = []
            data, at = common.utf8(batch["text"])
            data = data.tobytes()
            for a, key, th, found in zip(at[:-1].tolist(), batch["key"].to_pylist(), batch["th"].to_pylist(), batch["found"].to_pylist(), strict=True):
                for c in found:
                    text = data[a + c["s"] : a + c["e"] + length]
                    if c["common"]:
                        hot.append((c["akey"], key, th, c["s"], text))
                        windows += len(text) - length + 1
                    else:
                        rows.append((c["akey"], key, th, c["s"], c["e"], text))
            yield rows_of(rows)
            if windows >= SUFFIXES_AT_ONCE:
                yield from split(hot)
                hot, windows = [], 0
        if hot:
            yield from split(hot)

    return run


class BlindTrie:
    """Orders strings of one length that share a long prefix.

    An inner node knows the depth at which its strings part and its children by
    their byte there; the bytes between are skipped and checked once, against
    the leaf that a descent ends in.
    """

    def __init__(self) -> None:
        self.root = None

    def add(self, text: bytes, number: int) -> None:
        if self.root is None:
            self.root = (text, [number])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        leaf, numbers = node
        if leaf == text:
            numbers.append(number)
            return
        apart = int.from_bytes(text) ^ int.from_bytes(leaf)
        depth = len(text) - (apart.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = (text, [number])
            return
        new = [depth, {leaf[depth]: node, text[depth]: (text, [number])}]
        if above is None:
            self.root = new
        else:
            above[1][text[above[0]]] = new

    def runs(self):
        """The numbers of equal strings, in the strings' order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def multikey_sorted(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Multikey quicksort of the rows of ``words``: their order, and the ranges in it of rows that agree in all words.

    A segment of rows that agree so far is parted three ways by its pivot's next
    word; the middle part goes on to the word after. All segments take a step at
    a time.
    """
    n, depth = words.shape
    order, whole = np.arange(n), []
    starts, ends, deep = (np.array(x, np.int64) for x in ([0], [n], [0]))
    while True:
        done = deep == depth
        whole += list(zip(starts[done].tolist(), ends[done].tolist(), strict=True))
        on = ~done & (ends - starts > 1)
        starts, ends, deep = starts[on], ends[on], deep[on]
        if not len(starts):
            return order, [x for x in sorted(whole) if x[1] - x[0] > 1]
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(segment)) + (starts - first)[segment]
        word = words[order[place], deep[segment]]
        pivot = word[first + sizes // 2][segment]
        side = 3 * segment + 1 + (word > pivot) - (word < pivot)
        by = np.argsort(side, kind="stable")
        order[place] = order[place][by]
        side = side[by]
        cuts = np.flatnonzero(np.diff(side)) + 1
        heads = np.concatenate(([0], cuts))
        starts, ends = place[heads], place[np.append(cuts, len(side)) - 1] + 1
        deep = deep[side[heads] // 3] + (side[heads] % 3 == 1)


def equal_suffixes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Groups, of two or more, of ``starts`` whose next ``length`` bytes are equal, in the order of the bytes."""
    if not len(starts):
        return []
    data = np.concatenate((data, np.zeros(8 * SHALLOW, np.uint8)))
    words = np.empty((len(starts), min(SHALLOW, length // 8)), np.uint64)
    for k in range(words.shape[1]):
        words[:, k] = np.ascontiguousarray(data[starts[:, None] + (8 * k + np.arange(8))]).view(">u8")[:, 0]
    order, agree = multikey_sorted(words)
    whole, found = data.tobytes(), []
    for a, b in agree:
        trie = BlindTrie()
        for i in order[a:b].tolist():
            trie.add(whole[starts[i] : starts[i] + length], i)
        found += [run for run in trie.runs() if len(run) > 1]
    return found


def _sort_candidates(length: int):
    def settle(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        data, at = common.utf8(table["bytes"].combine_chunks())
        base = at[0]
        data, at = data[base : at[-1]], at - base
        counts = np.diff(at) - length + 1
        context = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        key, th = table["key"].to_numpy()[context], table["th"].to_numpy()[context]
        place = table["s"].to_numpy()[context] + inside
        gone: list[int] = []
        for run in equal_suffixes(data, at[:-1][context] + inside, length):
            first = min(run, key=lambda i: (key[i], th[i], place[i]))
            mark = (key[first], th[first], place[first])
            gone += [i for i in run if (key[i], th[i], place[i]) != mark]
        i = np.array(gone, np.int64)
        rows_, s, e = merged([key[i], th[i]], place[i].astype(np.int64), place[i].astype(np.int64) + length)
        return _found(1, {"key": key[i][rows_], "th": th[i][rows_], "s": s, "e": e})

    def run(batches):
        held, suffixes, last = [], 0, None
        for batch in batches:
            settled = pc.equal(pc.binary_length(batch["bytes"]), 0)
            done = batch.filter(settled)
            if len(done):
                yield from _found(1, {c: done[c].to_numpy() for c in ("key", "th", "s", "e")})
            batch = batch.filter(pc.invert(settled))
            akey = batch["akey"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(akey)) + 1).tolist(), len(akey)]
            sizes = np.concatenate(([0], np.cumsum(np.diff(common.utf8(batch["bytes"])[1]) - length + 1)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if suffixes >= SUFFIXES_AT_ONCE and akey[a] != last:
                    yield from settle(held)
                    held, suffixes = [], 0
                held.append(batch.slice(a, b - a))
                suffixes += int(sizes[b] - sizes[a])
                last = akey[a]
        if held:
            yield from settle(held)

    return run


def _removed(batches):
    for batch in batches:
        data, at = common.utf8(batch["text"])
        data = data.tobytes()
        rows: list[tuple] = []
        for a, b, found in zip(at[:-1].tolist(), at[1:].tolist(), batch["found"].to_pylist(), strict=True):
            kept, to, spans = [], a, 0
            if found:
                s = np.array([x["s"] for x in found], np.int64)
                _, s, e = merged([], s, np.array([x["e"] for x in found], np.int64))
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(data[to : a + x])
                    to, spans = a + y, spans + 1
            kept.append(data[to:b])
            kept = b"".join(kept)
            rows.append((b - a, b - a - len(kept), spans, kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, common_anchor: int = COMMON_ANCHOR,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) of every row."""
    if not 64 <= length <= 255:
        raise ValueError("strings of 64 to 255 bytes can be looked for")
    spark = documents.sparkSession
    common.prepare(spark)
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    twice = not base.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = base.withColumns({"key": F.coalesce("doc_id", F.lit(common.NULL_ID)), "th": F.xxhash64("text") if twice else F.lit(0).cast("long")})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // bucket_bytes))
    dealt = rows.select("key", "th", "text").mapInArrow(_map_contexts(length, buckets), _BLOB)
    found = common.stored(common.by_buckets(dealt, buckets).mapInArrow(_reduce_contexts(length, common_anchor), _FOUND), "contexts")

    def with_texts(found: DataFrame, names: list[str], how: str) -> DataFrame:
        lists = found.groupBy("key", "th").agg(F.collect_list(F.struct(*names)).alias("found"))
        return rows.join(lists, ["key", "th"], how)

    open_ = found.where("kind = 0")
    common_, n = common.large_groups(open_, ["akey"], common_anchor, "common-anchors")
    common_ = common_.select("akey", F.lit(True).alias("common"))
    common_ = F.broadcast(common_) if n <= common.BROADCAST_GROUPS else common_
    open_ = open_.join(common_, "akey", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    several = with_texts(open_, ["akey", "s", "e", "common"], "inner").select("key", "th", "text", "found")
    cut = several.mapInArrow(_cut_contexts(length), _CUT)
    cut = cut.repartition(min(buckets, common.MOST_PARTITIONS), "akey").sortWithinPartitions("akey", "key", "th", "s")
    more = common.stored(cut.mapInArrow(_sort_candidates(length), _FOUND), "suffixes")
    gone = found.where("kind = 1").unionByName(more)
    return with_texts(gone, ["s", "e"], "left").select("doc_id", "text", "found").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.source(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
