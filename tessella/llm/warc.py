"""WARC archives: written with revisits, read back by verified record chains.

Writing: a page's record is a response, or a revisit where another page with a
larger id has an equal payload of at least ``revisit_from`` bytes. Records end
with two line ends, and Spark's text writer, with a line feed as separator,
puts them down byte for byte, so the files are plain WARC. They aren't
compressed, so that a large archive is read by many tasks.

Reading: the text reader cuts the files at the record magic, wherever it
stands, and streams the pieces. A first pass notes for each piece its place and
that of the record after it by its declared length, and gives, for each split,
where a chain that enters it at any candidate leaves it. Pointer jumping from
each file's start over these candidate-to-successor links finds the entry of
every split. The second pass follows each split's chain from its entry: only
those pieces are records, and magic inside a payload is refused. A record whose
payload holds magic is put together again from its pieces.

Defined results: a null payload is empty; pages that share an id and a payload
are responses alike; a null id ranks below all others, and if no other page has
its payload it is a response; a null URL is left out; blanks and controls in a
URL are percent-encoded; an empty table gives an archive without records; other
columns are left aside. Bytes that no chain reaches are refused. A damaged record
hides what follows it in its file, so a file whose chain doesn't reach its end is
an error, unless the reader asks for what can be verified (``strict=False``).
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: With more splits than this, their entries are joined by a shuffle, not a broadcast.
BROADCAST_SPLITS = 100_000
#: With more revisits than this (some 100 bytes each), pages meet them by a shuffle, not a broadcast.
BROADCAST_REVISITS = 500_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches):
    for batch in batches:
        data, at = common.utf8(batch["html"])
        data = memoryview(data)
        got = [digest32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(got), pa.array(np.diff(at))], names=["page_id", "digest", "size"])


def _records(batches):
    """The bytes of each page's record without the last line feed."""
    for batch in batches:
        data, at = common.utf8(batch["html"])
        data = data.tobytes()
        out = []
        columns = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")]
        for a, b, page, url, digest, refers, revisit in zip(at[:-1].tolist(), at[1:].tolist(), *columns, strict=True):
            payload = data[a:b]
            block = _HTTP if revisit else _HTTP + payload
            head = [
                f"WARC-Type: {'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
                f"WARC-Date: {DATE}",
                f"WARC-Payload-Digest: sha1:{digest}",
                f"X-Payload-Length: {len(payload)}",
                "Content-Type: application/http;msgtype=response",
                f"Content-Length: {len(block)}",
            ]
            if url is not None:
                safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
                head.insert(3, f"WARC-Target-URI: {safe}")
            if revisit:
                head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                head.append(f"WARC-Refers-To: <urn:page:{refers}>")
            out.append(MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_from: int = 0, compression: str = "none",
) -> None:
    """Write one record per row of ``pages`` to WARC files under ``path``."""
    common.prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"),
    )
    hashed = common.stored(rows.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, size long"), "digests")
    # Only payloads that more than one id has; one row each, from counts combined before the shuffle.
    groups = hashed.where(F.col("size") >= revisit_from).groupBy("digest", "size")
    shared = groups.agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1 and last_id is not null")
    later = hashed.join(shared, ["digest", "size"]).where("page_id is null or page_id < last_id")
    later = common.stored(later.select("page_id", "digest", F.col("last_id").alias("refers_to")).distinct(), "revisits")
    few = later.count() <= BROADCAST_REVISITS
    # A digest binds a payload, so rows find their revisit by id and digest.
    named = rows.mapInArrow(_with_digest, "page_id long, url string, html string, digest string")
    marked = named.alias("p").join(
        (F.broadcast(later) if few else later).alias("r"), F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left"
    ).select("p.*", "refers_to", F.expr("r.digest is not null").alias("revisit"))
    out = marked.mapInArrow(_records, "record binary").select(F.col("record").cast("string"))
    out.write.option("lineSep", "\n").option("compression", compression).text(path)


def _with_digest(batches):
    for batch in batches:
        data, at = common.utf8(batch["html"])
        data = memoryview(data)
        got = [digest32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield batch.append_column("digest", pa.array(got))


def parse_head(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Bytes of the header, of the block, and the fields, of a piece behind the magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit() and "warc-type" in fields):
        return None
    return end + 4, int(size), fields


def _pieces(batches):
    """(file, block, offset in split, piece) of each piece, in the order of the file."""
    now, at = None, 0
    for batch in batches:
        files, blocks = batch["file"].to_pylist(), batch["block"].to_pylist()
        data, bounds = common.utf8(batch["piece"].cast(pa.binary()))
        data = data.tobytes()
        for i, split in enumerate(zip(files, blocks, strict=True)):
            if split != now:
                now, at = split, 0
            piece = data[bounds[i] : bounds[i + 1]]
            yield split, at, piece
            at += len(piece) + len(MAGIC)


def _chains(batches):
    """For each split its size, and for each candidate where its chain leaves the split.

    Offsets count from the split's first piece. A piece's record begins at the
    magic before it, MAGIC's length earlier. The file's first piece stands
    before any magic; its successor is what follows it if it is empty.
    """
    splits: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    sizes: dict[tuple, int] = {}
    for split, at, piece in _pieces(batches):
        got = parse_head(piece)
        if got:
            splits[split][0].append(at)
            splits[split][1].append(at + got[0] + got[1] + 4 + len(MAGIC))
        sizes[split] = at + len(piece) + len(MAGIC)
    for split, size in sizes.items():
        starts, follows = splits[split]
        leave = dict(zip(starts, follows, strict=True))
        for a in reversed(starts):
            leave[a] = leave.get(leave[a], leave[a])
        n = len(starts) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([split[0]] * n), pa.array([split[1]] * n, pa.int64()), pa.array([None, *starts], pa.int64()), pa.array([size, *(leave[a] for a in starts)], pa.int64())],
            names=["file", "block", "at", "leave"],
        )


def split_entries(links: DataFrame) -> DataFrame:
    """(file, block, base, entry, whole): where the split begins, the first record that the file's chain has in it,
    and whether the chain reaches the file's end.

    ``links`` is what ``_chains`` gives. Offsets here are those of the pieces in
    the whole file. Pointer jumping: each round doubles the hops of a link and
    adds what the reached splits lead to, so rounds grow with the logarithm of
    a file's splits.
    """
    links = common.stored(links, "warc-links")
    sizes = links.where("at is null").select("file", "block", F.col("leave").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.stored(sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "warc-bases")
    whole = links.where("at is not null").join(bases, ["file", "block"])
    jump = whole.select("file", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("leave")).alias("to"))
    # A file's first piece lies before its first magic and is empty.
    reached = bases.select("file").distinct().withColumn("at", F.lit(len(MAGIC)).cast("long"))
    # Only links from where some chain enters a split can be met.
    doors = jump.select("file", F.col("to").alias("at")).unionByName(reached).distinct()
    jump = common.stored(jump.join(doors, ["file", "at"], "left_semi"), "warc-jump")
    reached, known = common.stored(reached, "warc-reached"), -1
    count = reached.count()
    while count != known:
        known = count
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = common.stored(reached.unionByName(more).distinct(), "warc-reached")
        count = reached.count()
        if count != known:
            onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
            jump = jump.join(onward, ["file", "to"], "left")
            jump = common.stored(jump.select("file", "at", F.coalesce("next", "to").alias("to")), "warc-jump")
    # What is reached lies in the last split that begins at or before it: one sort of both.
    places = bases.select("file", F.col("base").alias("at"), F.struct("block", "base", "size").alias("split"))
    places = places.unionByName(reached.select("file", "at", F.lit(None).cast(places.schema["split"].dataType).alias("split")))
    latest = Window.partitionBy("file").orderBy("at", F.col("split").isNull(), "split.block").rowsBetween(Window.unboundedPreceding, 0)
    inside = places.withColumn("own", F.last("split", ignorenulls=True).over(latest)).where("split is null")
    inside = inside.where("at < own.base + own.size").select("file", F.col("own.block").alias("block"), "at")
    inside = inside.groupBy("file", "block").agg(F.min("at").alias("entry"))
    totals = bases.groupBy("file").agg(F.sum("size").alias("total"))
    whole = totals.join(reached.groupBy("file").agg(F.max("at").alias("last")), "file").select("file", (F.col("last") >= F.col("total")).alias("whole"))
    return bases.join(inside, ["file", "block"], "left").join(whole, "file").select("file", "block", "base", "entry", "whole")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdigit() else None


def _fields(body: bytes) -> tuple:
    """A row of ``RECORDS`` from a verified record's bytes behind the magic."""
    head, size, fields = parse_head(body)
    block = body[head : head + size]
    payload = block[block.find(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if payload is not None and digest and digest32(payload) != digest:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't have its digest")
    length = len(payload) if payload is not None else int(fields.get("x-payload-length", 0))
    return (
        _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], digest,
        length, _page(fields.get("warc-refers-to")), payload,
    )


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return _rows(rows, names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()])


def _follow(parts: bool):
    """Follow each split's chain from its entry, over pieces in the order of the file.

    Gives the records that end in their split or, with ``parts``, the pieces of
    those that don't: file, offset of the record or null where it began in an
    earlier split, offset of the piece, bytes of the record, piece.
    """

    def run(batches):
        split, at, expected = None, 0, None
        record, need, held = None, 0, []  # the record being put together
        for batch in batches:
            data, bounds = common.utf8(batch["piece"].cast(pa.binary()))
            data = data.tobytes()
            rows: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("file", "block", "base", "entry")]
            for i, (file, block, base, entry) in enumerate(zip(*columns, strict=True)):
                if (file, block) != split:
                    if parts and held:
                        rows += [(split[0], record, o, need, x) for o, x in held]
                    split, at, expected, record, held = (file, block), base, entry, None, []
                piece = data[bounds[i] : bounds[i + 1]]
                if at == expected and (got := parse_head(piece)):
                    if parts and held:  # it was cut short
                        rows += [(file, record, o, need, x) for o, x in held]
                    record, need, held = at, got[0] + got[1] + 4, [(at, piece)]
                    expected = at + need + len(MAGIC)
                elif held:
                    held.append((at, piece))
                elif parts and record is None and at:
                    rows.append((file, None, at, None, piece))
                at += len(piece) + len(MAGIC)
                if held and at - len(MAGIC) - record >= need - 4:  # the last line ends may be missing
                    if not parts:
                        rows.append(_fields(MAGIC.join(x for _, x in held)))
                    held = []
            yield _rows(rows, _PART_NAMES, _PART_KINDS) if parts else _record_rows(rows)
        if parts and held:
            yield _rows([(split[0], record, o, need, x) for o, x in held], _PART_NAMES, _PART_KINDS)

    return run


_PART_NAMES = ["file", "record", "offset", "need", "piece"]
_PART_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _joined(batches):
    for batch in batches:
        bodies = (MAGIC.join(x["piece"] for x in row) for row in batch["pieces"].to_pylist())
        yield _record_rows([_fields(x) for x in bodies])


def read_warc(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of every verified record.

    A response's payload is checked against its digest. A revisit has no
    payload; its digest and length are those that its header declares. With
    ``strict`` a file whose chain breaks off is an error; without, it gives the
    records before the break.
    """
    common.prepare(spark)
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )
    links = raw.mapInArrow(_chains, "file string, block long, at long, leave long")
    entries = common.stored(split_entries(links), "warc-entries")
    broken = [r["file"] for r in entries.where("not whole").select("file").distinct().limit(20).collect()] if strict else []
    if broken:
        raise ValueError(f"the chain of records breaks off before the end of {', '.join(broken)}")

    def pieces(entries: DataFrame) -> DataFrame:
        if entries.count() <= BROADCAST_SPLITS:
            found = raw.join(F.broadcast(entries), ["file", "block"])
        else:
            found = raw.withColumn("order", F.monotonically_increasing_id()).join(entries, ["file", "block"])
            found = found.repartition("file", "block").sortWithinPartitions("file", "block", "order")
        return found.select("file", "block", "base", "entry", "piece")

    records = pieces(entries).mapInArrow(_follow(parts=False), RECORDS)
    # Records cross splits only in files where a split doesn't begin with one.
    crossed = entries.where("block > 0 and (entry is null or entry > base)").select("file").distinct()
    if crossed.isEmpty():
        return records
    parts = pieces(entries.join(crossed, "file")).mapInArrow(
        _follow(parts=True), "file string, record long, offset long, need long, piece binary"
    )
    before = Window.partitionBy("file").orderBy("offset")
    for c in ("record", "need"):
        parts = parts.withColumn(c, F.coalesce(c, F.last(c, ignorenulls=True).over(before)))
    parts = parts.where("offset < record + need").groupBy("file", "record", "need")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("pieces"))
    held = F.aggregate("pieces", F.lit(-len(MAGIC)).cast("long"), lambda n, x: n + F.octet_length(x["piece"]) + len(MAGIC))
    return records.unionByName(whole.where(held >= F.col("need") - 4).select("pieces").mapInArrow(_joined, RECORDS))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_warc(common.source(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), lasts AS (SELECT h, payload_bytes, max(page_id) AS last_id FROM hashed GROUP BY ALL)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM hashed JOIN lasts USING (h, payload_bytes)
"""
