import glob
import gzip

import pytest

from tessella.llm import common, warc

PAGES = "page_id long, url string, html string, shard int, digest string"


def page(i, html, url="http://a.example/ x\n"):
    return (i, url, html, 0, "clash")


def back(spark, rows, path, **kw):
    df = spark.createDataFrame(rows, PAGES)
    warc.write_warc(df, path, **kw)
    return warc.read_warc(spark, path)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = (warc.MAGIC + b"WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode()
    texts = ["<p>é</p>", fake, "x" + fake * 3 + "tail", "", None, fake, "a\r\nb\n\nc\n", "z" * 300_000, fake[:9]]
    rows = [page(i, t) for i, t in enumerate(texts)] + [page(None, "only"), page(None, texts[0])]
    got = back(spark, rows, str(tmp_path / "w"), compression="gzip")
    found = sorted(((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in got.collect()), key=str)
    want = []
    ids = [(-1 if r[0] is None else r[0], (r[2] or "").encode()) for r in rows]
    for i, html in ids:
        last = max(j for j, h in ids if h == html)
        revisit = last != i
        want.append((i, "revisit" if revisit else "response", last if revisit else None, len(html), None if revisit else html))
    assert found == sorted(want, key=str)
    text = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "part-*")))
    assert text.startswith(warc.MAGIC) and text.endswith(b"\r\n\r\n") and b"%20x%0A" in text


@pytest.mark.parametrize("split", [700, 4096, 1 << 20])
def test_records_across_splits(spark, tmp_path, split):
    fake = (warc.MAGIC + b"WARC-Type: response\r\nContent-Length: 5000\r\n\r\nabc\r\n\r\n").decode()
    rows = [page(i, f"{i}:" + (fake if i % 3 == 0 else "word ") * (i % 7 * 20)) for i in range(120)]
    df = spark.createDataFrame(rows, PAGES).coalesce(2)
    warc.write_warc(df, str(tmp_path / "w"), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {r[0]: r[2] for r in rows}


def test_the_query_crosses_splits(spark, tmp_path):
    """Archives as the writer makes them by default: several splits, entries found over several rounds."""
    rows = [page(i, f"{i}:" + "word " * (i % 9 * 40)) for i in range(200)]
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        raw = spark.read.option("lineSep", warc.MAGIC.decode()).text(str(tmp_path / "w"))
        assert raw.rdd.getNumPartitions() > 20
        assert warc.read_warc(spark, str(tmp_path / "w")).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_broken_chain_is_an_error(spark, tmp_path):
    rows = [page(i, f"page {i} " * 30) for i in range(40)]
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    [file] = glob.glob(str(tmp_path / "w" / "part-*"))
    data = open(file, "rb").read()
    at = data.index(b"Content-Length", len(data) // 2)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0.txt").write_bytes(data[:at] + b"Content-Lemgth" + data[at + 14 :])
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_warc(spark, str(tmp_path / "d"))
    some = warc.read_warc(spark, str(tmp_path / "d"), strict=False).count()
    assert 0 < some < 40
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.txt").write_bytes(data[: len(data) - 500])
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_warc(spark, str(tmp_path / "t")).count()


def test_empty_and_repeated_rows(spark, tmp_path):
    assert back(spark, [], str(tmp_path / "e")).count() == 0
    got = back(spark, [page(4, "same"), page(4, "same"), page(2, "same")], str(tmp_path / "r")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(2, "revisit", 4), (4, "response", None), (4, "response", None)]


def test_a_long_url_hides_nothing(spark, tmp_path):
    rows = [page(1, "first"), page(2, "second", "data:text/plain," + "x" * 100_000), page(3, "third"), page(4, "fourth")]
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "u"))
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_warc(spark, str(tmp_path / "u")).collect()}
    assert sorted((k, v[1]) for k, v in got.items()) == [(r[0], r[2]) for r in rows] and got[2][0] == rows[1][1]


def test_connected_components(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_with_a_hub(spark):
    edges = [(10_000 + i, 9_999) for i in range(6000)] + [(20_000 + i, 10_000 + i) for i in range(50)] + [(3, 20_007)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 6000 + 1 + 50 + 1 and set(got.values()) == {3}
