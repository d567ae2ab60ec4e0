"""Simple-8b shards and WARC archives: exact round trips and salvage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayline.llm import simple8b, tokens, warc


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["ids", "bits", "zeros", "wide"])
def test_simple8b_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"ids": lambda: rng.integers(0, 49408, n), "bits": lambda: rng.integers(0, 2, n), "zeros": lambda: np.zeros(n, int), "wide": lambda: 2 ** rng.integers(0, 63, n)}[kind]().astype(np.uint64)
    if kind == "wide" and n:
        ids[0] = np.uint64(2**64 - 1)
    words, directory, exceptions = simple8b.encode(ids)
    assert (simple8b.decode(words, directory, exceptions, n) == ids).all()
    cut = n // 3
    data = simple8b.pack([5, None], np.array([cut, n - cut]), ids)
    [(names, lengths, got)] = simple8b.unpack(data)
    assert names == [5, None] and lengths.tolist() == [cut, n - cut] and (got == ids).all()
    if n > 10:
        with pytest.raises(ValueError):
            list(simple8b.unpack(data[:-3] + b"abc"))


TEXTS = ["Hello, hello World!", "", None, "a\x1cb c  d\te's <|endoftext|> x<|endoftext|>y é ́z ΑΣ ΣΑΣ İ", "naïve café. 3.14 don't\n\nx", "word " * 30_000, "\x01 odd 　 ideographic"]


def test_chunks_encode_as_whole_texts():
    e = tokens.ChunkEncoder(tokens.TokenConfig(known_chunks=12))
    for _ in range(2):
        ids, lengths = e.encode(pa.array([t or "" for t in TEXTS]))
        for t, got in zip(TEXTS, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert got.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def test_token_shards(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (6, "again"), (6, "again")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = tokens.token_output(spark, df, tokens.TokenConfig(segment_ids=64, file_segments=1)).orderBy("start").collect()
    e = tokens.ChunkEncoder(tokens.TokenConfig())
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_output(spark, df.limit(0)).count() == 0


def pages(spark):
    return spark.createDataFrame([(1, "http://a/", "x" * 3000), (2, "http://b/", "x" * 3000), (3, None, None), (4, "u", ""), (5, "v", "é<b>"), (5, "v", "é<b>"), (None, "n", "é<b>"), (6, "w\r\nX: y", "WARC/1.1\r\n" * 9)], "page_id long, url string, html string")


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_round_trip(spark, tmp_path, compressed):
    folder = str(tmp_path / "w")
    cfg = warc.WarcConfig(compressed=compressed, file_bytes=500)
    warc.write_archives(pages(spark), folder, cfg).count()
    got = {(r["page_id"], r["record_type"]): r for r in warc.read_archives(spark, folder).collect()}
    assert set(got) == {(1, "revisit"), (2, "response"), (3, "revisit"), (4, "response"), (5, "response"), (None, "revisit"), (6, "response")}
    assert got[(1, "revisit")]["refers_to"] == 2 and got[(3, "revisit")]["refers_to"] == 4 and got[(None, "revisit")]["refers_to"] == 5
    assert got[(1, "revisit")]["payload_bytes"] == 3000 and got[(1, "revisit")]["payload_digest"] == warc.sha1_base32(b"x" * 3000)
    assert got[(5, "response")]["html"] == "é<b>" and warc.read_gaps(spark, folder).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    def unit(i):
        raw = warc.record(i, f"http://p/{i}", f"page {i} ".encode() * 50, warc.sha1_base32(f"page {i} ".encode() * 50), "response", None)
        if not compressed:
            return raw
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(raw) + c.flush()

    units = [unit(i) for i in range(6)]
    broken = bytearray(units[2])
    broken[len(broken) // 2] ^= 0xFF
    data = units[0] + b"garbage" + units[1] + bytes(broken) + units[3] + units[4][: len(units[4]) // 2] + units[5] + units[0][:40]
    found = list(warc.read_archive(data))
    ids = [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)]
    gaps = [g for g in found if isinstance(g, warc.Gap)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)] and len(gaps) == 4
    first = len(units[0])
    assert (gaps[0].start, gaps[0].end) == (first, first + 7) and gaps[-1].end == len(data)
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("compressed", [True, False])
def test_long_urls(spark, tmp_path, compressed):
    df = spark.createDataFrame([(1, "http://a/" + "b" * 100_000, "x"), (2, "http://a/" + "\n" * 40_000, "y")], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_archives(df, folder, warc.WarcConfig(compressed=compressed)).count()
    got = {r["page_id"]: r["url"] for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: "http://a/" + "b" * 100_000, 2: "http://a/" + "%20" * 40_000} and warc.read_gaps(spark, folder).count() == 0


def test_salvage_within_a_member():
    rng = random.Random(3)
    raws = []
    for i in range(3):
        page = rng.randbytes(3000).hex().encode()
        raws.append(warc.record(i, f"http://p/{i}", page, warc.sha1_base32(page), "response", None))

    def gz(raw, level=6):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(raw) + c.flush()

    def read(data):
        found = list(warc.read_archive(data))
        return [r.headers["warc-record-id"][10:-1] for r in found if isinstance(r, warc.Record)], [g for g in found if isinstance(g, warc.Gap)]

    for damaged in (raws[1].replace(b"Content-Length: 6", b"Content-Length: 7"), raws[1][:-40] + b"?" + raws[1][-39:], raws[1][: len(raws[1]) // 2]):
        one = gz(raws[0] + damaged + raws[2])
        ids, gaps = read(one + gz(raws[1]))
        assert ids == ["0", "2", "1"] and [(g.start, g.end) for g in gaps] == [(0, len(one))] and "inflated bytes" in gaps[0].reason
    for level in (0, 6):
        one = gz(b"".join(raws), level)
        cut = one[: len(one) * 5 // 6]
        ids, gaps = read(cut)
        assert ids == ["0", "1"] and len(gaps) == 1 and gaps[0].end == len(cut)
        ids, gaps = read(cut + gz(raws[0]))
        assert ids == ["0", "1", "0"] and [g.end for g in gaps] == [len(cut)]
        bad = bytearray(one)
        bad[-6] ^= 1  # the checksum alone
        assert read(bytes(bad))[0] == ["0", "1", "2"]


def test_reading_time_grows_with_the_file():
    import time

    def taken(n):
        units = []
        for i in range(n):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            units.append(c.compress(warc.record(i, f"http://p/{i}", random.Random(i).randbytes(2000), "x", "response", None)) + c.flush())
        data = b"".join(units)
        began = time.process_time()
        assert sum(isinstance(r, warc.Record) for r in warc.read_archive(data)) == n
        return time.process_time() - began

    taken(200)
    assert taken(8000) < 12 * max(taken(2000), 0.05)  # 16 times, were it the square


def test_warc_of_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(1, "http://h/" + "y" * 100_000, "<p>" + "long " * 300_000, "x"), (2, "v", None, "y")], "page_id long, url string, html string, record_type string")
    folder = str(tmp_path / "odd")
    warc.write_archives(odd, folder).count()
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert got[1]["payload_bytes"] == 1_500_003 and len(got[1]["url"]) == 100_009 and got[2]["payload_bytes"] == 0
    empty = str(tmp_path / "empty")
    assert warc.write_archives(odd.limit(0), empty).count() == 0


def test_the_warc_query_against_hashlib(spark, tmp_path):
    """Every page of the table, a third of them with payloads that come several times, one of these null and empty."""
    import base64
    import hashlib
    import os

    data = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables here")
    from pyspark.sql import functions as F

    html = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("<p>é "), (F.col("page_id") % 5).cast("string"))).when(F.col("page_id") % 9 == 1, F.lit(None)).when(F.col("page_id") % 9 == 2, "").otherwise(F.col("html"))
    spark.read.parquet(data).withColumn("html", html).write.parquet(str(tmp_path / "pages.parquet"))
    rows = spark.read.parquet(str(tmp_path / "pages.parquet")).collect()
    body = {r.page_id: (r.html or "").encode() for r in rows}
    last = {}
    for i in sorted(body):
        last[body[i]] = i
    want = {(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in body.items()}
    got = warc.op4_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and sum(w[3] == "revisit" for w in want) > 40
