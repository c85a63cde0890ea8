import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from gatesift.llm import registry
from gatesift.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, digest string, payload int, _key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "k") for r in rows], SCHEMA)


ROWS = [
    (5, "http://a/5", "<p>" + "same " * 40), (2, "http://a/2", "<p>" + "same " * 40), (9, None, "<p>" + "same " * 40), (3, "http://a/3", "short"), (4, "u\r\nx: y", "short"),
    (6, "", None), (7, "http://é/", ""), (8, "http://a/8", "é\r\n\r\n🙂" * 100), (10, "http://big", "<b>x</b>" * 200_000), (2, "http://again", "<p>" + "same " * 40),
]


@pytest.mark.parametrize("file_bytes", [W.FILE_BYTES, 1])
def test_round_trip(spark, tmp_path, file_bytes):
    files = W.write_archives(pages(spark, ROWS).repartition(3), str(tmp_path / "w"), file_bytes=file_bytes)
    assert files.agg(F.sum("records")).first()[0] == len(ROWS)
    got = sorted((int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"")) for r in W.read_archives(files).collect())
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        first = min(j for j, _, h in ROWS if (h or "") == (html or ""))
        copy = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", str(first) if copy else None, b"" if copy else raw))
    assert got == sorted(want)


def test_a_frame_per_record_and_the_dictionary_first(spark, tmp_path):
    rows = [(i, "http://x", "<html><body>" + f"page {i} " * 50) for i in range(300)]
    path = W.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w")).first()["path"]
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == W.DICTIONARY_FRAME
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size], max_output_size=1 << 20))
    rest, n = raw[8 + size :], 0
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = frame.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and W.parse(record)["type"] == "response"
        rest, n = frame.unused_data, n + 1
    assert n == 300
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(raw[:6])))


def test_other_archives_are_read():
    """An uncompressed dictionary frame, skippable frames in between, no dictionary at all, small reads."""
    record = W.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    compress = zstandard.ZstdCompressor().compress
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 5))

    assert list(W.read_records(Slow(compress(record) + skip + compress(record)))) == [record, record]
    body = b"WARC/1.1\r\nWARC-Type: response" * 20
    dictionary = zstandard.ZstdCompressionDict(body)
    raw = struct.pack("<II", W.DICTIONARY_FRAME, len(body)) + body + zstandard.ZstdCompressor(dict_data=dictionary).compress(record)
    assert list(W.read_records(Slow(raw))) == [record]


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"HTTP/1.1"), (b"WARC-Type", b"WARC-Kind"), (b"WARC-Date: ", b"WARC-Date "), (b"\r\n\r\npayload", b"\r\n\r\npayloax"),
    (b"payload\r\n\r\n", b"payload\r\n"), (b"payload\r\n\r\n", b"payloadx\r\n\r\n"),
])
def test_broken_records(change):
    record = W.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert W.parse(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse(record.replace(*change))


def test_empty(spark, tmp_path):
    files = W.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert files.count() == 0 and W.read_archives(files).count() == 0


def test_null_ids_are_read_back_as_null(spark, tmp_path):
    same = "<p>" + "same " * 40
    rows = [(None, "http://none", "<p>alone</p>"), (None, "http://copy", same), (2, "http://a/2", same), (3, "http://a/3", "short"), (None, "u", None)]
    assert W.parse(W.record(None, "http://a", b"x", hashlib.sha256(b"x").hexdigest(), None, "2024-01-01T00:00:00Z"))["page_id"] is None
    read = W.read_archives(W.write_archives(pages(spark, rows), str(tmp_path / "w")))
    got = sorted((r["page_id"] or "", r["url"], r["record_type"], r["refers_to"]) for r in read.collect())
    assert got == [("", "http://copy", "revisit", "2"), ("", "http://none", "response", None), ("", "u", "response", None), ("2", "http://a/2", "response", None), ("3", "http://a/3", "response", None)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in registry.op2_warc(spark, str(tmp_path)).collect()) == [
        (0, "response", 0), (0, "response", 0), (0, "revisit", 2), (2, "response", 0), (3, "response", 0),
    ]


def test_dictionary_does_not_depend_on_how_rows_are_spread(spark):
    rows = [(i % 350 if i % 40 else None, "http://x", f"<html><body>{i * i} " + f"page {i % 7} " * 30) for i in range(400)]
    df = pages(spark, rows).withColumn("payload", F.col("html").cast("binary"))
    made = W.train_dictionary(df, "payload", "page_id")
    assert made and W.train_dictionary(df.orderBy(F.desc("html")).repartition(11), "payload", "page_id") == made
    assert W.train_dictionary(df.filter("false"), "payload", "page_id") == b""
