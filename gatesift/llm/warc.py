"""Web archives in Zstandard: one frame per record, the dictionary in a skippable frame at the start of the file.

Writing: pages become `response` records; of pages with the same payload of at least `least` bytes the one with the
smallest id is the response, the others are `revisit` records that name it and carry no payload. Every task writes files
of bounded size under names of its own attempt; only files which the saved list names are ever read, so a task that runs
twice leaves nothing behind that counts.

Reading: files are streamed, frame by frame, from any file system that Arrow knows; a record is checked for its first
line, its headers, its lengths and, where it carries its payload, the digest. A broken file is an error.

A NULL html is an empty payload. Pages that repeat the smallest id of their payload are all responses; a NULL id counts
as larger than every other and is read back as NULL: its record is named `urn:page-null:`, beside `urn:page:` and the id.
No pages give no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.llm.common import bitmap_of, in_bitmap, join_groups, plain, saved, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 100  # bytes from which equal payloads are written once
FILE_BYTES = 64 << 20  # compressed bytes after which a file is closed
READ = 1 << 20
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 1 << 16  # bounds of the dictionary's training
BITS = 26
# Fixed values of the formats.
SKIPPABLE, SKIPPABLE_MASK, DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A50, 0xFFFFFFF0, 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
URN = "urn:page:"
NULL_URN = "urn:page-null:"


def record(page_id: Any, url: str, payload: bytes, digest: str, refers_to: Any, date: str) -> bytes:
    """One record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{NULL_URN}>" if page_id is None else f"<{URN}{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{URN}{refers_to}>"}
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record and its parts; ValueError where it does not keep to the format."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line!r}")
        fields[name.lower()] = value.strip()
    if missing := [n for n in REQUIRED if n.lower() not in fields]:
        raise ValueError(f"without {missing}")
    length = fields["content-length"]
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        raise ValueError(f"the block is not of length {length}")
    block = rest[: int(length)]
    out = {"type": fields["warc-type"], "fields": fields, "page_id": None, "refers_to": None, "bytes": None, "digest": None, "payload": None}
    if fields["warc-record-id"].startswith(f"<{URN}"):
        out["page_id"] = fields["warc-record-id"][len(URN) + 1 : -1]
    if out["type"] not in ("response", "revisit"):
        return out
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
    if not found or not http.startswith(b"HTTP/") or not size:
        raise ValueError("no HTTP header with a length")
    out["bytes"], out["digest"] = int(size[1]), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["type"] == "response":
        if len(payload) != out["bytes"] or hashlib.sha256(payload).hexdigest() != out["digest"]:
            raise ValueError("the payload is not of the length and digest that are stated")
        out["payload"] = payload
    else:
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a payload or refers to nothing")
        out["refers_to"] = fields["warc-refers-to"][len(URN) + 1 : -1]
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary, itself compressed."""
    import zstandard

    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def read_records(source: Any) -> Iterator[bytes]:
    """Decoded records of an archive that is read from a file-like object; a frame holds one record."""
    import zstandard

    buffer, ended = b"", False

    def fill(size: int) -> None:
        nonlocal buffer, ended
        while len(buffer) < size and not ended:
            more = source.read(READ)
            ended = not more
            buffer += more

    dictionary, first = None, True
    while True:
        fill(8)
        if not buffer:
            return
        if len(buffer) < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack("<II", buffer[:8])
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            fill(8 + size)
            body, buffer = buffer[8 : 8 + size], buffer[8 + size :]
            if len(body) < size:
                raise ValueError("the archive ends inside a frame")
            if first and magic == DICTIONARY_FRAME:
                if body[:4] == struct.pack("<I", ZSTD_FRAME):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
            first = False
            continue
        first = False
        frame = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while not frame.eof:
            fill(1)
            if not buffer:
                raise ValueError("the archive ends inside a frame")
            out.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def train_dictionary(pages: DataFrame, payload: str, order: str) -> bytes:
    """A dictionary from at most SAMPLES payloads, SAMPLE_BYTES of each, chosen by a hash of the id; empty where there are none.

    Only ids are ranked; payloads are fetched for those that were chosen, so no more than SAMPLES of them reach the driver
    however many partitions there are. Of a repeated id the smallest payload counts.
    """
    import zstandard

    full = pages.filter(F.octet_length(payload) > 0).select(F.col(order).alias("_id"), F.substring(payload, 1, SAMPLE_BYTES).alias("p"))
    rank = F.xxhash64("_id")
    chosen = full.select("_id").distinct().orderBy(rank, "_id").limit(SAMPLES).select(F.col("_id").alias("_chosen"))
    fetched = full.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("_chosen"))).groupBy("_id").agg(F.min("p").alias("p"))
    samples = [bytes(r["p"]) for r in fetched.orderBy(rank, "_id").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b"".join(samples)[:DICTIONARY_BYTES]


def _written(folder: str, dictionary: bytes, date: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True, **options)
        out, stream, number, size, records = [], None, 0, 0, 0

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                out.append((f"{folder}/{name}", records, size))
                stream = None

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                if stream is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    store.create_dir(base, recursive=True)
                    stream, number, size, records = store.open_output_stream(f"{base}/{name}", compression=None), number + 1, 0, 0
                    size += stream.write(dictionary_frame(dictionary)) if dictionary else 0
                frame = compressor.compress(record(page_id.as_py(), url.as_py() or "", payload.as_py(), digest.as_py(), refers_to.as_py(), date))
                stream.write(frame)
                size, records = size + len(frame), records + 1
                if size >= file_bytes:
                    close()
        close()
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), *[pa.array(list(c), pa.int64()) for c in columns[1:]]], ["path", "records", "bytes"])

    return written


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST,
    date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes a record per row of `pages` below `folder`; returns the saved list of files: `path`, `records`, `bytes`."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = plain(pages, page_id, url, html).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    equal = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
    groups = saved(equal.filter("pages > 1"))
    bitmap = saved(bitmap_of(groups.select(F.xxhash64("digest").alias("_key")), "_key", BITS))
    likely = in_bitmap(rows.withColumn("_key", F.xxhash64("digest")), "_key", bitmap, BITS, "_likely").drop("_key")
    alone = likely.filter("not _likely").drop("_likely").withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))
    judged = join_groups(likely.filter("_likely").drop("_likely"), groups, "digest", "pages", pages.count())
    copy = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    judged = judged.select("page_id", "url", "payload", "digest", F.when(copy, F.col("first_id")).alias("refers_to"))
    dictionary = train_dictionary(rows, "payload", "page_id")
    every = alone.select(*judged.columns).unionByName(judged)
    return saved(every.mapInArrow(_written(folder, dictionary, date, file_bytes), "path string, records bigint, bytes bigint"))


FIELDS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _read(keep_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], FIELDS)

        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    for raw in read_records(source):
                        r = parse(raw)
                        payload = r["payload"] if keep_payload else None
                        rows.append((r["page_id"], r["fields"].get("warc-target-uri"), r["type"], r["bytes"], r["digest"], r["refers_to"], payload))
                        size += len(payload or b"") + 500
                        if size > 4 << 20:
                            yield table(rows)
                            rows, size = [], 0
        if rows:
            yield table(rows)

    return read


def read_archives(files: DataFrame, path: str = "path", keep_payload: bool = True) -> DataFrame:
    """Records of the archives which a table lists: ids as text, url, type, length and digest of the payload, the payload."""
    n = max(files.sparkSession.sparkContext.defaultParallelism, files.count() // 4)
    schema = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    return files.select(path).repartition(n, F.col(path)).mapInArrow(_read(keep_payload), schema)


def archive_folder(spark: SparkSession, name: str) -> str:
    """A folder for archives in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}"
