"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

A file begins with a skippable frame that holds the dictionary; each record that follows is a frame of its
own, so a reader needs nothing but the file. The dictionary is trained on a bounded sample of the records.
Payloads that occur more than once are archived once, by the page with the smallest id; the others
revisit it.

Tasks write files under names of their own attempt and put out those names; only names that the
finished job has listed are read, so what a lost task left behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import fresh_path, materialised, sample_by_hash, table
from fieldtrust.llm.files import read_file, write_file

#: Dictionary size, the records it is trained on at most, and the largest of them.
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 64 << 10, 500, 16 << 10
#: Compressed bytes from which a task opens the next file.
FILE_BYTES = 64 << 20
LEVEL = 3
# Magic number of the skippable frame that holds a dictionary; the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the head of the response without its payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url)) if url is not None else None,
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        *([("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in filter(None, fields))
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a file."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not begin with a dictionary")
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(memoryview(raw)[8 + size :]), read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 20)
    while first := lines.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[key] = value
        block = lines.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield fields, block


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size].ljust(8, b"\r")


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, payload, refers_to and revisit.

    Of payloads of at least ``min_bytes`` that are equal, the page with the smallest id is the response. A
    null html is empty. Rows that repeat the smallest id are responses too; null ids revisit a known one.
    Only digests are grouped. Those with copies are written first: few are broadcast, and beyond that the join is one
    of two plain shuffles, where adaptive execution splits a payload with very many pages.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    shared = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(materialised(shared, "shared-payloads"), "_digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit")
    )


def _write(path: str, words: bytes, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(words)
        shared.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(dict_data=shared)
        task = TaskContext.get()
        head = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words
        held, size, written = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{written:04d}-{task.taskAttemptId()}.warc.zst"
            write_file(f"{path}/{name}", b"".join([head, *held]))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")]):
                frame = compressor.compress(record(*row))
                held.append(frame)
                size += len(frame)
                if size >= file_bytes:
                    yield close()
                    held, size, written = [], 0, written + 1
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) below ``path``; the files written, each with its number of records."""
    spark = pages.sparkSession
    # Of long records a window anywhere in them, so that they train the dictionary as well.
    span = SAMPLE_BYTES // 4
    begin = F.pmod(F.xxhash64("page_id", "url"), F.greatest(F.length("html") - span, F.lit(0)) + 1).cast("int") + 1
    window = F.when(F.octet_length("html") <= SAMPLE_BYTES, F.col("html")).otherwise(F.substring("html", begin, F.lit(span)))
    sample = sample_by_hash(pages.where(F.col("html").isNotNull()).select("page_id", "url", window.alias("html")), SAMPLE, "page_id", "url")
    # At most SAMPLE * SAMPLE_BYTES bytes and the urls.
    samples = [record(r["page_id"], r["url"], r["html"].encode("utf-8", "replace")) for r in sample.select("page_id", "url", "html").collect()]
    words = train(samples)
    schema = "file string, records long"
    classified(pages, min_bytes).mapInArrow(_write(path, words, file_bytes), schema).write.parquet(f"{path}/files.parquet")
    return spark.read.schema(schema).parquet(f"{path}/files.parquet")


def _read(path: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def number(name: str) -> int | None:
        return int(name[len("<urn:page:") : -1]) if name != "<urn:page:>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                for fields, block in read_records(read_file(f"{path}/{name}")):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    out.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers and number(refers)))
                columns, kinds = list(zip(*out)), (kind, pa.int64(), pa.string(), pa.string(), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                )

    return run


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of ``files``."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("file").repartition("file").mapInArrow(_read(path, pa.int64()), schema)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), path), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_warc_archive": op6_warc_archive}

ORACLES = {
    "op6_warc_archive": """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
    SELECT hex, min(page_id) AS first_id FROM payloads GROUP BY hex
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM payloads JOIN firsts USING (hex)
"""
}
