"""WARC archives: write web pages, read them back record by record.

Every record is a gzip member of its own. The reader is sequential: it inflates a
member step by step, frames the record by its content length and verifies the digests
of block and payload. A page whose payload (at least ``LEAST`` bytes) also stands under
a larger page_id becomes a ``revisit`` that refers to the page with the largest one.

Only digests and ids are grouped, combined before the shuffle; a payload moves once,
to the task that writes it, and a hot digest is split by adaptive skew handling.

Given results: null html is an empty payload, which like every short one is a response.
Every row gives a record. Rows repeating the largest page_id of a payload are all
responses. A null page_id is smaller than any number; where all ids of a payload are
null, all are responses. A null url leaves out the target. Empty tables give no file.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.files import fresh_name, reading, writing
from sparkwarden.shared import kept, new_folder

LEAST = 1000
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, bytes long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string"
)


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    long_enough = F.octet_length("payload") >= least
    repeated = (
        rows.where(long_enough)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(again & long_enough, "revisit").otherwise("response")
    joined = rows.join(repeated.hint("shuffle_hash"), "digest", "left").withColumn("record_type", kind)
    refers = F.when(F.col("record_type") == "revisit", F.col("first_id"))
    return joined.select("page_id", "url", "payload", "record_type", refers.alias("refers_to"))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{payload_digest[5:]}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return deflate.compress(data) + deflate.flush()


def page_record(page_id, url, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if kind == "response" else http
    digest = _sha1(payload)
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        headers.insert(3, ("WARC-Target-URI", safe))
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
    return _member(headers, block)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One archive per task from the rows of ``decided``; returns the stored manifest."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, count, size = fresh_name(folder, ".warc.gz"), 0, 0
        with writing(path) as stream:
            about = b"software: sparkwarden\r\nformat: WARC File Format 1.1\r\n"
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{path.rpartition('/')[2]}>")]
            head += [("WARC-Date", date), ("Content-Type", "application/warc-fields")]
            member = _member([*head, ("Content-Length", str(len(about)))], about)
            stream.write(member)
            size += len(member)
            for batch in bounded(batches):
                for row in batch.to_pylist():
                    member = page_record(
                        row["page_id"], row["url"], row["payload"], row["record_type"], row["refers_to"], date
                    )
                    stream.write(member)
                    count, size = count + 1, size + len(member)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                ["path", "n_records", "bytes"],
            )

    return kept(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case
    block: bytes


class DamagedRecord(ValueError):
    pass


def read_records(stream) -> Iterator[Record]:
    """Records of an archive in order; raises ``DamagedRecord`` on any broken framing or
    digest. Memory holds one compressed step and one record."""
    raw = stream.read(STEP)
    while raw:
        inflate, data, need = zlib.decompressobj(31), bytearray(), None
        headers: dict[str, str] = {}
        start = 0
        while not inflate.eof:
            if not raw:
                raw = stream.read(STEP)
                if not raw:
                    raise DamagedRecord("the archive ends inside a member")
            try:
                data += inflate.decompress(raw, STEP)
            except zlib.error as broken:
                raise DamagedRecord(str(broken)) from broken
            raw = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
            if need is None and (end := data.find(b"\r\n\r\n")) >= 0:
                lines = bytes(data[:end]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise DamagedRecord("no version line")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                start, need = end + 4, int(headers["content-length"])
            if need is not None and len(data) > start + need + 4:
                raise DamagedRecord("a record longer than its content length")
        if not raw:
            raw = stream.read(STEP)
        if need is None or len(data) != start + need + 4 or data[-4:] != b"\r\n\r\n":
            raise DamagedRecord("a record shorter than its content length")
        block = bytes(data[start : start + need])
        if headers.get("warc-block-digest", digest := _sha1(block)) != digest:
            raise DamagedRecord("block digest")
        yield Record(headers, block)


def page_of(record: Record) -> dict | None:
    """The row a page record stands for; None for other records."""
    headers, kind = record.headers, record.headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"]
    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise DamagedRecord("payload digest")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*):\w+>", headers.get(name, ""))
        return int(found[1]) if found and found[1] else None

    return {
        "page_id": number("warc-record-id"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(digest[5:]).hex(),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "url": headers.get("warc-target-uri"),
    }


def read_archives(manifest: DataFrame) -> DataFrame:
    """The page rows of the listed archives."""
    spread = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"], kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                waiting, total = [], 0
                with reading(path) as stream:
                    for record in read_records(stream):
                        page = page_of(record)
                        if page is not None:
                            waiting.append(page)
                            total += 1
                        if len(waiting) >= 5000:
                            yield pa.RecordBatch.from_pylist(waiting, schema)
                            waiting = []
                if total != expected:
                    raise DamagedRecord(f"{path}: {total} of {expected} records")
                yield pa.RecordBatch.from_pylist(waiting, schema)

    return manifest.select("path", "n_records").repartition(spread).mapInArrow(read, RECORDS)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what they hold."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(decided(pages, least), folder))
