"""Token ids in binary files whose blocks are stored plane by plane.

File layout (little-endian)::

    "PLN1" | planes of block 0 | planes of block 1 | ... | index | index size (u64) | "PLN1"

A block is ``block_ids`` unsigned 32-bit ids (the last one may be shorter). It is
transposed into byte planes (4) or bit planes (32); each plane is one zstandard
frame, and planes that are all zero are left out. The index is zstandard-compressed
JSON: the plane kind, block size, per block (offset, ids, size of every plane), and
per document (doc_id, ids). Any document can be read by its position alone.

Given results: null text is an empty text (one end id). Documents are ordered by
doc_id (null first), equal ids by a hash of the text; every row, repeated or not, is written.
An empty table gives no file. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.files import fresh_name, reading, writing
from sparkwarden.llm.tokens import TEXT_BYTES, encoder
from sparkwarden.shared import kept, new_folder

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 18
LEVEL = 1

MANIFEST = "part int, path string, n_docs long, n_ids long, bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block, least significant first; trailing zero planes are dropped."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        table = ids.view(np.uint8).reshape(-1, 4)
        return [table[:, k].tobytes() for k in range((top + 7) // 8)]
    return [np.packbits(((ids >> k) & 1).astype(np.uint8)).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "byte":
        table = np.zeros((count, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            table[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return table.view("<u4").ravel()
    ids = np.zeros(count, dtype="<u4")
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=count)
        ids |= bits.astype("<u4") << np.uint32(k)
    return ids


class PlaneWriter:
    """Holds at most one block; everything else is already in the file."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS):
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.waiting = bytearray()
        self.blocks: list[list] = []
        self.docs: list[list] = []
        self.at = len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append([doc_id, len(ids) // 4])
        self.waiting += ids
        size = 4 * self.block_ids
        while len(self.waiting) >= size:
            self._flush(bytes(self.waiting[:size]))
            del self.waiting[:size]

    def _flush(self, raw: bytes) -> None:
        frames = [self.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.kind)]
        self.blocks.append([self.at, len(raw) // 4, [len(f) for f in frames]])
        for frame in frames:
            self.stream.write(frame)
            self.at += len(frame)

    def close(self) -> int:
        if self.waiting:
            self._flush(bytes(self.waiting))
        index = {"kind": self.kind, "block_ids": self.block_ids, "blocks": self.blocks}
        packed = self.compress(json.dumps(index | {"docs": self.docs}).encode())
        self.stream.write(packed + len(packed).to_bytes(8, "little") + MAGIC)
        return self.at + len(packed) + 12


class PlaneReader:
    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = self._at(size - 12, 12)
        if tail[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a plane file")
        length = int.from_bytes(tail[:8], "little")
        packed = self._at(size - 12 - length, length)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(packed))

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def block(self, number: int) -> np.ndarray:
        offset, count, sizes = self.index["blocks"][number]
        raw, planes, at = self._at(offset, sum(sizes)), [], 0
        for size in sizes:
            planes.append(zstandard.ZstdDecompressor().decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, count, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, list[bytes]]]:
        """(doc_id, pieces of its ids) in file order, one block in memory."""
        blocks = iter(range(len(self.index["blocks"])))
        raw, at = b"", 0
        for doc_id, count in self.index["docs"]:
            need, pieces = 4 * count, []
            while need:
                if at == len(raw):
                    raw, at = self.block(next(blocks)).tobytes(), 0
                piece = raw[at : at + need]
                at, need = at + len(piece), need - len(piece)
                pieces.append(piece)
            yield doc_id, pieces

    def document(self, position: int) -> np.ndarray:
        """Ids of one document, reading only the blocks it lies in."""
        counts = [n for _, n in self.index["docs"]]
        start, end = sum(counts[:position]), sum(counts[: position + 1])
        size = self.index["block_ids"]
        if start == end:
            return np.zeros(0, dtype="<u4")
        first, last = start // size, (end - 1) // size
        ids = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return ids[start - first * size : end - first * size]


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in doc_id order into files under ``folder``.

    Range partitioning on doc_id and a hash of the text gives every task a slice of the
    order, so a hot id is split too, and its sample holds no texts. Returns the manifest, one row per file, already stored."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, writer, ids = fresh_name(folder, ".pln"), None, 0
        with writing(path) as stream:
            writer = PlaneWriter(stream, kind, block_ids)
            encode = encoder(tokenizer).encode
            for batch in bounded(batches, size=TEXT_BYTES):
                doc_ids = batch.column("doc_id").to_pylist()
                for doc_id, raw in zip(doc_ids, encode(batch.column("text").to_pylist())):
                    writer.add(doc_id, raw + end)
                    ids += len(raw) // 4 + 1
            size = writer.close()
        if writer.docs:
            part = TaskContext.get().partitionId()
            row = {"part": part, "path": path, "n_docs": len(writer.docs), "n_ids": ids, "bytes": size}
            yield pa.RecordBatch.from_pylist(
                [row], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())])
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    return kept(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("n_ids")
    files = manifest.select("path", before.alias("start"))  # a row per file, not per document
    spread = max(1, min(manifest.count(), 8 * files.sparkSession.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                with reading(row["path"]) as stream:
                    for doc_id, pieces in PlaneReader(stream).documents():
                        crc, count = 0, 0
                        for piece in pieces:
                            crc, count = zlib.crc32(piece, crc), count + len(piece) // 4
                        out.append((doc_id, start, count, crc))
                        start += count
                columns = list(zip(*out)) or [()] * 4
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return files.repartition(spread).mapInArrow(read, DOCUMENTS)


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id, kind))
