"""Character trigrams of documents as compact count matrices.

A trigram is one exact 63-bit number: three code points of 21 bits. Documents of one
language and Arrow slice form a block; the block's documents-by-trigrams count matrix
is cut by the middle character into ``SHARDS`` parts, each a compressed payload.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

SHARDS = 32
START, END = 0x1FFFFE, 0x1FFFFF  # beyond Unicode
BITS = np.uint64(21)
LOW = np.uint64((1 << 21) - 1)
PAIR = np.uint64((1 << 42) - 1)


def shard_of(middle: np.ndarray) -> np.ndarray:
    return ((middle.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(16)) % np.uint64(SHARDS)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct trigrams, counts) of a text between two starts and an end."""
    points = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    padded = np.concatenate([[START, START], points, [END]]).astype(np.uint64)
    keys = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << BITS) | padded[2:]
    return np.unique(keys, return_counts=True)


def pack(keys: np.ndarray, index: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> bytes:
    """``index`` numbers ``keys``, rising within a document; ``ends`` closes each document."""
    starts = np.concatenate([[0], ends[:-1]])
    steps = np.diff(index, prepend=0).astype(np.int64)
    first = starts[starts < ends]
    steps[first] = index[first]
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[small == 255].astype("<u4")
    parts = [keys.astype("<u8"), ends.astype("<u4"), large, small]
    head = struct.pack("<4I", *(len(p) for p in parts))
    body = steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # byte planes
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts) + body)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, index, document of each entry, counts)."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n_keys, n_docs, n_large, n = struct.unpack_from("<4I", raw)
    at = 16
    keys = np.frombuffer(raw, "<u8", n_keys, at)
    ends = np.frombuffer(raw, "<u4", n_docs, at := at + 8 * n_keys).astype(np.int64)
    large = np.frombuffer(raw, "<u4", n_large, at := at + 4 * n_docs)
    counts = np.frombuffer(raw, np.uint8, n, at := at + 4 * n_large).astype(np.int64)
    counts[counts == 255] = large
    steps = np.frombuffer(raw, np.uint8, 4 * n, at + n).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(ends, prepend=0))
    total = np.cumsum(steps)
    starts = np.concatenate([[0], ends[:-1]])
    before = np.concatenate([[0], total])[starts]
    return keys, total - before[doc], doc, counts


def block_parts(texts: list[str | None]):
    """(sizes of the documents, payload per shard or None) of one block."""
    found = [trigrams(t) for t in texts]
    sizes = [int(c.sum()) for _, c in found]
    keys = np.concatenate([k for k, _ in found])
    counts = np.concatenate([c for _, c in found])
    doc = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    shard = shard_of((keys >> BITS) & LOW)
    payloads: list[bytes | None] = []
    for number in range(SHARDS):
        mine = shard == number
        if not mine.any():
            payloads.append(None)
            continue
        own, index = np.unique(keys[mine], return_inverse=True)
        ends = np.cumsum(np.bincount(doc[mine], minlength=len(found)))
        payloads.append(pack(own, index, ends, counts[mine]))
    return sizes, payloads
