"""Best-fit packing of documents into fixed-capacity sequences, certified by bounds.

Pieces are dealt into groups of bounded size. Each group is packed by best-fit
decreasing and its sequence count compared with a lower bound from dual feasible
functions; equality certifies the group. Groups with a gap give back the pieces of
their unfilled sequences, these are dealt anew into fewer groups and packed again,
until the whole count meets the bound of all pieces or a round brings nothing.

Only the histogram of lengths (at most ``capacity`` counts) reaches the driver. No
group grows with the table: its number of pieces is about ``group_pieces``.

Given results: null or empty text is one piece holding the end id alone. Documents
longer than the capacity are cut into capacity-sized pieces, all others stay whole.
Repeated rows are packed as often as they occur; equal lengths may land anywhere. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.tokens import TEXT_BYTES, encoder
from sparkwarden.shared import kept

GROUP_PIECES = 32_768
ROUNDS = 6
PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, fill long, gap long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, ids: bool = False) -> DataFrame:
    """Token pieces of every document. ``row`` numbers the pieces; with ``ids`` the
    ids themselves (little-endian unsigned 32-bit) come along in a binary column."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if ids:
        names, kinds = [*names, "ids"], [*kinds, pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        encode = encoder(tokenizer).encode
        for batch in bounded(batches, size=TEXT_BYTES):
            out: list[list] = [[] for _ in names]
            raws = encode(batch.column("text").to_pylist())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws):
                raw += end
                for number, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    values = (row, doc_id, number, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(out, values):
                        column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(cut, PIECE + (", ids binary" if ids else ""))


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of three dual-feasible-function bounds over a histogram of lengths."""
    if not counts.sum():
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // capacity)
    # Martello and Toth's threshold function: longer than capacity - k counts whole,
    # shorter than k counts nothing.
    for k in np.unique(np.minimum(lengths, capacity - lengths)):
        if k <= 0 or 2 * k > capacity:
            continue
        value = np.where(lengths > capacity - k, capacity, np.where(lengths < k, 0, lengths))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # Fekete and Schepers' rounding function with k steps.
    for k in range(1, 65):
        scaled = (k + 1) * lengths
        exact = scaled % capacity == 0
        value = np.where(exact, lengths * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin. Bins wait in stacks by
    free space; a bit set over the free spaces finds the tightest one that fits."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, free = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = free_bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = waiting[space].pop()
            if not waiting[space]:
                free_bits ^= 1 << space
        else:
            chosen, space = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = chosen, capacity - space
        space -= length
        free[chosen] = space
        if space:
            waiting[space].append(chosen)
            free_bits |= 1 << space
    return bins, offsets, capacity - np.array(free, dtype=np.int64)


def _packed_groups(open_pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        return group.drop(columns="dealt").assign(
            # round, group and bin in one number
            sequence_id=((turn + 1) << 58) + (int(key[0]) << 28) + bins,
            offset=offsets,
            fill=fills[bins],
            gap=len(fills) - bound,
        )

    dealt = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups))
    return open_pieces.withColumn("dealt", dealt).groupBy("dealt").applyInPandas(fit, PLACED)


def _count(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()  # each sequence has one piece at its start


def pack(
    items: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS
) -> DataFrame:
    """Place stored pieces (see ``pieces``): adds sequence_id, offset and fill.

    ``rounds`` limits the work spent on the last few sequences, never what is packed."""
    columns = [c for c in items.columns if c in PIECE.replace(",", "").split()]
    items = items.select(*columns)
    histogram = items.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in histogram}
    whole = items.where(F.col("length") >= capacity).select(
        *columns,
        F.bitwise_not("row").alias("sequence_id"),  # below zero, packed ones above
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("fill"),
    )
    counts.pop(capacity, None)
    bound = lower_bound(np.array([*counts], dtype=np.int64), np.array([*counts.values()], dtype=np.int64), capacity)
    result = [whole]
    loose, n_loose, used, before = items.where(F.col("length") < capacity), sum(counts.values()), 0, None
    for turn in range(rounds):
        groups = max(1, ceil(n_loose / group_pieces))
        placed = kept(_packed_groups(loose, groups, turn, capacity), "packed")
        bins = _count(placed)
        if before is not None and bins >= _count(before):
            result.append(before.drop("gap"))  # the exchange saved nothing: keep what was
            break
        settled = (F.col("gap") == 0) | (F.col("fill") == capacity)
        if used + bins <= bound or turn == rounds - 1:
            result.append(placed.drop("gap"))
            break
        before = placed.where(~settled)
        n_loose = before.count()
        if not n_loose or (groups == 1 and turn):
            result.append(placed.drop("gap"))
            break
        done = placed.where(settled)
        result.append(done.drop("gap"))
        used += _count(done)
        loose = before.select(*columns)
    out = result[0]
    for part in result[1:]:
        out = out.unionByName(part)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **sizes) -> DataFrame:
    """Every piece of ``docs`` with its sequence and place there."""
    return pack(kept(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, **sizes)


def sequences(items: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, ids (binary). ``items``
    are pieces with their ids; a sequence gathers at most ``capacity`` of them."""
    joined = placed.select("row", "sequence_id", "offset").join(items.select("row", "ids"), "row")
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    empty = F.lit(b"")
    return (
        joined.groupBy("sequence_id")
        .agg(members.alias("members"))
        .select(
            "sequence_id",
            F.size("members").alias("n_pieces"),
            F.aggregate("members", empty, lambda left, m: F.concat(left, m["ids"])).alias("ids"),
        )
    )
