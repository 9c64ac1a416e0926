"""Pairs of shingle sets with a Jaccard similarity of at least 0.8, confirmed exactly.

Candidates meet where one of ``BANDS`` bands of ``ROWS`` minimum hashes is equal: a pair at
0.8 has about 3 in a million to meet nowhere, a more similar one less. First each set is
compared with the smallest of its groups and with what SimHash puts next to it. What that leaves in different components
of a group is looked through by signatures, one byte of each minimum hash; a pair at 0.8
agrees in fewer than ``AGREE`` of them about once in a million. Members that agree with
another one go on with their whole sets, and agreeing pairs are compared exactly. Both
comparisons run inside tasks, in tiles of a group, and give members and links that connect
them, never rows for pairs: what is stored and shuffled grows with the members.

A set is named by the XXH64 of its sorted hashes; two sets are one when their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.components import components
from sparkwarden.shared import kept

BANDS, ROWS = 32, 5
SEED = 42
BLOCK = 4096  # shingles hashed at a time
AGREE = 104  # of BANDS * ROWS
TILE = 512
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)[:, None]
_ODD = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of all runs of ``words`` words (see ``simhash``)."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    begin, end = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end)), dtype=np.uint64, count=len(begin)))


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One key per band, and the signature; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), bytes(BANDS * ROWS)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[at : at + BLOCK] ^ _XOR) * _ODD
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    bands = low.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64), low.astype(np.uint8).tobytes()


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of a set as a signed long: a bit is set when over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        table = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def shingle_sets(docs: DataFrame, words: int, whole: bool = False) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (name of the set), ``n`` (its size) and the
    band ``keys`` with the signature ``sig`` and the SimHash ``print``, or with ``whole`` its
    ``hashes`` instead."""
    names = [c for c in docs.columns if c != "text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            named = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            columns = [*(batch.column(n) for n in names), pa.array(named), sizes]
            if whole:
                last = {"hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}
            else:
                keys, marks = zip(*(band_keys(s) for s in sets))
                last = {"keys": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(marks, pa.binary())}
                last["print"] = pa.array([simhash_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *last.values()], [*names, "fp", "n", *last])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    result = f"{fields}fp long, n int, " + ("hashes array<long>" if whole else "keys array<long>, sig binary, print long")
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(hashed, result)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set names whose Jaccard similarity is at least 0.8."""
    left = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")).hint("merge")
    right = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    # both / (x + y - both) >= 4 / 5, in whole numbers
    return pairs.join(right, "b").join(left, "a").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def candidate_sets(met: DataFrame, distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """fp and hashes of the sets in ``met``: only these are made from their texts again,
    as the hashes of all documents would be larger than their texts."""
    own = distinct.join(met.select("fp").distinct(), "fp", "left_semi").select("own.doc_id", "own.digest")
    own = own.toDF("c_id", "c_digest")
    same = docs["doc_id"].eqNullSafe(F.col("c_id")) & (docs["digest"] == F.col("c_digest"))
    wanted = docs.join(own.hint("shuffle_hash"), same, "left_semi").select("text")
    return shingle_sets(wanted, words, whole=True).groupBy("fp").agg(F.first("hashes").alias("hashes"))


def links(distinct: DataFrame, docs: DataFrame, words: int, close: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets of every class; ``distinct`` (stored) has each
    set once in fp with n, keys and own (doc_id and digest of a row of ``docs``). Pairs
    (a, b) in ``close`` (stored), found by SimHash, are compared exactly with the first ones."""
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    smallest = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("members")).where("members > 1").drop("members")
    met = kept(keyed.join(smallest, "key"), "candidates")
    named = met.select("fp").unionByName(close.select(F.explode(F.array("a", "b")).alias("fp")))
    sets = kept(candidate_sets(named, distinct, docs, words), "sets")
    sizes = met.select(F.col("fp").alias("a"), F.col("n").alias("m")).distinct()
    near = F.least("n", "m") * 5 >= F.greatest("n", "m") * 4
    first = met.where("fp <> a").select("a", F.col("fp").alias("b"), "n").distinct().join(sizes, "a").where(near)
    first = kept(first.select("a", "b").unionByName(close).distinct(), "first-pairs")
    linked = kept(similar(first, sets), "first-links")
    roots = components(linked).withColumnRenamed("node", "fp")
    placed = kept(met.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "placed")
    several = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    several = several.where("low < high").select("key", "members")
    marked = distinct.select("fp", "n", "sig").join(placed.join(several, "key").hint("shuffle_hash"), "fp")
    return linked.unionByName(kept(confirmed(tiled(marked), sets), "second-links"))


def tiled(marked: DataFrame, tile: int = TILE) -> DataFrame:
    """The members of every group, cut into tiles of about ``tile`` where it is larger, with
    every pair of tiles (t, u) a group of its own. ``marked``: key, members (of the key), fp,
    root, n, sig."""
    tiles = F.ceil(F.col("members") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    paired = marked.withColumn("tiles", tiles).withColumn("own", own)
    paired = paired.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    t, u = F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u")
    return paired.select("key", t, u, "own", "fp", "root", "n", "sig")


def _listed(members: DataFrame, columns: list[str]) -> DataFrame:
    groups = members.groupBy("key", "t", "u").agg(F.collect_list(F.struct(*columns)).alias("members"))
    return groups.where(F.size("members") > 1)


class _Group:
    """One group's members as arrays, and which of them agree."""

    def __init__(self, row: pa.RecordBatch):
        self.members = row.column("members").flatten()
        self.key, self.t, self.u = (row.column(c)[0].as_py() for c in ("key", "t", "u"))
        self.fp, self.root, self.n, self.own = (self.members.field(c).to_numpy() for c in ("fp", "root", "n", "own"))
        sig = np.frombuffer(b"".join(self.members.field("sig").to_pylist()), np.uint8)
        self.sig = sig.reshape(len(self.fp), -1)

    def after(self, i: int, root: np.ndarray) -> np.ndarray:
        """Members behind ``i`` of other roots, of like size, whose signature agrees."""
        rest, n = slice(i + 1, None), self.n
        wanted = (root[rest] != root[i]) & (np.minimum(n[rest], n[i]) * 5 >= np.maximum(n[rest], n[i]) * 4)
        if self.t != self.u:
            wanted &= self.own[rest] != self.own[i]
        places = np.flatnonzero(wanted) + i + 1
        return places[(self.sig[places] == self.sig[i]).sum(axis=1) >= AGREE]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[_Group]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Group(batch.slice(i, 1))


_MEMBER = ["own", "fp", "root", "n", "sig"]


def agreeing(members: DataFrame) -> DataFrame:
    """The members of ``tiled`` groups that agree with another one: a row each, no pairs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            met = np.zeros(len(group.fp), dtype=bool)
            for i in range(len(met) - 1):
                places = group.after(i, group.root)
                met[places] = True
                met[i] |= len(places) > 0
            some = group.members.take(pa.array(np.flatnonzero(met)))
            head = [pa.array([v] * len(some), k) for v, k in zip((group.key, group.t, group.u), (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*head, *some.flatten()], ["key", "t", "u", *_MEMBER])

    fields = "key long, t int, u int, own int, fp long, root long, n int, sig binary"
    return _listed(members.withColumn("key", F.col("key").cast("long")), _MEMBER).mapInArrow(found, fields)


def confirmed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of similarity 0.8 or more that connect what they connect in each group:
    agreeing pairs are compared exactly unless links found before already connect them."""
    whole = agreeing(members).join(sets.hint("shuffle_hash"), "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            lists, root, a, b = group.members.field("hashes"), group.root.copy(), [], []
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            own = np.split(values, ends[:-1])
            for i in range(len(root) - 1):
                for j in group.after(i, root).tolist():
                    if root[i] == root[j]:
                        continue
                    both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    if 9 * both >= 4 * (len(own[i]) + len(own[j])):
                        a.append(group.fp[i])
                        b.append(group.fp[j])
                        root[root == root[j]] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _listed(whole, [*_MEMBER, "hashes"]).mapInArrow(linked, "a long, b long")
