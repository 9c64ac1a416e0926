"""SimHash near-duplicate classes with bit-sliced comparison.

Equal fingerprints become one row first. A link of at most ``radius`` bits leaves at
least ``shared`` of ``radius + shared`` bit blocks equal, so fingerprints meet once per
choice of ``shared`` blocks, keyed by those blocks' bits: no link is lost. Keys with
more than ``TILE`` members are split into tiles and every pair of tiles becomes a group
of its own, so no group exceeds about two tiles. Groups are compared by bit planes
(``bit_slices``) and give a spanning star, never all their pairs.

Words are runs of non-blank characters after lower-casing A-Z. Each run of ``words``
words, repeats included and joined by spaces, is hashed by XXH64 (seed 42); a
fingerprint bit is set when over half of the hashes have it.

Given results: documents with fewer words hash their whole sequence; documents without
words (null, empty, blank) have fingerprint zero and are linked like any other. Every
row, repeated or not, gets its class; null doc_ids are ignored in the smallest id of
a class, which is null only where all are. Empty tables give no rows. Extra columns are
ignored, except that ``deduplicated`` carries the documents' own columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import shingle_sets
from sparkwarden.llm.batches import bounded
from sparkwarden.llm.bit_slices import linked_roots
from sparkwarden.llm.components import components
from sparkwarden.shared import kept

TILE = 512
SEED = 42
HASHES = 1 << 16  # hashes counted at a time
LANES = 1 << 15  # fingerprints compared at a time


def fingerprint(text: bytes | None, words: int) -> int:
    tokens = text.lower().split() if text else []  # bytes: ASCII case and ASCII blanks only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    begin, end = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(begin), HASHES):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begin[at : at + HASHES], end[at : at + HASHES])]
        table = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (the 64 bits as a signed long)."""
    names = [c for c in docs.columns if c != "text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = batch.column("text").to_pylist()
            values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], [*names, "fp"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(hashed, f"{fields}fp long")


def _keys(radius: int, shared: int):
    """One long per choice of blocks: the choice's number and the chosen bits, hashed."""
    borders = np.linspace(0, 64, radius + shared + 1).round().astype(int).tolist()
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(borders[:-1], borders[1:])]
    for number, blocks in enumerate(combinations(masks, shared)):
        mask = sum(blocks)
        signed = mask - (1 << 64) if mask >> 63 else mask
        yield F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(signed)))


def _stars(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges that connect what the groups of ``fps`` link."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # groups of like size together: a small group costs few shifts
            order = np.lexsort((owner, np.repeat(sizes, sizes)))
            values, owner = values[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
            at = 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(first, first[at] + LANES, "right")) - 1)
                begin, end = first[at], first[to] if to < len(first) else len(values)
                part = values[begin:end]
                roots = linked_roots(part, owner[begin:end], radius)
                moved = np.flatnonzero(roots != np.arange(len(part)))
                sides = [part[moved].view(np.int64), part[roots[moved]].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])
                at = to

    return groups.select("fps").mapInArrow(link, "a long, b long")


def links(distinct: DataFrame, radius: int, shared: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect every class; ``distinct``
    has each fingerprint once in ``fp``."""
    keyed = distinct.select("fp", F.explode(F.array(*_keys(radius, shared))).alias("key"))
    counts = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(counts, "key")
    tiles = F.ceil(F.col("count") / tile).cast("int")
    own = F.when(F.col("tiles") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.expr("sequence(0, tiles - 1)"))
    paired = (
        met.withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", other)
        .select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "fp")
    )
    groups = paired.groupBy("key", "t", "u").agg(F.collect_list("fp").alias("fps"))
    return _stars(groups.where(F.size("fps") > 1), radius)


def classes(distinct: DataFrame, radius: int, shared: int) -> DataFrame:
    """``distinct`` (stored, each fingerprint once in ``fp``) with the root of its class."""
    roots = components(links(distinct, radius, shared)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, shared: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id for every row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    prints = kept(fingerprints(narrow, words), "prints")
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("own_id")), "fingerprints")
    rooted = kept(classes(distinct, radius, shared), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("own_id").alias("first_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "first_id"), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first_id").alias("component_id"),
    )


def close_sets(distinct: DataFrame, radius: int = 4, shared: int = 2) -> DataFrame:
    """Pairs (a, b) of sets, a < b, that connect the sets in each class of fingerprints: from
    ``links`` between different fingerprints (``print``), one set each, and from equal ones.
    ``distinct`` has each set once in ``fp`` with its size ``n``; empty sets take no part."""
    sets = distinct.where("n > 0").select("fp", "print")
    owners = kept(sets.groupBy("print").agg(F.min("fp").alias("own")), "prints-of-sets")
    stars = links(owners.select(F.col("print").alias("fp")), radius, shared).distinct()
    far = stars.join(owners.toDF("a", "x"), "a").join(owners.toDF("b", "y"), "b")
    equal = sets.join(owners, "print").where("fp <> own").select(F.col("own").alias("x"), F.col("fp").alias("y"))
    pairs = far.select("x", "y").unionByName(equal)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id (null ids
    last), among equal ids the one with the smallest hash of its text. Rows stay as they
    were.

    Classes are the components of the links between documents whose sets of five-word
    shingles have a Jaccard similarity of at least 0.8. Candidates are what the bit-sliced
    SimHash of the sets links (``close_sets``) and, as that misses many pairs at 0.8, what
    meets in ``shingle_sets`` besides; all are compared exactly. Documents without words are
    one class."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("digest"))
    prints = kept(shingle_sets.shingle_sets(narrow, words), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    named = prints.groupBy("fp").agg(F.min(own).alias("own"), *(F.first(c).alias(c) for c in ("n", "keys", "sig", "print")))
    distinct = kept(named, "fingerprints")
    close = kept(close_sets(distinct), "close-sets")
    roots = components(shingle_sets.links(distinct, narrow, words, close)).withColumnRenamed("node", "fp")
    rooted = distinct.select("fp", "own").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("own").alias("own")).select("own.doc_id", "own.digest")
    chosen = kept(chosen.toDF("c_id", "c_digest"), "chosen")
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("c_id")) & (digest == F.col("c_digest"))
    # By hash at every size, so that disk and time follow the input evenly; AQE splits skew.
    rows = docs.join(chosen.hint("shuffle_hash"), same, "left_semi")
    # Rows that repeat both id and text would all stay; only then the rows are compared.
    unique = prints.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    return rows if unique else rows.dropDuplicates(["doc_id", "text"])
