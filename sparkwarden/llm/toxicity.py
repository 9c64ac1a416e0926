"""Toxicity by a linear model over character n-grams, scaled by naive Bayes log-count ratios.

A text, lowered and between two spaces, holds or lacks each character n-gram of three to
five characters; n-grams are hashed into 2^20 buckets. Over all labelled texts the
documents of each class that hold a bucket are counted, dense in the task, then combined.
The ``FEATURES`` buckets whose presence tells most about the class (log-likelihood ratio G²)
are the model's features, each with its ratio r of the log of smoothed shares of toxic and
other documents. A logistic regression with an L2 penalty over r times presence is then
fitted on at most ``SAMPLE`` labelled documents, half of each class if there are so many
(those with the smallest hashes of their ids), weighted back to the shares of all. Its
matrix is a bitmap of at most ``SAMPLE * FEATURES / 8`` bytes: the only thing the driver
holds. Every whole text is scored; the model sent to tasks has ``FEATURES`` weights.

Given results: null and empty texts have no n-grams and score by the intercept; a null
doc_id is never labelled and, as the empty text, not held out; every repeated row is scored;
of several labels of a doc_id the largest ``toxic`` counts, null labels never; with no
labelled row, or one class only, all texts score the smoothed share of toxic rows, 0.5
without any; an empty table gives no rows. Extra columns are ignored: only text makes a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded, release
from sparkwarden.shared import kept

ORDERS = (3, 4, 5)
BITS = 20
FEATURES = 1024
SAMPLE = 16_384
SMOOTH = 1.0
PENALTY = 2.0
FOLDS, HELD_FOLD = 3, 1
LIMIT = 0.7
SLICE = 1 << 20  # characters hashed at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class Model(NamedTuple):
    buckets: np.ndarray
    weights: np.ndarray  # of the fit, times the log-count ratios
    intercept: float


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, repeats included, in slices."""
    if not text:
        return
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    longest = max(ORDERS)
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + longest - 1]
        starts = min(SLICE, len(points) - at)
        sums = np.zeros(len(part), dtype=np.uint64)
        for order in range(1, longest + 1):
            size = len(part) - order + 1
            if size <= 0:
                break
            sums = sums[:size] * _STEP + part[order - 1 :]
            if order in ORDERS:
                mixed = (sums[:starts] + np.uint64(order)) * _MIX
                yield ((mixed ^ (mixed >> np.uint64(29))) * _STEP >> np.uint64(64 - BITS)).astype(np.int32)


def present(text: str | None, slots: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct buckets of a text, or with ``slots`` (number of each bucket's
    feature, or -1) its features."""
    found = []
    for part in buckets(text):
        if slots is not None:
            part = slots[part]
            part = part[part >= 0]
        found.append(np.unique(part))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


def _slots(chosen: np.ndarray) -> np.ndarray:
    slots = np.full(1 << BITS, -1, dtype=np.int32)
    slots[chosen] = np.arange(len(chosen), dtype=np.int32)
    return slots


def held_out() -> F.Column:
    """Whether the CRC-32 of the doc_id as text leaves the held-out remainder."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(name), F.lit(FOLDS)) == HELD_FOLD


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of the rows that may be learnt from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # By hash at every size, so that disk follows the input evenly; AQE splits skew.
    return docs.where(~held_out()).join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "toxic")


def document_counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, other): documents of each class that hold a bucket. Row -1 holds the
    number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for batch in bounded(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held[toxic, present(text)] += 1
                held[toxic, -1] += 1
        seen = np.flatnonzero(held.any(axis=0))
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            names = np.where(part == 1 << BITS, -1, part).astype(np.int32)
            columns = [pa.array(names), pa.array(held[1, part]), pa.array(held[0, part])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "toxic", "other"])
        del held
        release()

    counted = rows.select("text", "toxic").mapInArrow(count, "bucket int, toxic long, other long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen_features(counts: DataFrame, toxic: int, other: int, features: int = FEATURES) -> DataFrame:
    """(bucket, ratio) of the ``features`` buckets with the greatest G²."""

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * (toxic + other) / (row * column))).otherwise(0.0)

    a, b = F.col("toxic"), F.col("other")
    c, d = toxic - a, other - b
    told = part(a, a + b, F.lit(toxic)) + part(b, a + b, F.lit(other))
    told = told + part(c, c + d, F.lit(toxic)) + part(d, c + d, F.lit(other))
    # smoothed shares of the class's documents that hold the bucket
    ratio = F.log((a + SMOOTH) / (toxic + 2 * SMOOTH)) - F.log((b + SMOOTH) / (other + 2 * SMOOTH))
    scored = counts.where("bucket >= 0").select("bucket", ratio.alias("ratio"), told.alias("told"))
    return scored.where("told > 0").orderBy(F.desc("told"), "bucket").limit(features).select("bucket", "ratio")


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``rows`` of at most ``sample`` doc_ids, each once: of each class those with the
    smallest hashes."""
    names = rows.select("doc_id", "toxic").distinct().withColumn("lot", F.xxhash64("doc_id"))
    sides = [names.where(F.col("toxic") == t).orderBy("lot", "doc_id").limit(sample // 2) for t in (0, 1)]
    some = sides[0].unionByName(sides[1]).select("doc_id")  # at most ``sample`` numbers
    return rows.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def bitmaps(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed presence of the features, toxic) of a bounded number of rows."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots(chosen)
        for batch in bounded(batches):
            out = []
            for text in batch.column("text").to_pylist():
                flags = np.zeros(len(chosen), dtype=bool)
                flags[present(text, slots)] = True
                out.append(np.packbits(flags).tobytes())
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "bits"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(mapped, "doc_id long, toxic int, bits binary")
    table = found.toArrow().sort_by("doc_id")  # in one order, so that sums repeat exactly
    width = (len(chosen) + 7) // 8
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint8)
    return bits.reshape(-1, width), table.column("toxic").to_numpy()


def fitted(bits: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, shares: tuple[int, int]) -> tuple[np.ndarray, float]:
    """(weights, intercept) by Newton steps with conjugate gradients. ``shares`` are the
    numbers of other and toxic documents that the sample stands for."""
    each = np.array([shares[t] / max((toxic == t).sum(), 1) for t in (0, 1)])
    weight = each[toxic] * len(toxic) / sum(shares)
    scale = np.append(ratio, 1.0).astype(np.float32)  # the last column is the intercept
    penalty = np.append(np.full(len(ratio), PENALTY), 1e-6)
    rows = range(0, len(toxic), 1024)

    def block(at: int) -> np.ndarray:
        part = np.unpackbits(bits[at : at + 1024], axis=1, count=len(ratio)).astype(np.float32)
        return np.hstack([part, np.ones((len(part), 1), dtype=np.float32)]) * scale

    def times(vector: np.ndarray, down: bool) -> np.ndarray:
        vector = vector.astype(np.float32)
        if not down:
            return np.concatenate([block(at) @ vector for at in rows]).astype(float)
        return sum((vector[at : at + 1024] @ block(at)).astype(float) for at in rows)

    def loss(margin: np.ndarray, theta: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(toxic == 1, -margin, margin)) + penalty @ theta**2 / 2)

    theta = np.zeros(len(scale))
    margin = np.zeros(len(toxic))
    for _ in range(20):
        chance = 1 / (1 + np.exp(-margin))
        slope = times(weight * (chance - toxic), True) + penalty * theta
        if np.abs(slope).max() < 1e-3 * max(1.0, weight.sum() ** 0.5):
            break
        bend = weight * chance * (1 - chance) + 1e-9
        step, rest = np.zeros_like(theta), -slope
        way, size = rest.copy(), float(rest @ rest)
        first = size
        for _ in range(12):
            push = times(bend * times(way, False), True) + penalty * way
            length = size / float(way @ push)
            step, rest = step + length * way, rest - length * push
            size, was = float(rest @ rest), size
            if size < 0.01 * first:
                break
            way = rest + (size / was) * way
        moved, here, share = times(step, False), loss(margin, theta), 1.0
        while share > 1e-3 and loss(margin + share * moved, theta + share * step) > here:
            share /= 2
        theta, margin = theta + share * step, margin + share * moved
    return theta[:-1] * ratio, float(theta[-1])


def trained(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> Model:
    """The model of all rows of ``docs`` that have a label and are not held out."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = kept(labelled(narrow, labels), "labelled")
    counts = kept(document_counts(rows), "document-counts")
    total = counts.where("bucket = -1").agg(F.sum("toxic"), F.sum("other")).first()
    toxic, other = total[0] or 0, total[1] or 0
    none = np.zeros(0, dtype=np.int32)
    if not toxic or not other:
        return Model(none, none.astype(float), float(np.log((toxic + 0.5) / (other + 0.5))))
    found = sorted(chosen_features(counts, toxic, other, features).collect())  # at most ``features``
    chosen = np.array([r["bucket"] for r in found], dtype=np.int32)
    ratio = np.array([r["ratio"] for r in found], dtype=float)
    bits, known = bitmaps(sampled(rows, sample), chosen)
    weights, intercept = fitted(bits, known, ratio, (other, toxic))
    return Model(chosen, weights, intercept)


def scored(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots(model.buckets)
        for batch in bounded(batches):
            margins = [model.weights[present(t, slots)].sum() for t in batch.column("text").to_pylist()]
            scores = 1 / (1 + np.exp(-(np.array(margins) + model.intercept)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    out = narrow.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score under the model trained on ``labels``."""
    return scored(docs, trained(docs, labels))
