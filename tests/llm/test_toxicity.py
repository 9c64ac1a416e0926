"""The toxicity model: counts and fit against direct ones, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cases import DOCUMENTS, LONG, frame, sentence
from sparkwarden.llm import toxicity

BAD = ["grumblefoul", "snarlwort", "véxblight"]


def corpus(size=900):
    source = random.Random(2)
    rows, labels = [], []
    for i in range(100, 100 + size):
        text, toxic = sentence(i, source.randint(5, 150)), i % 7 == 0
        if toxic:
            words = text.split()
            words.insert(source.randint(0, len(words)), source.choice(BAD).title())
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def as_labels(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3


@pytest.mark.parametrize("text", ["", "a", "Ab", "größer 😀 Größer", LONG])
def test_buckets_of_long_texts_do_not_depend_on_slices(text, monkeypatch):
    whole = toxicity.present(text)
    lowered = f" {text.lower()} "
    grams = {lowered[i : i + n] for n in toxicity.ORDERS for i in range(len(lowered) - n + 1)} if text else set()
    assert len(grams) * 0.97 <= len(whole) <= len(grams)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert toxicity.present(text).tolist() == whole.tolist()
    slots = toxicity._slots(whole[::2])
    assert toxicity.present(text, slots).tolist() == list(range(len(whole[::2])))


def test_counts_equal_brute_force_and_skip_the_held_out(spark):
    rows, labels = corpus(60)
    extra = [(100, 1, None), (101, 0, 1), (101, 0, 0), (None, 1, 1), (5, 1, 1)]
    docs = frame(spark, [*rows, *DOCUMENTS, rows[0]])
    known = toxicity.labelled(docs.select("doc_id", "text"), as_labels(spark, labels + extra))
    want, sums = {}, {}
    toxic = {i: t for i, _, t in labels} | {101: 1, 5: 1}
    for doc_id, text in [*rows, *DOCUMENTS, rows[0]]:
        if doc_id in toxic and fold(doc_id) != 1:
            for bucket in [-1, *toxicity.present(text).tolist()]:
                want.setdefault(bucket, [0, 0])[1 - toxic[doc_id]] += 1
    for row in toxicity.document_counts(known).collect():
        sums[row.bucket] = [row.toxic, row.other]
    assert sums == want


def test_fit_is_the_optimum():
    source = np.random.default_rng(4)
    flags = source.random((400, 30)) < 0.3
    toxic = (flags[:, 0] | (source.random(400) < 0.1)).astype(int)
    ratio = source.normal(size=30)
    weights, intercept = toxicity.fitted(np.packbits(flags, axis=1), toxic, ratio, (3000, 500))
    each = np.array([3000 / (toxic == 0).sum(), 500 / (toxic == 1).sum()])[toxic] * 400 / 3500
    chance = 1 / (1 + np.exp(-(flags @ weights + intercept)))
    slope = (each * (chance - toxic)) @ (flags * ratio) + toxicity.PENALTY * weights / ratio
    assert np.abs(slope).max() < 0.05 and abs(each @ (chance - toxic)) < 0.05


def test_held_out_accuracy_and_inputs(spark):
    rows, labels = corpus()
    docs, known = frame(spark, rows + DOCUMENTS), as_labels(spark, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert set(got) == {i for i, _ in rows + DOCUMENTS}
    assert all(r.held_out == (fold(i) == 1) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [i for i, *_ in labels if fold(i) == 1]
    wrong = [i for i in held if got[i].predicted != (i % 7 == 0)]
    assert len(held) > 200 and len(wrong) <= 0.02 * len(held)
    assert got[1].score == got[2].score and 0 < got[1].score < 0.7
    # other columns, and labels of held-out rows, change nothing
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("bad"))
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(other, flipped).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9) for i, r in got.items())


@pytest.mark.parametrize("kind", ["none", "one class", "empty"])
def test_without_a_model(spark, kind):
    _, labels = corpus(30)
    known = as_labels(spark, labels)
    known = known.where("toxic = 0") if kind == "one class" else known.where("false") if kind == "none" else known
    docs = frame(spark, corpus(30)[0]) if kind != "empty" else frame(spark).where("false")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == (0 if kind == "empty" else 30)
    assert all(r.predicted == 0 and (r.score == 0.5 if kind == "none" else 0 < r.score < 0.1) for r in got)


def test_sample_is_bounded_and_keeps_both_classes(spark):
    rows, labels = corpus(300)
    known = toxicity.labelled(frame(spark, rows + rows).select("doc_id", "text"), as_labels(spark, labels))
    some = toxicity.sampled(known, sample=20).groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in some} == {0: 10, 1: 10}
