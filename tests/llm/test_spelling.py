"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from llm.cases import DOCUMENTS, frame, rows_of
from sparkwarden.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_forms(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, form[w], len(near[w]), counts[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_forms_equal_brute_force_on_dense_words(spark):
    source = random.Random(5)
    counts = {}
    for _ in range(1500):  # few letters: many near words, runs of equal letters, ties
        word = "".join(source.choice("abé") for _ in range(source.randint(6, 8)))
        counts[word] = 5 * 5 ** source.randint(0, 5) + source.randint(0, 1)
    got = spelling.spelling_forms(words_of(spark, counts))
    assert got.columns == ["word", "n", "form", "n_near", "form_n", "root"]
    assert rows_of(got) == brute_forms(counts)


def test_long_chains_ranges_and_no_words(spark):
    chain = {"a" * (6 + i): 5 ** (i + 1) for i in range(12)}
    alphabet = {f"word{chr(c)}word": 5 + c for c in [*range(97, 123), *range(0xC0, 0x100)]}
    counts = chain | alphabet | {"wordword": 10_000, "solitary": 7}
    assert rows_of(spelling.spelling_forms(words_of(spark, counts))) == brute_forms(counts)
    assert spelling.spelling_forms(words_of(spark, counts).where("false")).count() == 0


def test_documents_equal_brute_force(spark):
    source = random.Random(8)
    stems = ["alphabet", "Größere", "colour", "color", "MAISON", "maisons", "straße", "naïveté", "×÷×÷×÷×"]
    texts = [" ".join(source.choice(stems) for _ in range(400)) for _ in range(40)]
    rows = [*DOCUMENTS, *((100 + i, t) for i, t in enumerate(texts)), (None, texts[0]), (100, texts[0])]
    counts = brute_counts(rows)
    assert len(counts) > 30 and any(f is not None for _, _, f, *_ in brute_forms(counts))
    assert rows_of(spelling.variants(frame(spark, rows).withColumn("word", F.lit(1)))) == brute_forms(counts)
    assert spelling.variants(frame(spark).where("false")).count() == 0
