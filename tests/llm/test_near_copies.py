"""SimHash classes and benchmark spans against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.cases import DOCUMENTS, LONG, frame, rows_of, sentence
from sparkwarden.llm import bit_slices, decontamination, phrase_index, simhash
from sparkwarden.llm.components import components

BLANK = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text, width):
    words = BLANK.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius, same=None):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius and (same is None or same[i] == same[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_slices_equal_plain_distances(radius):
    source = np.random.default_rng(radius)
    base = source.integers(0, 2**63, 8, dtype=np.uint64)
    flips = np.uint64(1) << source.integers(0, 64, (8, 20, 4)).astype(np.uint64)
    values = (base[:, None] ^ np.bitwise_or.reduce(flips, axis=2)).ravel()
    values = np.concatenate([values, np.array([0, 2**64 - 1], dtype=np.uint64)])
    source.shuffle(values)
    groups = np.sort(source.integers(0, 5, len(values)))
    got = bit_slices.linked_roots(values, groups, radius).tolist()
    want = brute_roots([int(v) for v in values], radius, groups.tolist())
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, i) for i in range(101, 150)]
    edges = spark.createDataFrame([*chain, *hub, (500, 500), (7, 6), (300, 299)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 150)}) == 1
    assert len(set(roots.values())) == 3 and 500 not in roots
    assert components(edges.where("false")).count() == 0


def test_classes_equal_brute_force(spark):
    near = [(1000 + i, sentence(7, 200) + f" word{i}") for i in range(30)]
    rows = [*DOCUMENTS, *near]
    prints = [brute_print(t, 4) for _, t in rows]
    roots = brute_roots(prints, 4)
    smallest = {}
    for (doc_id, _), root in zip(rows, roots):
        if doc_id is not None:
            smallest[root] = min(smallest.get(root, doc_id), doc_id)
    want = [(d, f"{p:016x}", smallest.get(r)) for (d, _), p, r in zip(rows, prints, roots)]
    assert rows_of(simhash.near_duplicates(frame(spark, rows))) == sorted(want, key=repr)
    assert simhash.near_duplicates(frame(spark).where("false")).count() == 0


def test_tiles_lose_no_link(spark):
    source = np.random.default_rng(2)
    center = source.integers(0, 2**63, dtype=np.uint64)
    values = np.unique(center ^ np.bitwise_or.reduce(np.uint64(1) << source.integers(0, 64, (60, 3)).astype(np.uint64), axis=1))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = brute_roots([int(v) for v in values], 4)
    for tile in (4, 512):
        roots = {r.node: r.root for r in components(simhash.links(prints, 4, 2, tile)).collect()}
        got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
        assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_one_document_of_each_class_stays(spark):
    docs = frame(spark).withColumn("fp", F.lit("taken")).withColumn("digest", F.lit(1))
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns
    prints = [brute_print(t, 5) for _, t in DOCUMENTS]
    roots = brute_roots(prints, 7)
    kept = left.select("doc_id", "text").collect()
    assert len(kept) == len(set(roots))
    place = {(d, t): r for (d, t), r in zip(DOCUMENTS, roots)}
    assert {place[tuple(r)] for r in kept} == set(roots)
    by_root = {}
    for (d, _), r in zip(DOCUMENTS, roots):
        by_root.setdefault(r, []).append(d)
    for r in kept:
        ids = [d for d in by_root[place[tuple(r)]] if d is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_links_are_shingle_similarities(spark):
    """Near copies over and under 0.8, a chain of them, and a large group with strays."""

    def edited(seed, changes, words=200):
        text = sentence(seed, words).split()
        for at in range(changes):
            text[3 + at * (words // max(changes, 1))] = f"edit{seed}x{at}"
        return " ".join(text)

    rows = [(i, edited(50 + i // 12, i % 12)) for i in range(240)]
    rows += [(1000 + i, sentence(7, 200) + f" word{i}") for i in range(60)]
    source = sentence(8, 400).split()
    rows += [(2000 + i, " ".join(source[i * 15 : i * 15 + 200])) for i in range(13)]
    sets = []
    for _, text in rows:
        words = BLANK.findall(text.translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[find(i)][0] for i in range(len(rows))}
    assert 20 < len(want) < 200
    assert {r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()} == want


def test_phrase_index_finds_every_place():
    source = np.random.default_rng(5)
    for symbols in (2, 3, 9):
        text = source.integers(0, symbols, 400)
        index = phrase_index.PhraseIndex(text, symbols)
        lengths = source.integers(1, 6, 50)
        phrases = source.integers(1, symbols, (50, 6))
        low, high = index.ranges(phrases, lengths)
        number, place = index.locate(low, high)
        got = sorted(zip(number.tolist(), place.tolist()))
        want = sorted(
            (p, i) for p in range(50) for i in range(401 - lengths[p])
            if (text[i : i + lengths[p]] == phrases[p, : lengths[p]]).all()
        )
        assert got == want


ITEMS = [
    (1, " ".join(LONG.split()[100:130])),
    (2, "Epsilon short-item"),
    (3, None),
    (4, "... !"),
    (5, " ".join(LONG.split()[100:112])),
    (None, " ".join(LONG.split()[200:230])),
    (7, "größer als"),
    (10, " ".join(LONG.split()[100:130]).upper()),
]


def brute_contamination(rows):
    phrases = {}
    for item, text in ITEMS:
        words = WORD.findall((text or "").translate(LOWER))
        for at in range(max(1, len(words) - 9) if words else 0):
            phrases.setdefault(tuple(words[at : at + 10]), set()).update([] if item is None else [str(item)])
    out = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for size in {len(p) for p in phrases}:
            for at in range(len(words) - size + 1):
                found = phrases.get(tuple(words[at : at + size]))
                if found is not None:
                    hit |= set(range(at, at + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_contamination_equals_brute_force(spark, block_bytes):
    rows = [*DOCUMENTS, (30, "x epsilon SHORT item y " + ITEMS[0][1] + " z")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.contamination(frame(spark, rows), items, block_bytes=block_bytes)
    assert rows_of(got.drop("spans")) == brute_contamination(rows)
    assert decontamination.contamination(frame(spark).where("false"), items).count() == 0
    clean = decontamination.contamination(frame(spark, rows), items.where("false")).where("contaminated")
    assert clean.count() == 0


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_spans_are_cut_from_the_text(spark, block_bytes):
    rows = [(1, "Keep, this " + ITEMS[0][1] + "; and that."), (2, None), (3, "untouched")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, rows)
    left = decontamination.decontaminated(docs, items, block_bytes=block_bytes)
    assert left.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert got == {1: ("Keep, this ; and that.", 22), 2: (None, 0), 3: ("untouched", 9)}
    assert decontamination.contamination(left, items).where("contaminated").count() == 0


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_passages_of_items_without_id_are_cut(spark, block_bytes):
    nameless = ITEMS[5][1]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, [(1, f"Keep, {nameless}; and {ITEMS[0][1]} that.")])
    left = decontamination.decontaminated(docs, items, block_bytes=block_bytes)
    assert [(r.text, r.n_chars) for r in left.collect()] == [("Keep, ; and  that.", 18)]


def test_documents_that_share_a_passage_make_no_pairs(spark):
    from sparkwarden.llm import shingle_sets

    passage = sentence(70, 60)
    apart = [(i, f"{passage} {sentence(1000 + i, 60)}") for i in range(300)]
    near = [(2000 + i, sentence(71, 200) + f" {sentence(3000 + i, 4)}") for i in range(60)]
    sets = {i: set(shingle_sets.shingle_set(t.encode(), 5).tolist()) for i, t in apart + near}
    assert 0.2 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.6
    docs = frame(spark, apart + near).select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
    prints = shingle_sets.shingle_sets(docs.withColumn("root", F.col("doc_id")), 5)
    marked = prints.withColumn("key", F.lit(1)).withColumn("members", F.lit(len(apart + near)))
    whole = shingle_sets.shingle_sets(docs, 5, whole=True).select("fp", "hashes")
    names = {r.fp: r.doc_id for r in prints.collect()}
    pairs = [(a, b) for a, _ in near for b, _ in near if a < b]
    similar = [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    assert len(similar) > 1000
    for tile in (7, 512):
        members = shingle_sets.tiled(marked, tile)
        met = {names[r.fp] for r in shingle_sets.agreeing(members).collect()}
        assert {i for p in similar for i in p} <= met <= {i for i, _ in near}
        links = [(names[r.a], names[r.b]) for r in shingle_sets.confirmed(members, whole).collect()]
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
        joined = {i: i for i, _ in near}  # the links connect what the similar pairs connect
        for a, b in links:
            old, new = joined[a], joined[b]
            joined = {i: new if r == old else r for i, r in joined.items()}
        assert all(joined[a] == joined[b] for a, b in similar)
        assert len(links) < 2000 if tile == 7 else len(links) < len(near)


def test_one_document_of_each_similar_class_stays(spark):
    base = [sentence(80 + i, 120) for i in range(20)]
    rows = [(100 * i + j, t + f" {sentence(500 + 10 * i + j, 3)}") for i, t in enumerate(base) for j in range(6)]
    rows += [(9000, None), (9001, ""), (9002, " ")]
    kept = simhash.deduplicated(frame(spark, rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [100 * i for i in range(20)] + [9000]


def test_deduplication_takes_candidates_of_simhash(spark):
    """Sets that meet in no band, but whose SimHashes are close, are linked."""
    from sparkwarden.llm import shingle_sets

    base = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    near = [*base[:-1], "end"]
    texts = [" ".join(words) for words in (base, near, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow = docs.withColumn("digest", F.xxhash64("text"))
    sets = shingle_sets.shingle_sets(narrow, 5).withColumn("keys", F.array().cast("array<long>"))
    distinct = sets.withColumn("own", F.struct("doc_id", "digest")).localCheckpoint()
    names = {r.fp: r.doc_id for r in distinct.collect()}
    close = simhash.close_sets(distinct)
    pairs = [sorted((names[r.a], names[r.b])) for r in close.collect()]
    assert pairs == [[0, 1]]
    found = shingle_sets.links(distinct, narrow, 5, close.localCheckpoint()).collect()
    assert [sorted((names[r.a], names[r.b])) for r in found] == [[0, 1]]
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [0, 2]
