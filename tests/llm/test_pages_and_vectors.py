"""WARC round trips and exact search against brute force."""

import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cases import rows_of
from sparkwarden.llm import exact_topk, warc
from sparkwarden.llm.ball_tree import BallTree, inner_products
from sparkwarden.llm.exact_topk import top_k
from sparkwarden.shared import kept

BIG = "<p>" + "grün " * 400 + "</p>"
PAGES = [
    (1, "http://a.example/ x", BIG),
    (2, None, BIG),
    (9, "http://a.example/\r\ninjected: 1", BIG),
    (9, "http://again.example/", BIG),
    (None, "http://no.id/", BIG),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "small"),
    (6, "u", "small"),
    (-7, "u", "x" * 1000),
    (-8, "u", "x" * 1000),
    (None, "u", "y" * 2000),
    (None, "v", "y" * 2000),
    (10, "u", "\r\n\r\n" * 600 + "WARC/1.1"),
    (11, "u", "z" * 300_000),
]


def pages(spark):
    rows = [(*p, "clash", 5) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, record_type int")


def test_archives_give_the_pages_back(spark):
    groups = {}
    for page_id, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page_id)
    want = []
    for data, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(data) >= 1000 and first is not None and i != first
            kind = "revisit" if again else "response"
            want.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, first if again else None))
    got = warc.archived(pages(spark))
    assert rows_of(got.drop("url")) == sorted(want, key=repr)
    assert warc.archived(pages(spark).where("false")).count() == 0


def test_members_are_plain_gzip_and_damage_is_seen():
    records = [warc.page_record(i, "http://x/", bytes([65 + i]) * 5000, "response", None, "2020") for i in range(3)]
    data = b"".join(records)
    assert gzip.decompress(records[1]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert [warc.page_of(r)["page_id"] for r in warc.read_records(io.BytesIO(data))] == [0, 1, 2]
    with pytest.raises(warc.DamagedRecord):
        list(warc.read_records(io.BytesIO(data[:-5])))
    plain = gzip.decompress(records[0])
    for broken in (
        plain.replace(b"AAAA", b"AAAB", 1),
        plain.replace(b"\r\n\r\n", b"\r\n\r\nmore", 1),
        plain[:-6] + plain[-4:],
    ):
        with pytest.raises(warc.DamagedRecord):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))


def brute(rows, k):
    usable = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in vector)))
    out = []
    for query_id, query in {u for u in usable if u[0] % 50 == 0}:
        scores = [
            (-sum(a * b for a, b in zip(query, v)), i)
            for i, v in usable
            if i != query_id and len(v) == len(query)
        ]
        out += [(query_id, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    source = np.random.default_rng(4)
    rows = [(i, source.normal(0, 0.3, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(7, rows[7][1]), (50, rows[50][1])]  # repeated rows
    rows += [(-100, [0.25] * 8), (401, None), (402, [None] * 8), (403, [float("nan")] * 8)]
    rows += [(404, [float("inf")] + [0.0] * 7), (None, [9.0] * 8), (450, []), (451, []), (500, [1.0])]
    rows += [(600, [2.0**60, -(2.0**60)]), (601, [2.0**60, 1.0])]
    frame = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<float>, dim int, shard int")
    want = [r for r in brute(rows, 5) if abs(r[3]) < 2**63]
    got = top_k(frame, frame.where("vec_id % 50 = 0"), 5, shard=32, block=2)
    small = got.where(F.abs("score") < F.lit(2**62))
    assert rows_of(small) == sorted((r for r in want if abs(r[3]) < 2**62), key=repr)
    assert got.where("query_id = 600").first().score == 2**63 - 1  # held at the end of the range
    none = frame.where("false")
    assert top_k(none, none, 5).count() == 0 and top_k(frame, none, 5).count() == 0


def test_vectors_travel_one_to_a_row(spark, monkeypatch):
    stored, source = [], np.random.default_rng(5)
    monkeypatch.setattr(exact_topk, "kept", lambda frame, purpose: stored.append(frame) or kept(frame, purpose))
    rows = [(i, source.normal(0, 0.3, 4).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(frame, frame.where("vec_id % 50 = 0"), 5, shard=16, block=1)  # many groups and parts
    assert rows_of(got) == sorted(brute(rows, 5), key=repr)
    # A table of trees or blocks, megabytes to a row, is read thousands of rows at once.
    assert stored and not any(kind == "binary" for frame in stored for _, kind in frame.dtypes)


def test_bounds_cut_nodes_without_losing_answers():
    source = np.random.default_rng(6)
    vectors = np.floor(source.normal(0, 50, (2000, 5)))
    tree = BallTree.build(np.arange(2000), vectors)
    queries = np.floor(source.normal(0, 50, (20, 5)))
    lowest = np.full(20, np.iinfo(np.int64).min)
    scores, ids = tree.search(np.full(20, -1), queries, lowest, 3)
    want = -np.sort(-inner_products(queries, vectors), axis=1)[:, :3]
    assert (scores == want).all()
    assert (inner_products(queries, vectors)[np.arange(20)[:, None], ids] == scores).all()
    again, _ = tree.search(np.full(20, -1), queries, want[:, 2], 3)  # a shared kth score
    assert (again == want).all()
