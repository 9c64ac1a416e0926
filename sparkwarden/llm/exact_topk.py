"""Exact top-k inner-product search with a ball tree per shard.

Candidates are dealt into groups of a few shards, queries into parts of many blocks. First
every block of queries searches one shard; the kth scores it finds go with the queries to
all groups, where whatever cannot reach them is cut off before it is scored, and every shard
raises them for the next one of its group. The best of all groups are merged per query, at
most k rows from each. Vectors travel one to a row and trees are built where they are
searched: a tree in a row has megabytes, and readers and Arrow take thousands of rows at once.

Components become floor(256 * x). Given results: vectors that are null or hold a null,
NaN or infinite component, and rows without id, take no part. Only vectors of one
length are compared (an empty one scores 0 with another). Rows with the query's id are
its own; rows repeating id and vector are one query, as candidates they all count.
Ties go to the smaller id. Scores beyond 64 bits stay at the end of the range. Queries
without candidates, and empty tables, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.ball_tree import LOWEST, BallTree
from sparkwarden.shared import kept

SHARD = 4096  # candidates of a tree
BLOCK = 1024  # queries that search one shard first
SHARDS = 4  # of a group
BLOCKS = 16  # of a part

FOUND = "query long, query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).max


def usable(embeddings: DataFrame) -> DataFrame:
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite).withColumn("dim", F.size("embedding"))


def _whole(table: pa.Table) -> np.ndarray:
    dim = table.column("dim")[0].as_py()
    values = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table.column("embedding").chunks]
    return np.floor(256 * np.concatenate(values)).reshape(len(table), dim)


def _searched(queries: pa.Table, candidates: pa.Table, k: int, shard: int):
    """(scores, ids) of the k best candidates of every query, found tree by tree."""
    query_ids, asked = queries.column("query_id").to_numpy(), _whole(queries)
    least = queries.column("least").to_numpy()
    scores = np.full((len(queries), k), LOWEST, dtype=np.int64)
    ids = np.full((len(queries), k), NONE, dtype=np.int64)
    for start in range(0, len(candidates), shard):
        rows = candidates.slice(start, shard)
        tree = BallTree.build(rows.column("vec_id").to_numpy(), _whole(rows))
        here = tree.search(query_ids, asked, least, k)
        both = [np.concatenate(pair, axis=1) for pair in zip((scores, ids), here)]
        best = np.lexsort((both[1], ~both[0]), axis=1)[:, :k]
        scores, ids = (np.take_along_axis(of, best, axis=1) for of in both)
        least = np.maximum(least, scores[:, k - 1])
    return scores, ids


def _dealt(number: str, count: int):
    return F.pmod(F.xxhash64(number), F.lit(count))


def _each(count: int):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))


def _seeded(asked: DataFrame, rows: DataFrame, shards: int, blocks: int, k: int, shard: int) -> DataFrame:
    """Queries with the kth scores of one shard each. Blocks take the shards in turn."""
    queries = asked.withColumn("block", _dealt("query", blocks))
    taken = rows.withColumn("shard", _dealt("vec_id", shards)).where(F.col("shard") < blocks)
    taken = taken.withColumn("block", F.explode(F.sequence("shard", F.lit(blocks - 1).cast("long"), F.lit(shards).cast("long"))))

    def seed(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        least = queries.column("least")
        if len(queries) and len(candidates):
            least = pa.array(_searched(queries, candidates, k, shard)[0][:, k - 1])
        return queries.drop_columns(["least", "block"]).append_column("least", least)

    keys = ("dim", "block")
    return queries.groupBy(*keys).cogroup(taken.drop("shard").groupBy(*keys)).applyInArrow(seed, asked.schema)


def _found(asked: DataFrame, rows: DataFrame, groups: int, parts: int, k: int, shard: int) -> DataFrame:
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not len(queries) or not len(candidates):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        scores, ids = _searched(queries, candidates, k, shard)
        which, place = np.nonzero(ids != NONE)
        numbers = (queries.column(n).to_numpy()[which] for n in names[:2])
        return pa.table([pa.array(x) for x in (*numbers, ids[which, place], scores[which, place])], names)

    keys = ("dim", "group", "part")
    sent = asked.withColumn("part", _dealt("query", parts)).withColumn("group", _each(groups))
    met = rows.withColumn("group", _dealt("vec_id", groups)).withColumn("part", _each(parts))
    return sent.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(search, FOUND)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query. Both tables
    have vec_id and embedding."""
    rows = usable(candidates)
    once = usable(queries).dropDuplicates(["vec_id", "embedding"]).withColumnRenamed("vec_id", "query_id")
    numbered = once.select(F.monotonically_increasing_id().alias("query"), "*", F.lit(int(LOWEST)).cast("long").alias("least"))
    asked = kept(numbered, "queries")
    shards, blocks = max(1, ceil(rows.count() / shard)), max(1, ceil(asked.count() / block))
    seeded = kept(_seeded(asked, rows, shards, blocks, k, shard), "seeded-queries")
    found = _found(seeded, rows, ceil(shards / SHARDS), ceil(blocks / BLOCKS), k, shard)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
