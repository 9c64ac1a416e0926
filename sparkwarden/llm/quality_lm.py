"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

One model per language, over characters, from all documents that the labels trust.
Every count (trigrams, their contexts, continuation counts, counts of counts) is a
grouped table, and the interpolated probabilities come from joining those tables.
Documents then meet the model shard by shard: count matrices of document blocks and
the n-grams are joined on (language, shard of the middle character), each side sent
once; a shard holds all a trigram needs to be scored. Blocks of a shard are salted so
that a group stays near ``GROUP_BYTES``; the model part is repeated per salt.

One trusted document in ``HELD_OUT``, by the hash of its id, stays out of the counts. A
document is kept when its perplexity is at most the ``QUANTILE`` of these held-out
documents of its language and length band; bands with fewer than ``LEAST_TRUSTED``
take the language's, languages the corpus's. Quantiles are ``approx_percentile`` with
``ACCURACY``, exact for small strata.

Given results: null text is empty; an empty text has one trigram. Null languages form
a language of their own. Languages without trusted text have no model: perplexity and
threshold are null and their documents are kept. Labels count where any row of the id
has quality 1; null ids match nothing. Repeated rows are scored one by one. Empty
tables give no rows (without labels every document is kept). Extra columns are ignored,
except that ``accepted`` carries the documents' own columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.ngrams import BITS, LOW, PAIR, SHARDS, block_parts, shard_of, unpack
from sparkwarden.shared import kept

QUANTILE = 0.995
HELD_OUT = 5
LEAST_TRUSTED = 50
ACCURACY = 20_000
BANDS = (32, 128, 512)  # lower ends, in trigrams, of all length bands but the first
GROUP_BYTES = 2 << 20
BLOCK_DOCS = 1_000
SALTS = 64

PROFILE = (
    "block long, lang string, shard int, payload binary, doc_ids array<long>, "
    "digests array<long>, sizes array<long>"
)


def profiles(docs: DataFrame) -> DataFrame:
    """Blocks of trigram counts, a row per block and shard; the first shard's row tells
    the documents. ``docs`` has doc_id, text, lang and digest."""
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    schema = pa.schema(list(zip(["block", "lang", "shard", "payload", "doc_ids", "digests", "sizes"], kinds)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in bounded(batches, rows=2 * BLOCK_DOCS, size=8 << 20):
            groups: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                groups.setdefault(lang, []).append(i)
            for lang, all_rows in groups.items():
                for at in range(0, len(all_rows), BLOCK_DOCS):
                    part = batch.take(pa.array(all_rows[at : at + BLOCK_DOCS]))
                    sizes, payloads = block_parts(part.column("text").to_pylist())
                    rows = [
                        {"block": block, "lang": lang, "shard": shard, "payload": payload}
                        for shard, payload in enumerate(payloads)
                        if payload is not None or shard == 0
                    ]
                    rows[0] |= {
                        "doc_ids": part.column("doc_id").to_pylist(),
                        "digests": part.column("digest").to_pylist(),
                        "sizes": sizes,
                    }
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    block += 1

    return docs.select("doc_id", "text", "lang", "digest").mapInArrow(count, PROFILE)


def trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.where("quality = 1 AND doc_id IS NOT NULL")
    ids = known.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)


def _per_language(rows: DataFrame, small: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row per language; a language may hold most
    of the rows, so its rows are spread over ``SALTS`` keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    many = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, ["lang", "salt"], how).drop("salt")


def trigram_counts(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, key, n) over all trusted documents but the held-out ones."""
    members = blocks.where("doc_ids IS NOT NULL").select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    chosen = members.join(trusted_ids(labels).where("NOT held_out"), "doc_id").groupBy("block")
    chosen = chosen.agg(F.collect_list("place").alias("places"))  # at most BLOCK_DOCS

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for row in batch.to_pylist():
                keys, index, doc, counts = unpack(row["payload"])
                wanted = np.isin(doc, row["places"])
                n = np.bincount(index[wanted], weights=counts[wanted], minlength=len(keys)).astype(np.int64)
                sums.setdefault(row["lang"], []).append((keys[n > 0], n[n > 0]))
            for lang, parts in sums.items():
                keys, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(index, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                    ["lang", "key", "n"],
                )

    joined = blocks.where("payload IS NOT NULL").select("block", "lang", "payload").join(chosen, "block")
    counted = joined.select("lang", "payload", "places").mapInArrow(total, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, n: str) -> DataFrame:
    """Per language the three modified Kneser-Ney discounts of a count column."""
    seen = [F.sum((F.col(n) == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def discount(k: int):
        here, above = F.col(f"n{k}"), F.col(f"n{k + 1}")
        raw = k - (k + 1) * y * above / F.when(here > 0, here).otherwise(1.0)
        return F.least(F.greatest(raw, F.lit(0.05)), F.lit(float(k))).alias(f"d{k}")

    return counts.groupBy("lang").agg(*seen).select("lang", *(discount(k) for k in (1, 2, 3)))


def _spent(n: str):
    return F.when(F.col(n) >= 3, F.col("d3")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d1"))


def model(counts: DataFrame) -> DataFrame:
    """(lang, shard, kind, key, value): kind 3, 2, 1 hold the log probability of a seen
    trigram, bigram or character, -3 and -2 the log weight that a context leaves to the
    lower order, 0 the log probability of an unseen character. ``counts`` is stored."""
    u, v, w = "(key >> 42)", "((key >> 21) & 2097151)", "(key & 2097151)"
    tri = counts.selectExpr("lang", f"{u} AS u", f"{v} AS v", f"{w} AS w", "n")
    tri = _per_language(tri, _discounts(tri, "n"), ["u", "v", "w"]).withColumn("spent", _spent("n"))
    bi = tri.groupBy("lang", "v", "w").agg(F.count(F.lit(1)).alias("n"))
    bi = _per_language(bi, _discounts(bi, "n"), ["v", "w"]).withColumn("spent", _spent("n"))
    bi = kept(bi, "bigrams")
    uni = bi.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    uni = _per_language(uni, _discounts(uni, "n"), ["w"]).withColumn("spent", _spent("n"))
    uni = kept(uni, "characters")
    base = uni.groupBy("lang").agg(
        F.sum("n").alias("total"), F.sum("spent").alias("left"), (F.count(F.lit(1)) + 1).alias("size")
    )
    floor = base.withColumn("floor", F.col("left") / F.col("size") / F.col("total"))
    p1 = _per_language(uni, floor, ["w"]).selectExpr("lang", "w", "(n - spent) / total + floor AS p1")
    pairs = bi.groupBy("lang", "v").agg(F.sum("n").alias("total"), F.sum("spent").alias("left"))
    p2 = bi.join(p1, ["lang", "w"]).join(pairs, ["lang", "v"])
    p2 = kept(p2.selectExpr("lang", "v", "w", "(n - spent + left * p1) / total AS p2"), "bigram-model")
    contexts = tri.groupBy("lang", "u", "v").agg(F.sum("n").alias("total"), F.sum("spent").alias("left"))
    p3 = tri.join(p2, ["lang", "v", "w"]).join(contexts, ["lang", "u", "v"])
    p3 = p3.selectExpr("lang", "v", "3 AS kind", f"(u << 42) | (v << 21) | w AS key", "ln((n - spent + left * p2) / total) AS value")
    rows = (
        p3.unionByName(p2.selectExpr("lang", "v", "2 AS kind", "(v << 21) | w AS key", "ln(p2) AS value"))
        .unionByName(contexts.selectExpr("lang", "v", "-3 AS kind", "(u << 21) | v AS key", "ln(left / total) AS value"))
        .unionByName(pairs.selectExpr("lang", "v", "-2 AS kind", "v AS key", "ln(left / total) AS value"))
    )
    shard = F.expr(f"cast(((v * {0x9E3779B1}) >>> 16) % {SHARDS} AS int)")
    everywhere = p1.selectExpr("lang", "1 AS kind", "w AS key", "ln(p1) AS value").unionByName(
        floor.selectExpr("lang", "0 AS kind", "0L AS key", "ln(floor) AS value")
    )
    return rows.select("lang", shard.alias("shard"), "kind", "key", "value").unionByName(
        everywhere.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))), allowMissingColumns=False
    )


class ShardModel:
    """Back-off lookup over the sorted keys of one shard."""

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.tables = {}
        for kind in (3, 2, 1, -3, -2):
            own = kinds == kind
            order = np.argsort(keys[own])
            self.tables[kind] = keys[own][order], values[own][order]
        self.floor = values[kinds == 0][0]

    def _get(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind]
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        key = key.astype(np.uint64)
        middle, last = (key >> BITS) & LOW, key & LOW
        seen, value = self._get(1, last.astype(np.int64))
        out = np.where(seen, value, self.floor)
        for order, own, context in ((2, key & PAIR, middle), (3, key, key >> BITS)):
            known, weight = self._get(-order, context.astype(np.int64))
            seen, value = self._get(order, own.astype(np.int64))
            out = np.where(seen, value, np.where(known, weight + out, out))
        return out


def scores(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, digest, lang, n_ngrams and perplexity per document. ``blocks`` are stored."""
    total = blocks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    salts = max(1, ceil(total / SHARDS / GROUP_BYTES))
    lists = pa.list_(pa.int64())
    names = ["block", "lang", "shard", "sums", "doc_ids", "digests", "sizes"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), lists, lists, lists])))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = None
        if len(right):
            known = ShardModel(*(right.column(c).to_numpy() for c in ("kind", "key", "value")))
        rows = []
        for row in left.to_pylist():
            if known is not None and row["payload"] is not None:
                keys, index, doc, counts = unpack(row["payload"])
                value = known.log_probability(keys)[index] * counts
                n_docs = int(doc[-1]) + 1 if len(doc) else 0
                row["sums"] = np.bincount(doc, weights=value, minlength=n_docs).tolist()
            rows.append({n: row.get(n) for n in names})
        return pa.Table.from_pylist(rows, schema)

    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    repeated = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ["lang", "shard", "salt"]
    summed = salted.groupBy(*keys).cogroup(repeated.groupBy(*keys)).applyInArrow(
        score,
        "block long, lang string, shard int, sums array<double>, doc_ids array<long>, "
        "digests array<long>, sizes array<long>",
    )
    by_shard = F.array_sort(F.collect_list(F.when(F.col("sums").isNotNull(), F.struct("shard", "sums"))))
    gathered = summed.where("block IS NOT NULL").groupBy("block", "lang").agg(
        by_shard.alias("parts"),
        *(F.first(c, ignorenulls=True).alias(c) for c in ("doc_ids", "digests", "sizes")),
    )
    zero = F.transform("sizes", lambda _: F.lit(0.0))
    add = lambda a, p: F.zip_with(a, p["sums"], lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    unknown = F.transform("sizes", lambda _: F.lit(None).cast("double"))  # no model of the language
    logs = F.when(F.size("parts") > 0, F.aggregate("parts", zero, add)).otherwise(unknown)
    one = gathered.select("lang", F.explode(F.arrays_zip("doc_ids", "digests", "sizes", logs.alias("logs"))).alias("d"))
    return one.select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.digests").alias("digest"),
        "lang",
        F.col("d.sizes").alias("n_ngrams"),
        F.exp(-F.col("d.logs") / F.col("d.sizes")).alias("perplexity"),
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), lang, n_ngrams, perplexity, threshold and keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(text).alias("digest"),
    )
    blocks = kept(profiles(rows), "profiles")
    counts = kept(trigram_counts(blocks, labels), "trigrams")
    scored = kept(scores(blocks, kept(model(counts), "language-model")), "scores")
    bands = range(len(BANDS) + 1)
    band = sum(((F.col("n_ngrams") >= lower).cast("int") for lower in BANDS), F.lit(0))
    scored = scored.withColumn("band", band)
    trusted = scored.where("perplexity IS NOT NULL").join(trusted_ids(labels).where("held_out"), "doc_id", "left_semi")
    quantile = F.percentile_approx("perplexity", QUANTILE, ACCURACY)
    limits = trusted.rollup("lang", "band").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), quantile.alias("limit")
    )
    limits = kept(limits.where((F.col("n") >= LEAST_TRUSTED) | (F.col("level") == 3)), "limits")
    # One row per language: its own limit and, by band, those of its bands.
    strata = limits.where("level < 3 AND lang IS NOT NULL").groupBy("lang").agg(
        F.max(F.when(F.col("level") == 1, F.col("limit"))).alias("wide"),
        *(F.max(F.when((F.col("level") == 0) & (F.col("band") == b), F.col("limit"))).alias(f"own{b}") for b in bands),
    )
    everywhere = limits.where("level = 3").agg(F.max("limit")).first()[0]
    own = F.coalesce(*(F.when(F.col("band") == b, F.col(f"own{b}")) for b in bands))
    threshold = F.coalesce(own, "wide", F.lit(everywhere).cast("double"))
    out = _per_language(scored, strata, ["digest"], "left")
    out = out.withColumn("threshold", F.when(F.col("perplexity").isNotNull(), threshold))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "digest", "lang", "n_ngrams", "perplexity", "threshold", keep.alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model keeps, unchanged."""
    rejected = judged(docs, labels).where("NOT keep").select("doc_id", "digest").distinct()
    rejected = kept(rejected.toDF("r_id", "r_digest"), "rejected")
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("r_id")) & (digest == F.col("r_digest"))
    # By hash at every size, so that disk and time follow the input evenly; AQE splits skew.
    return docs.join(rejected.hint("shuffle_hash"), same, "left_anti")
