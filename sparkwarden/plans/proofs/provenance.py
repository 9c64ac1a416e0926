"""Manifests, file hashes, pointers and evidence references, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.operators.findings import evidence_violations, resolve_source_ids
from sparkwarden.plans.proofs.generic import table
from sparkwarden.plans.proofs.registry import query
from sparkwarden.plans.table_logs import documents, spread
from sparkwarden.sources.ingest import file_violations
from sparkwarden.sources.manifest import manifest_violations, manifests_from_text
from sparkwarden.sources.records import resolve

_MANIFEST = """to_json(named_struct(
  'dataset_id', 'set-' || c_custkey,
  'provider', if(c_custkey % 7 = 1, 'gcp', 'aws'),
  'source', 'aws.cloudtrail',
  'category', if(c_custkey % 7 = 2, 'guess', 'synthetic'),
  'source_urls', array(if(c_custkey % 7 = 3, 'http://a.example', 'https://a.example')),
  'license', 'open', 'modified', false, 'limitations', array('none'),
  'collection_scope', named_struct('scope_type', 'aws.account', 'scope_id', 'n' || c_nationkey,
    'tenant_id', if(c_custkey % 7 = 4, 't', NULL)),
  'files', array(
    named_struct('path', 'a.json', 'sha256', sha2(c_name, 256), 'format', 'cloudtrail-json'),
    named_struct('path', if(c_custkey % 7 = 5, 'a.json', if(c_custkey % 7 = 6, '../b', 'b')),
      'sha256', sha2(c_name, 256), 'format', 'jsonl'))))"""


@query("""SELECT 'set-' || c_custkey AS dataset_id, list_extract(['provider_source_mismatch',
 'unknown_category', 'source_urls', 'tenant_without_meaning', 'file_paths_repeat',
 'file_path_leaves_folder'], c_custkey % 7) AS rule FROM customer WHERE c_custkey % 7 > 0""")
def manifest_checks(spark, sf_dir):
    """Broken manifest rules of many data sets in one job."""
    texts = spread(table(spark, sf_dir, "customer")).selectExpr(f"{_MANIFEST} AS text")
    return manifest_violations(manifests_from_text(texts))


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_path, sha256(text) AS artifact_sha256
FROM documents WHERE doc_id % 3 = 0""")
def file_hash_checks(spark, sf_dir):
    """Files whose bytes differ from the declared hash."""
    scanned = table(spark, sf_dir, "documents").select(
        F.lit("d").alias("dataset_id"),
        F.col("doc_id").cast("string").alias("source_path"),
        F.sha2(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")), 256).alias(
            "declared_sha256"
        ),
        F.sha2("text", 256).alias("artifact_sha256"),
    )
    broken = file_violations(scanned.drop("artifact_sha256"), scanned.drop("declared_sha256"))
    return broken.select("source_path", "artifact_sha256")


@query("""WITH placed AS (SELECT event_id, event_id // 64 AS file_no,
 row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS place FROM events)
SELECT CAST(file_no AS VARCHAR) AS artifact_sha256, '/Records/' || place AS record_pointer,
 1::BIGINT AS resolved, CASE WHEN event_id % 89 <> 0 THEN 'ev-' || event_id END AS record_id
FROM placed UNION ALL SELECT DISTINCT CAST(file_no AS VARCHAR), '/Records/64', 0, NULL FROM placed""")
def resolved_pointers(spark, sf_dir):
    """Every pointer resolves to exactly one record; a foreign one to none."""
    files = documents(spark, sf_dir, "aws.cloudtrail").select(
        F.col("file_no").cast("string").alias("artifact_sha256"), "format", "content"
    )
    sizes = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 64").alias("f")).count()
    wanted = sizes.select(
        F.col("f").cast("string").alias("artifact_sha256"),
        F.explode(
            F.array_union(
                F.sequence(F.lit(0), F.col("count").cast("int") - 1),
                F.array(F.lit(64)),
            )
        ).alias("place"),
    ).select("artifact_sha256", F.concat(F.lit("/Records/"), "place").alias("record_pointer"))
    return resolve(files, wanted).select(
        "artifact_sha256",
        "record_pointer",
        "resolved",
        F.try_variant_get("record", "$.eventID", "string").alias("record_id"),
    )


def _findings(spark, sf_dir):
    """Orders as findings whose evidence is their customer and the next one."""
    customer = F.col("o_custkey")
    uid = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.lit("r").alias("rule_id"),
        F.col("o_orderkey").cast("string").alias("finding_id"),
        F.lit("p").alias("provider"),
        F.lit("even").alias("source"),
        F.array(uid(customer), uid(customer + 2)).alias("event_uids"),
        F.lit(None).cast("array<string>").alias("source_event_ids"),
    )


def _events(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("event_uid"),
        F.lit("p").alias("provider"),
        F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("source"),
        F.col("c_name").alias("source_event_id"),
    )


@query("""WITH wanted AS (SELECT o_orderkey, o_custkey AS c FROM orders
 UNION ALL SELECT o_orderkey, o_custkey + 2 FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, 'c' || c AS event_uid,
 CASE WHEN c_custkey IS NULL THEN 'unknown_event' ELSE 'other_source' END AS rule
FROM wanted LEFT JOIN customer ON c = c_custkey WHERE c_custkey IS NULL OR c % 2 = 1""")
def evidence_checks(spark, sf_dir):
    """Supporting uids that name no event, or an event of another source."""
    found = evidence_violations(_findings(spark, sf_dir), _events(spark, sf_dir))
    return found.select("finding_id", "event_uid", "rule")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS finding_id,
 coalesce(a.c_name, '-') || '>' || coalesce(b.c_name, '-') AS ids FROM orders
LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 2""")
def evidence_source_ids(spark, sf_dir):
    """Source ids of the supporting events, in evidence order."""
    found = resolve_source_ids(_findings(spark, sf_dir), _events(spark, sf_dir))
    return found.select("finding_id", F.array_join("source_event_ids", ">", "-").alias("ids"))
