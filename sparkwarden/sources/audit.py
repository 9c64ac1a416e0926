"""Evidence audit: can every stored event still be traced to exact source bytes?

One row per event and source reference, one boolean per check. Files are parsed
again where they lie; only hashes of the records travel, not the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG
from sparkwarden.functions.json_access import canonical_json, digest
from sparkwarden.operators.quality import event_rules
from sparkwarden.sources.catalog import SOURCES, Sources
from sparkwarden.sources.manifest import declared_files
from sparkwarden.sources.records import parse_documents
from sparkwarden.sources.store import Store

CHECKS = (
    "identity_ok", "reference_ok", "manifest_ok", "source_ok", "scope_ok", "artifact_ok",
    "path_ok", "record_ok",
)


def evidence_audit(
    store: Store,
    uids: DataFrame | None = None,
    sources: Sources = SOURCES,
    tag: str = IDENTITY_TAG,
) -> DataFrame:
    """``uids`` (event_uid) limits the audit; ``verified`` is the sum of the checks."""
    events, references = store.events(), store.table("occurrences")
    if uids is not None:
        wanted = uids.select("event_uid").distinct()
        events = events.join(wanted, "event_uid", "left_semi")
        references = references.join(wanted, "event_uid", "left_semi")
    bad_identity = event_rules(sources, tag)["event_uid"]
    facts = events.select(
        "event_uid",
        "provider",
        "source",
        "scope_type",
        "scope_id",
        "tenant_id",
        (~F.coalesce(bad_identity, F.lit(True))).alias("identity_ok"),
        digest(canonical_json(F.col("raw"))).alias("event_record_sha256"),
    )
    manifests = store.table("datasets").select(
        "dataset_id",
        "manifest",
        (digest(canonical_json(F.col("manifest"))) == F.col("manifest_sha256")).alias(
            "manifest_ok"
        ),
    )
    declared = (
        declared_files(manifests)
        .join(manifests.select("dataset_id", "manifest_ok"), "dataset_id")
        .withColumnsRenamed(
            {"provider": "manifest_provider", "source": "manifest_source"}
        )
    )
    traced = references.join(declared, ["dataset_id", "source_path"], "left")
    kinds = traced.where("format IS NOT NULL").select("artifact_sha256", "format").distinct()
    stored = store.table("artifacts").join(kinds, "artifact_sha256")
    intact = stored.select(
        "artifact_sha256",
        "format",
        (digest(F.col("content")) == F.col("artifact_sha256")).alias("artifact_ok"),
    )
    records = (
        parse_documents(stored)
        .where("parse_problem IS NULL")
        .groupBy("artifact_sha256", "format", "record_pointer")
        .agg(
            F.count("*").alias("resolved"),
            F.min(digest(canonical_json(F.col("record")))).alias("record_sha256"),
        )
    )
    joined = (
        facts.join(traced, "event_uid", "left")
        .join(intact, ["artifact_sha256", "format"], "left")
        .join(records, ["artifact_sha256", "format", "record_pointer"], "left")
    )
    agrees = lambda name: (
        F.col(f"declared_{name}").isNull() | F.col(f"declared_{name}").eqNullSafe(F.col(name))
    )
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    checked = joined.select(
        "event_uid",
        "dataset_id",
        "artifact_sha256",
        "source_path",
        "record_pointer",
        "identity_ok",
        F.col("dataset_id").isNotNull().alias("reference_ok"),
        yes(F.col("manifest_ok")).alias("manifest_ok"),
        yes(
            (F.col("manifest_provider") == F.col("provider"))
            & (F.col("manifest_source") == F.col("source"))
        ).alias("source_ok"),
        (agrees("scope_type") & agrees("scope_id") & agrees("tenant_id")).alias("scope_ok"),
        yes(F.col("artifact_ok")).alias("artifact_ok"),
        yes(F.col("declared_sha256") == F.col("artifact_sha256")).alias("path_ok"),
        yes(
            (F.col("resolved") == 1) & (F.col("record_sha256") == F.col("event_record_sha256"))
        ).alias("record_ok"),
    )
    verified = F.lit(True)
    for name in CHECKS:
        verified = verified & F.col(name)
    return checked.withColumn("verified", verified)
