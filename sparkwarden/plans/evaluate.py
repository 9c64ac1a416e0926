"""Evaluation of the rules on a labelled data set. Only this job reads labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG
from sparkwarden.operators.quality import ambiguous_source_ids, fail_on
from sparkwarden.operators.scoring import (
    Score,
    score,
    score_violations,
    source_id_mode_violations,
)
from sparkwarden.plans.detect import Detection, checked, detect
from sparkwarden.plans.detections import BASELINE, RULES
from sparkwarden.plans.rules import RuleBook
from sparkwarden.sources.audit import evidence_audit
from sparkwarden.sources.catalog import SOURCES, Sources
from sparkwarden.sources.ingest import ingest
from sparkwarden.sources.manifest import read_manifests
from sparkwarden.sources.store import Store

_TRUTH = (
    "version int, dataset_id string, scenarios array<struct<scenario_id string, rule_id string,"
    " split string, label string, telemetry_complete boolean,"
    " anchor_event_uids array<string>, available_event_uids array<string>,"
    " anchor_event_ids array<string>, available_event_ids array<string>>>"
)


@dataclass(frozen=True)
class Truth:
    dataset_id: str
    scenarios: DataFrame
    by_uid: bool


def read_truth(spark: SparkSession, path: str, rule_names: dict[str, str] | None = None) -> Truth:
    """Labelled scenarios; one id mode per file. ``rule_names`` maps the file's rule
    ids to ours where they differ."""
    document = spark.read.schema(_TRUTH).json(path, multiLine=True)
    dataset_id = document.select("dataset_id").collect()[0][0]
    raw = document.select(F.inline("scenarios"))
    uid_form = F.col("anchor_event_uids").isNotNull() | F.col("available_event_uids").isNotNull()
    modes = raw.agg(F.bool_or(uid_form).alias("some"), F.bool_and(uid_form).alias("all")).collect()[0]
    if bool(modes["some"]) != bool(modes["all"]):
        raise ValueError("scenarios mix event uids and source ids")
    by_uid = bool(modes["some"])
    kind = "uids" if by_uid else "ids"
    rule = F.col("rule_id")
    if rule_names:
        names = F.create_map(*[F.lit(x) for pair in rule_names.items() for x in pair])
        rule = F.coalesce(F.try_element_at(names, rule), rule)
    scenarios = raw.select(
        "scenario_id",
        rule.alias("rule_id"),
        "split",
        "label",
        "telemetry_complete",
        F.col(f"anchor_event_{kind}").alias("anchors"),
        F.col(f"available_event_{kind}").alias("available"),
    )
    return Truth(dataset_id, scenarios, by_uid)


@dataclass(frozen=True)
class Report:
    ingestion: dict
    detection: Detection
    score: Score
    evidence_events_verified: int


def evaluate(
    store: Store,
    manifest_path: str,
    truth_path: str,
    revision: str = BASELINE,
    split: str = "all",
    rules: RuleBook = RULES,
    sources: Sources = SOURCES,
    tag: str = IDENTITY_TAG,
    rule_names: dict[str, str] | None = None,
) -> Report:
    """Import into an empty ``store``, detect, verify the evidence, score."""
    spark = store.spark
    truth = read_truth(spark, truth_path, rule_names)
    manifest = read_manifests(spark, manifest_path).selectExpr(
        "dataset_id", "manifest:provider::string AS provider", "manifest:source::string AS source"
    ).collect()[0]
    if manifest.dataset_id != truth.dataset_id:
        raise ValueError("scenarios and data set have different ids")
    own = rules.for_source(manifest.provider, manifest.source)
    ingestion = ingest(store, manifest_path, sources, tag)
    events = store.events(manifest.provider, manifest.source)
    if not truth.by_uid:
        fail_on({"source_ids": ambiguous_source_ids(events)})
    detection = checked(detect(events, revision, own), events)
    if not truth.by_uid:
        fail_on({"source_ids": source_id_mode_violations(detection.findings)})
    uids = detection.findings.select(F.explode("event_uids").alias("event_uid"))
    audit = evidence_audit(store, uids, sources, tag)
    fail_on({"evidence": audit.where("NOT verified").select("event_uid", "source_path")})
    ids = "event_uids" if truth.by_uid else "source_event_ids"
    findings = detection.findings.select("rule_id", "finding_id", F.col(ids).alias("event_ids"))
    fail_on({"scoring": score_violations(findings, truth.scenarios)})
    names = spark.createDataFrame(
        [(r,) for r in own.rules(revision)] or [], "rule_id string"
    )
    return Report(
        ingestion,
        detection,
        score(findings, truth.scenarios, names, split),
        audit.select("event_uid").distinct().count(),
    )
