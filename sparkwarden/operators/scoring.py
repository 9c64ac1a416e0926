"""Findings against labelled scenarios.

Ownership is a join of event ids, not a lookup table on the driver: a finding
belongs to a scenario when all of its events are owned by that one scenario
(within its rule); otherwise it is unexpected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.numbers import ratio
from sparkwarden.operators.findings import bad_evidence

# Fixed values.
SPLITS = ("all", "development", "holdout")
LABELS = ("malicious", "benign", "ambiguous")
METRICS = (
    "tp", "fp", "fn", "tn", "ambiguous", "ambiguous_alerted", "complete_telemetry_tp",
    "complete_telemetry_fn", "duplicate_findings",
)


@dataclass(frozen=True)
class Score:
    rules: DataFrame  # metrics per rule
    scenarios: DataFrame  # result per scenario
    alerts: DataFrame  # (rule_id, scenario_id, finding_id, exact)
    unexpected: DataFrame  # (rule_id, finding_id)


def score(
    findings: DataFrame, scenarios: DataFrame, rule_ids: DataFrame, split: str = "all"
) -> Score:
    """``findings``: rule_id, finding_id, event_ids. ``scenarios``: scenario_id,
    rule_id, split, label, telemetry_complete, anchors, available. ``rule_ids``:
    rules that appear in the report even with nothing to report."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    chosen = F.lit(True) if split == "all" else F.coalesce(F.col("split") == split, F.lit(False))
    anchors = F.col("anchors")
    owned = F.transform(
        F.array_union("anchors", "available"),
        lambda e: F.struct(
            e.alias("event_id"), F.coalesce(F.array_contains(anchors, e), F.lit(False)).alias("anchor")
        ),
    )
    owners = scenarios.select(
        "rule_id",
        "scenario_id",
        chosen.alias("in_split"),
        F.size(F.array_distinct(anchors)).alias("n_anchors"),
        F.inline(owned),
    )
    distinct = F.array_distinct("event_ids")
    assigned = (
        findings.select(
            "rule_id", "finding_id", F.size(distinct).alias("n_events"), F.explode_outer(distinct).alias("event_id")
        )
        .join(owners, ["rule_id", "event_id"], "left")
        .groupBy("rule_id", "finding_id")
        .agg(
            F.max("n_events").alias("n_events"),
            F.min("scenario_id").alias("scenario_id"),
            (F.min("scenario_id") != F.max("scenario_id")).alias("several"),
            F.count_if(F.col("scenario_id").isNull()).alias("unowned"),
            F.coalesce(F.bool_or("in_split"), F.lit(False)).alias("in_split"),
            # As many events as there are anchors, each an anchor: the same set.
            F.coalesce(F.bool_and("anchor") & (F.max("n_events") == F.max("n_anchors")), F.lit(False)).alias("exact"),
        )
    )
    single = F.coalesce(
        F.col("scenario_id").isNotNull() & (F.col("unowned") == 0) & ~F.col("several"), F.lit(False)
    )
    stray = (
        ~single
        & F.coalesce(F.col("n_events") > 0, F.lit(False))  # without evidence: no finding, but its rule is listed
        & (F.col("in_split") | F.col("scenario_id").isNull() | F.lit(split == "all"))
    )
    alert = single & F.col("in_split")
    # One pass over the findings: a row per scenario with alerts, and one per rule for the rest.
    counted = assigned.groupBy("rule_id", F.when(alert, F.col("scenario_id")).alias("scenario_id")).agg(
        F.count_if(alert).alias("alerts"),
        F.count_if(alert & F.col("exact")).alias("exact_alerts"),
        F.count_if(stray).alias("unexpected"),
    )
    n, exact = F.coalesce("alerts", F.lit(0)), F.coalesce("exact_alerts", F.lit(0))
    placed = (
        scenarios.withColumn("chosen", chosen)
        .join(counted, ["rule_id", "scenario_id"], "full_outer")
        .select(
            *scenarios.columns,
            F.coalesce("chosen", F.lit(False)).alias("chosen"),
            "unexpected",
            n.alias("alerts"),
            exact.alias("exact_alerts"),
            F.when(
                F.col("label") == "ambiguous",
                F.when(n > 0, "unscored_alert").otherwise("unscored_no_alert"),
            )
            .when(F.col("label") == "benign", F.when(n > 0, "fp").otherwise("tn"))
            .otherwise(F.when(exact > 0, "tp").otherwise("fn"))
            .alias("result"),
            (exact > 0).alias("correct_evidence_match"),
        )
    )
    return Score(
        _metrics(placed.unionByName(rule_ids.select("rule_id"), allowMissingColumns=True)),
        placed.where("chosen").drop("chosen", "unexpected"),
        assigned.where(alert).select("rule_id", "scenario_id", "finding_id", "exact"),
        assigned.where(stray).select("rule_id", "finding_id"),
    )


def _metrics(placed: DataFrame) -> DataFrame:
    """``placed``: scenarios with their results, of which the ``chosen`` count, findings that
    are ``unexpected`` per rule, and rules to be listed."""
    result, label, chosen = F.col("result"), F.col("label"), F.col("chosen")
    wrong = F.col("alerts") - F.col("exact_alerts")
    malicious, complete = label == "malicious", F.col("telemetry_complete")
    spare = lambda c: F.greatest(c - 1, F.lit(0))
    many = lambda condition: F.count_if(chosen & condition)
    counts = placed.groupBy("rule_id").agg(
        F.count_if(chosen).alias("evaluated"),
        many(result == "tp").alias("tp"),
        # Wrong evidence does not rescue a missed case: it is one false alert.
        (many(result == "fp") + many(malicious & (wrong > 0))).alias("scenario_fp"),
        many(result == "fn").alias("fn"),
        many(result == "tn").alias("tn"),
        many(label == "ambiguous").alias("ambiguous"),
        many(result == "unscored_alert").alias("ambiguous_alerted"),
        many(malicious & complete & (result == "tp")).alias("complete_telemetry_tp"),
        many(malicious & complete & (result == "fn")).alias("complete_telemetry_fn"),
        F.sum(
            F.when(chosen & (label == "benign"), spare(F.col("alerts")))
            .when(chosen & malicious, spare(F.col("exact_alerts")) + spare(wrong))
            .otherwise(0)
        ).alias("duplicate_findings"),
        F.coalesce(F.sum("unexpected"), F.lit(0)).alias("unexpected"),
    ).select(
        "rule_id",
        "tp",
        (F.col("scenario_fp") + F.col("unexpected")).alias("fp"),
        *[name for name in METRICS if name not in ("tp", "fp")],
        "evaluated",
        "unexpected",
    )
    tp = F.col("tp")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + F.col("fp")),
            "recall": ratio(tp, tp + F.col("fn")),
            "complete_telemetry_recall": ratio(
                F.col("complete_telemetry_tp"),
                F.col("complete_telemetry_tp") + F.col("complete_telemetry_fn"),
            ),
        }
    )


def score_violations(findings: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Reasons for refusing the inputs of ``score`` as (subject, rule) rows."""
    by_finding = findings.where(bad_evidence(F.col("event_ids"))).select(
        F.col("finding_id").alias("subject"), F.lit("finding_event_ids").alias("rule")
    )
    clean = lambda ids: F.coalesce(
        F.exists(ids, lambda v: v.isNull() | (v == ""))
        | (F.size(F.array_distinct(ids)) < F.size(ids)),
        F.lit(True),
    )
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label"),
            F.when(clean(F.col("anchors")) | (F.size("anchors") == 0), "anchors"),
            F.when(clean(F.col("available")), "available"),
        )
    )
    by_scenario = scenarios.select(F.col("scenario_id").alias("subject"), F.explode(checks).alias("rule"))
    twice = (
        scenarios.groupBy("scenario_id").count().where("count > 1")
        .select(F.col("scenario_id").alias("subject"), F.lit("scenario_id_repeats").alias("rule"))
    )
    shared = (
        scenarios.select(
            "rule_id", "scenario_id", F.explode(F.array_union("anchors", "available")).alias("e")
        )
        .groupBy("rule_id", "e")
        .agg(F.min("scenario_id").alias("a"), F.max("scenario_id").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select(F.col("e").alias("subject"), F.lit("event_shared_by_scenarios").alias("rule"))
    )
    return by_finding.unionByName(by_scenario).unionByName(twice).unionByName(shared)


def source_id_mode_violations(findings: DataFrame) -> DataFrame:
    """Scoring by source ids needs one source, aligned lists and unambiguous ids.
    ``findings``: finding_id, provider, source, event_uids, source_event_ids."""
    misaligned = findings.where(
        ~F.coalesce(F.size("event_uids") == F.size("source_event_ids"), F.lit(False))
    ).select(F.col("finding_id").alias("subject"), F.lit("ids_not_aligned").alias("rule"))
    ambiguous = (
        findings.select(F.inline(F.arrays_zip("event_uids", "source_event_ids")))
        .groupBy("source_event_ids")
        .agg(F.min("event_uids").alias("a"), F.max("event_uids").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select(
            F.col("source_event_ids").alias("subject"), F.lit("ambiguous_source_id").alias("rule")
        )
    )
    mixed = (
        findings.agg(
            F.min(F.struct("provider", "source")).alias("a"),
            F.max(F.struct("provider", "source")).alias("b"),
        )
        .where(F.col("a") != F.col("b"))
        .select(F.col("b.source").alias("subject"), F.lit("several_sources").alias("rule"))
    )
    return misaligned.unionByName(ambiguous).unionByName(mixed)
