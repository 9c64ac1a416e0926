"""Scoring on the given tables: orders as labelled scenarios, their lines as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.numbers import ratio
from sparkwarden.operators.scoring import score, score_violations
from sparkwarden.plans.proofs.generic import table
from sparkwarden.plans.proofs.registry import query

# Scenario: one order. Its anchors are lines 1 and 2, its events all line numbers 1-7.
# Findings: per line a pair (line, line % 2 + 1) of the order; lines above 6 reach into
# the next order, so they belong to no single scenario.
_SCENARIOS = """WITH scenarios AS (SELECT o_orderkey AS scenario, 'rule-' || (o_custkey % 3) AS rule_id,
 CASE o_orderkey % 2 WHEN 0 THEN 'development' ELSE 'holdout' END AS split,
 CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'benign' ELSE 'ambiguous' END AS label,
 o_custkey % 4 <> 0 AS complete FROM orders WHERE o_orderkey % 10 <> 9),
found AS (SELECT DISTINCT l.l_orderkey AS scenario, l.l_linenumber AS line,
 'rule-' || (o.o_custkey % 3) AS rule_id,
 CASE WHEN l.l_linenumber > 6 THEN 'stray' WHEN l.l_linenumber IN (1, 2) THEN 'exact'
  ELSE 'other' END AS shape FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
placed AS (SELECT f.*, s.scenario IS NOT NULL AS known FROM found f
 LEFT JOIN scenarios s USING (scenario, rule_id)),
-- Lines 1 and 2 give the same finding; it is counted once.
alerts AS (SELECT DISTINCT scenario, rule_id, shape, known,
 CASE WHEN shape = 'exact' THEN 0 ELSE line END AS finding FROM placed),
per AS (SELECT s.*, count(a.finding) AS n,
 count(a.finding) FILTER (WHERE a.shape = 'exact') AS exact FROM scenarios s
 LEFT JOIN alerts a ON a.scenario = s.scenario AND a.rule_id = s.rule_id AND a.shape <> 'stray'
 GROUP BY ALL)
"""
_SCENARIOS = _SCENARIOS.replace(
    "GROUP BY ALL", "GROUP BY s.scenario, s.rule_id, s.split, s.label, s.complete"
)


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    event = lambda order, line: F.concat(order.cast("string"), F.lit("-"), line.cast("string"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    rule = F.concat(F.lit("rule-"), (F.col("o_custkey") % 3).cast("string"))
    scenarios = orders.where("o_orderkey % 10 <> 9").select(
        F.concat(F.lit("order-"), key).alias("scenario_id"),
        rule.alias("rule_id"),
        F.when(key % 2 == 0, "development").otherwise("holdout").alias("split"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'benign' ELSE 'ambiguous' END"
        ).alias("label"),
        (F.col("o_custkey") % 4 != 0).alias("telemetry_complete"),
        F.array(*[event(key, F.lit(i)) for i in (1, 2)]).alias("anchors"),
        F.array(*[event(key, F.lit(i)) for i in range(1, 8)]).alias("available"),
    )
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    pair = (
        F.when(line > 6, F.array(event(order, line), F.concat(F.lit("x"), order)))
        .when(line <= 2, F.array(event(order, F.lit(1)), event(order, F.lit(2))))
        .otherwise(F.array(event(order, line), event(order, line % 2 + 1)))
    )
    # Lines 1 and 2 give one pair. Rows repeat within an order, where the join has put them.
    once = F.when(line <= 2, 1).otherwise(line).alias("l_linenumber")
    findings = (
        lines.join(orders, order == key)
        .select("o_custkey", "l_orderkey", once)
        .distinct()
        .select(rule.alias("rule_id"), pair.alias("event_ids"))
        .withColumn("finding_id", F.concat_ws("/", "rule_id", F.array_join("event_ids", "+")))
    )
    return findings, scenarios


def _rules(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("rule_id").distinct()


_METRICS = _SCENARIOS + """, results AS (SELECT rule_id,
 count(*) FILTER (WHERE label = 'malicious' AND exact > 0) AS tp,
 count(*) FILTER (WHERE (label = 'benign' AND n > 0) OR (label = 'malicious' AND n > exact)) AS scenario_fp,
 count(*) FILTER (WHERE label = 'malicious' AND exact = 0) AS fn,
 count(*) FILTER (WHERE label = 'benign' AND n = 0) AS tn,
 count(*) FILTER (WHERE label = 'ambiguous') AS ambiguous,
 count(*) FILTER (WHERE label = 'ambiguous' AND n > 0) AS ambiguous_alerted,
 count(*) FILTER (WHERE label = 'malicious' AND exact > 0 AND complete) AS complete_telemetry_tp,
 count(*) FILTER (WHERE label = 'malicious' AND exact = 0 AND complete) AS complete_telemetry_fn,
 CAST(sum(CASE label WHEN 'benign' THEN greatest(n - 1, 0)
  WHEN 'malicious' THEN greatest(exact - 1, 0) + greatest(n - exact - 1, 0) ELSE 0 END) AS BIGINT)
  AS duplicate_findings, count(*) AS evaluated FROM per {where} GROUP BY rule_id),
strays AS (SELECT a.rule_id, count(*) AS unexpected FROM alerts a
 WHERE (a.shape = 'stray' OR NOT a.known) {stray} GROUP BY a.rule_id)
SELECT r.rule_id, tp, scenario_fp + unexpected AS fp, fn, tn, ambiguous, ambiguous_alerted,
 complete_telemetry_tp, complete_telemetry_fn, duplicate_findings, evaluated, unexpected,
 round(tp / nullif(tp + scenario_fp + unexpected, 0), 6) AS precision,
 round(tp / nullif(tp + fn, 0), 6) AS recall,
 round(complete_telemetry_tp / nullif(complete_telemetry_tp + complete_telemetry_fn, 0), 6)
  AS complete_telemetry_recall
FROM results r JOIN strays s ON s.rule_id = r.rule_id"""


@query(_METRICS.format(where="", stray=""))
def score_metrics(spark, sf_dir):
    """Precision, recall and counts per rule, by exact evidence."""
    findings, scenarios = _inputs(spark, sf_dir)
    return score(findings, scenarios, _rules(scenarios)).rules


@query(_METRICS.format(
    where="WHERE split = 'holdout'",
    stray="AND (NOT a.known OR a.scenario % 2 = 1)",
))
def score_metrics_holdout(spark, sf_dir):
    """The same for one split; strays without a known owner always count."""
    findings, scenarios = _inputs(spark, sf_dir)
    return score(findings, scenarios, _rules(scenarios), "holdout").rules


@query(_SCENARIOS + """SELECT 'order-' || scenario AS scenario_id, label, n AS alerts, exact AS exact_alerts,
 CASE label WHEN 'ambiguous' THEN CASE WHEN n > 0 THEN 'unscored_alert' ELSE 'unscored_no_alert' END
  WHEN 'benign' THEN CASE WHEN n > 0 THEN 'fp' ELSE 'tn' END
  ELSE CASE WHEN exact > 0 THEN 'tp' ELSE 'fn' END END AS result,
 exact > 0 AS correct_evidence_match FROM per""")
def score_scenarios(spark, sf_dir):
    """Result per scenario."""
    findings, scenarios = _inputs(spark, sf_dir)
    return score(findings, scenarios, _rules(scenarios)).scenarios.select(
        "scenario_id", "label", "alerts", "exact_alerts", "result", "correct_evidence_match"
    )


@query("""SELECT 'order-' || o_orderkey AS subject, 'label' AS rule FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'order-' || o_orderkey, 'anchors' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'shared-' || (o_custkey % 100), 'event_shared_by_scenarios' FROM orders
 WHERE o_orderkey % 13 = 0 GROUP BY o_custkey % 100 HAVING count(*) > 1""")
def score_input_checks(spark, sf_dir):
    """Scenario sets that may not be scored, and why."""
    key = F.col("o_orderkey")
    own = F.concat(F.lit("order-"), key)
    scenarios = table(spark, sf_dir, "orders").select(
        own.alias("scenario_id"),
        F.lit("r").alias("rule_id"),
        F.when(key % 7 == 0, "other").otherwise("benign").alias("label"),
        F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(own)).alias("anchors"),
        F.when(key % 13 == 0, F.array(F.concat(F.lit("shared-"), F.col("o_custkey") % 100)))
        .otherwise(F.array(own))
        .alias("available"),
    )
    findings = scenarios.select(F.col("scenario_id").alias("finding_id"), F.array("scenario_id").alias("event_ids"))
    return score_violations(findings, scenarios)


@query("""WITH alerts AS (SELECT doc_id FROM documents WHERE n_chars > 2000)
SELECT lang AS rule_id, count(*) FILTER (WHERE toxic = 1 AND a.doc_id IS NOT NULL) AS tp,
 count(*) FILTER (WHERE toxic = 0 AND a.doc_id IS NOT NULL) AS fp,
 count(*) FILTER (WHERE toxic = 1 AND a.doc_id IS NULL) AS fn,
 round(count(*) FILTER (WHERE toxic = 1 AND a.doc_id IS NOT NULL)
  / nullif(count(*) FILTER (WHERE a.doc_id IS NOT NULL), 0), 6) AS precision
FROM labels l JOIN documents d USING (doc_id) LEFT JOIN alerts a USING (doc_id) GROUP BY lang""")
def confusion_counts(spark, sf_dir):
    """Confusion counts with NULL ratios on empty denominators."""
    rows = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )
    alert, bad = F.col("n_chars") > 2000, F.col("toxic") == 1
    counts = rows.groupBy(F.col("lang").alias("rule_id")).agg(
        F.count_if(bad & alert).alias("tp"),
        F.count_if(~bad & alert).alias("fp"),
        F.count_if(bad & ~alert).alias("fn"),
    )
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
