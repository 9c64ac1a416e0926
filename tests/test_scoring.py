import pytest

from sparkwarden.operators.scoring import score, score_violations, source_id_mode_violations

SCENARIO = "scenario_id string, rule_id string, split string, label string, telemetry_complete boolean, anchors array<string>, available array<string>"
FINDING = "rule_id string, finding_id string, event_ids array<string>"


def run(spark, findings, scenarios, split="all"):
    rules = spark.createDataFrame([("r",), ("quiet",)], "rule_id string")
    found = spark.createDataFrame(findings, FINDING)
    return score(found, spark.createDataFrame(scenarios, SCENARIO), rules, split)


def case(name, label="malicious", anchors=("a", "b"), extra=(), split="development", complete=True):
    return (name, "r", split, label, complete, list(anchors), [*anchors, *extra])


def metrics(result, rule="r"):
    return result.rules.where(f"rule_id = '{rule}'").first()


def test_exact_evidence_counts_and_duplicates_do_not(spark):
    got = metrics(run(spark, [("r", "1", ["a", "b"]), ("r", "2", ["b", "a"])], [case("s")]))
    assert (got.tp, got.fp, got.fn, got.duplicate_findings, got.precision) == (1, 0, 0, 1, 1.0)


def test_wrong_evidence_is_one_false_alert_and_a_miss(spark):
    got = metrics(run(spark, [("r", "1", ["a"]), ("r", "2", ["b"])], [case("s")]))
    assert (got.tp, got.fp, got.fn, got.duplicate_findings, got.complete_telemetry_fn) == (0, 1, 1, 1, 1)


def test_findings_across_scenarios_are_unexpected(spark):
    scenarios = [case("s"), case("t", anchors=("c", "d"), split="holdout")]
    finding = [("r", "1", ["a", "c"]), ("r", "2", ["a", "x"]), ("r", "3", ["x", "y"])]
    assert metrics(run(spark, finding, scenarios)).unexpected == 3
    assert metrics(run(spark, finding, scenarios, "holdout")).unexpected == 2
    assert {r.finding_id for r in run(spark, finding, scenarios, "development").unexpected.collect()} == {"1", "2", "3"}


def test_benign_ambiguous_and_silent_rules(spark):
    scenarios = [case("b", "benign", ("a",)), case("n", "benign", ("n",)), case("q", "ambiguous", ("q",)), case("w", "ambiguous", ("w",))]
    result = run(spark, [("r", "1", ["a"]), ("r", "2", ["q"])], scenarios)
    got = metrics(result)
    assert (got.fp, got.tn, got.ambiguous, got.ambiguous_alerted, got.precision, got.recall) == (1, 1, 2, 1, 0.0, None)
    assert metrics(result, "quiet").evaluated == 0
    assert {r.scenario_id: r.result for r in result.scenarios.collect()} == {
        "b": "fp", "n": "tn", "q": "unscored_alert", "w": "unscored_no_alert",
    }


def test_alerts_of_the_other_split_are_left_out(spark):
    got = metrics(run(spark, [("r", "1", ["a", "b"])], [case("s")], "holdout"))
    assert (got.tp, got.fp, got.evaluated) == (0, 0, 0)
    with pytest.raises(ValueError, match="split"):
        run(spark, [], [], "other")


def test_findings_are_read_once(spark):
    scenarios = [case("s"), case("t", "benign", ("c",), split="holdout")]
    findings = [("r", "1", ["b", "a", "a"]), ("r", "2", ["c", None]), ("r", "3", []), ("bare", "4", []), ("r", "5", ["c"])]
    result = run(spark, findings, scenarios)
    got = metrics(result)
    assert (got.tp, got.fp, got.unexpected, got.evaluated) == (1, 2, 1, 2)
    bare = metrics(result, "bare")
    assert (bare.evaluated, bare.fp, bare.unexpected, bare.duplicate_findings) == (0, 0, 0, 0)
    assert {(r.finding_id, r.exact) for r in result.alerts.collect()} == {("1", True), ("5", True)}
    counted = spark.range(5).selectExpr("'r' AS rule_id", "cast(id AS string) AS finding_id", "array('a', 'b') AS event_ids")
    rules = spark.createDataFrame([("r",)], "rule_id string")
    plan = score(counted, spark.createDataFrame(scenarios, SCENARIO), rules).rules._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 5") == 1


def test_input_checks(spark):
    scenarios = spark.createDataFrame(
        [case("s"), case("s", anchors=("c",)), case("u", "other", ("d",)), case("v", anchors=()), case("w", anchors=("a",))], SCENARIO
    )
    findings = spark.createDataFrame([("r", "1", ["a", "a"]), ("r", "2", []), ("r", "3", ["ok"])], FINDING)
    got = {tuple(r) for r in score_violations(findings, scenarios).collect()}
    assert got == {
        ("1", "finding_event_ids"), ("2", "finding_event_ids"), ("s", "scenario_id_repeats"), ("u", "label"),
        ("v", "anchors"), ("a", "event_shared_by_scenarios"),
    }
    ids = spark.createDataFrame(
        [("1", "aws", "x", ["u1"], ["i"]), ("2", "gcp", "y", ["u2"], ["i"]), ("3", "aws", "x", ["u3"], ["j", "k"])],
        "finding_id string, provider string, source string, event_uids array<string>, source_event_ids array<string>",
    )
    assert {r.rule for r in source_id_mode_violations(ids).collect()} >= {"ids_not_aligned", "ambiguous_source_id", "several_sources"}
