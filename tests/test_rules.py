import random

import pytest
from pyspark.sql import functions as F
from samples import (
    app_role,
    attach,
    bucket_policy,
    credential,
    diag_delete,
    events,
    gcp_new_key,
    ingress,
    new_key,
    permission,
    restart,
    role_assign,
    set_policy,
    stamp,
    stop,
    trail,
)

from sparkwarden.operators.findings import evidence_violations, inline_predicates, resolve_source_ids
from sparkwarden.plans.detect import checked, detect, explain, ordered_timeline, rule_catalog
from sparkwarden.plans.detections import BASELINE, RESTART_AWARE, RULES
from sparkwarden.plans.hunts import hunt, inline_events
from sparkwarden.plans.rules import Custom, Evidence, Query, Rule, RuleBook


def hits(spark, rule_id, records, revision=BASELINE, scope=None):
    rule = RULES.rules(revision)[rule_id]
    return rule.matches(events(spark, rule.source, records, scope)).count()


def gapped(build_first, build_second, offsets, group):
    """Independent pairs, one per offset, told apart by ``group(i)``."""
    records = []
    for i, offset in enumerate(offsets):
        records += [build_first(**group(i)), build_second(offset, **group(i))]
    return records


WHOLE = [(-1, False), (0, False), (0.000001, True), (1, True), (1800, True), (1800.000001, False), (1801, False)]


def test_key_attach_window(spark):
    records = []
    for i, (gap, _) in enumerate(WHOLE):
        records += [new_key(0, f"K{i}", eventID=f"a{i}"), attach(gap, f"K{i}", eventID=f"b{i}")]
    rule = RULES.rules(BASELINE)["aws_new_key_admin_attach"]
    got = {r[0] for r in rule.matches(events(spark, "aws.cloudtrail", records)).select("end_event_id").collect()}
    assert got == {f"b{i}" for i, (_, hit) in enumerate(WHOLE) if hit}


NANOS = [
    ((0, 100), True), ((0, 0), False), ((0, -100), False), ((1800, 0), True), ((1800, 100), False),
    ((1800, -100), True), ((0, 1), True), ((1800, 1), False),
]


@pytest.mark.parametrize("rule_id", ["azure_diag_delete_role_assign", "entra_sp_cred_app_role", "gcp_new_key_set_policy"])
def test_nanosecond_window(spark, rule_id):
    records = []
    first = stamp(5, 500)
    for i, ((seconds, nanos), _) in enumerate(NANOS):
        second = stamp(5 + seconds, 500 + nanos)
        if rule_id.startswith("azure"):
            records += [diag_delete(first, subscriptionId=f"s{i}"), role_assign(second, subscriptionId=f"s{i}", eventDataId=str(i))]
        elif rule_id.startswith("entra"):
            records += [credential(first, targets=[f"sp{i}"]), app_role(second, targets=[f"sp{i}"], id=str(i))]
        else:
            key = f"projects/p/serviceAccounts/s/keys/k{i}"
            records += [gcp_new_key(first, key), {**set_policy(second, key), "insertId": str(i)}]
    rule = RULES.rules(BASELINE)[rule_id]
    column = rule.evidence.source_ids[1]
    got = [r[0] for r in rule.matches(events(spark, rule.source, records)).select(column).collect()]
    found = {i for i in range(len(NANOS)) if any(g == str(i) or g.startswith(f'["{i}",') for g in got)}
    assert found == {i for i, (_, hit) in enumerate(NANOS) if hit}


def test_keys_must_all_agree_and_be_known(spark):
    base = new_key()
    assert hits(spark, "aws_new_key_admin_attach", [base, attach()]) == 1
    other = [
        attach(recipientAccountId="222"), attach(key="K9"), attach(policy="ReadOnlyAccess"), attach(errorCode="x"),
        attach(at=None),
    ]
    assert hits(spark, "aws_new_key_admin_attach", [base, *other]) == 0
    assert hits(spark, "aws_new_key_admin_attach", [new_key(recipientAccountId=None), attach(recipientAccountId=None)]) == 0
    tenant = dict(tenantId=None)
    assert hits(spark, "azure_diag_delete_role_assign", [diag_delete(**tenant), role_assign(stamp(9), **tenant)]) == 0


def test_one_permission_entry_must_hold_everything(spark):
    split = [permission(low=80, high=80), permission(v4=("10.0.0.0/8",))]
    assert hits(spark, "aws_log_stop_public_ingress", [stop(), ingress(permissions=split)]) == 0
    cases = [
        (permission(), 1),
        (permission("-1", None, None, (), ("::/0",)), 1),
        (permission("6", 3000, 4000, ("0.0.0.0/0",), ("::/0",)), 2),
        (permission("udp"), 0),
        (permission("tcp", "20", "22.0"), 1),
        (permission(low=23, high=3388), 0),
    ]
    for entry, expected in cases:
        assert hits(spark, "aws_log_stop_public_ingress", [stop(), ingress(permissions=[entry])]) == expected, entry


@pytest.mark.parametrize(
    "blocker, expected",
    [
        (restart(30), 0),
        (restart(30, userIdentity={"principalId": "other"}), 0),
        (restart(0), 1),
        (restart(60), 1),
        (restart(30, name="side"), 1),
        (restart(30, recipientAccountId="222"), 1),
        (restart(30, eventType="Other"), 1),
        (restart(30, errorCode="no"), 1),
    ],
)
def test_restart_between(spark, blocker, expected):
    records = [stop(), ingress(), blocker]
    assert hits(spark, "aws_log_stop_public_ingress", records, RESTART_AWARE) == expected
    assert hits(spark, "aws_log_stop_public_ingress", records) == 1


def test_directory_targets_are_single_elements(spark):
    odd = [{"id": 7, "type": "ServicePrincipal"}, {"id": "", "type": "ServicePrincipal"}, {"id": "u", "type": "User"}]
    assert hits(spark, "entra_sp_cred_app_role", [credential(targetResources=odd), app_role(stamp(9), targetResources=odd)]) == 0
    assert hits(spark, "entra_sp_cred_app_role", [credential(targets=["a", "a", "b"]), app_role(stamp(9), targets=["a", "b", "b"])]) == 2


def test_bucket_deltas(spark):
    good = {"action": "ADD", "member": "allUsers", "role": "roles/storage.objectViewer"}
    rule = "gcp_bucket_public_grant"
    assert hits(spark, rule, [bucket_policy([good, {**good, "member": "allAuthenticatedUsers"}])]) == 2
    assert hits(spark, rule, [bucket_policy([{**good, "action": "REMOVE"}, {**good, "member": "user:a"}, {**good, "role": "x"}])]) == 0
    assert hits(spark, rule, [bucket_policy([good], resourceName="")]) == 0


def test_delivery_order_and_repeats_do_not_matter(spark):
    records = [new_key(), attach(), stop(5), ingress(70), trail("Other", at=9)]
    once = detect(events(spark, "aws.cloudtrail", records)).ordered().select("finding_id", "matches").collect()
    shuffled = records * 2
    random.Random(3).shuffle(shuffled)
    again = events(spark, "aws.cloudtrail", shuffled).dropDuplicates(["event_uid"])
    assert detect(again).ordered().select("finding_id", "matches").collect() == once
    assert len(once) == 2


def test_findings_evidence_and_timeline(spark):
    both = permission(v6=("::/0",))
    frame = events(spark, "aws.cloudtrail", [stop(), ingress(permissions=[both]), trail("Between", at=30), trail("After", at=99)]).cache()
    found = checked(detect(frame), frame)
    row = found.findings.first()
    assert found.findings.count() == 1 and row.matches == 2 and len(row.event_uids) == 2
    assert row.source_event_ids == ["StopLogging-0.0", "AuthorizeSecurityGroupIngress-60.0"]
    assert len(inline_predicates(found.findings, found.matches).first().predicate_evidence) == 2
    assert evidence_violations(found.findings, frame).count() == 0
    assert evidence_violations(found.findings, frame.where("action <> 'StopLogging'")).first().rule == "unknown_event"
    blank = found.findings.withColumn("source_event_ids", F.lit(None).cast("array<string>"))
    assert resolve_source_ids(blank, frame).first().source_event_ids == row.source_event_ids
    story = explain(found, frame, row.finding_id)
    assert [r.action for r in ordered_timeline(story.timeline).collect()] == ["StopLogging", "Between", "AuthorizeSecurityGroupIngress"]
    assert story.events.count() == 2
    with pytest.raises(ValueError, match="no finding"):
        explain(found, frame, "finding_none")


def _rule(body, **more):
    fields = dict(
        rule_id="r", version="1", provider="aws", source="aws.cloudtrail", title="t", severity="low", attack=(),
        observed="", inferred="", cannot_establish=(), evidence=Evidence(("event_uid",)), body=body,
    )
    return Rule(**{**fields, **more})


def test_rule_forms_and_scoping(spark):
    frame = events(spark, "aws.cloudtrail", [stop()]).drop("row")
    foreign = events(spark, "gcp.audit", [gcp_new_key()]).drop("row")
    both = frame.unionByName(foreign)
    for body in (Query("SELECT event_uid FROM {events}"), Custom(lambda e: e.select("event_uid"), "all")):
        book = RuleBook({"x": {"r": _rule(body)}})
        only = checked(detect(both, "x", book), both).findings.collect()
        assert [r.source_event_ids for r in only] == [["StopLogging-0.0"]]  # filled from the event
    listed = _rule(Query("SELECT array(event_uid, event_uid) AS uids FROM {events}"), evidence=Evidence(list_column="uids"))
    assert detect(both, "x", RuleBook({"x": {"r": listed}})).evidence_violations().count() == 1
    with pytest.raises(ValueError, match="evidence"):
        checked(detect(both, "x", RuleBook({"x": {"r": listed}})), both)
    with pytest.raises(ValueError, match="unknown_event"):
        checked(detect(both, "x", book), foreign)


def test_rule_book_contract(spark):
    assert RULES.revisions() == (BASELINE, RESTART_AWARE)
    newer = RULES.rules(RESTART_AWARE)["aws_log_stop_public_ingress"]
    older = RULES.rules(BASELINE)["aws_log_stop_public_ingress"]
    assert newer.version == "1.1.0" and newer.title == older.title
    assert newer.definition_sha256 != older.definition_sha256
    assert len(RULES.for_source("gcp", "gcp.audit").rules(BASELINE)) == 2
    assert rule_catalog(spark).count() == 12
    with pytest.raises(ValueError):
        RULES.rules("none")
    with pytest.raises(ValueError):
        Evidence(("a", "a"))
    with pytest.raises(ValueError):
        Evidence()
    with pytest.raises(ValueError):
        _rule(None, title="")


def test_key_hunt_keeps_idle_and_unresolvable_creations(spark):
    records = [
        new_key(0, "K1", eventID="used"), new_key(0, "K2", eventID="idle"), new_key(0, None, eventID="unknown"),
        attach(0, "K1", eventID="same time"), attach(3600, "K1", eventID="edge"), attach(3600.000001, "K1", eventID="late"),
        attach(9, "K1", eventID="denied", errorCode="x"),
    ]
    found = hunt(events(spark, "aws.cloudtrail", records), 1)
    rows = {r.creation_event_id: r for r in inline_events(found, "aws_key_first_use").collect()}
    assert [rows[k].observation for k in ("used", "idle", "unknown")] == ["use_observed", "no_use_observed", "unresolvable"]
    assert (rows["used"].event_count, rows["used"].failures, rows["used"].sensitive_actions) == (3, 1, 3)
    assert len(rows["used"].event_uids) == 3 and rows["idle"].event_uids == []
    assert rows["used"].source_event_ids == ["denied", "edge", "same time"] and rows["idle"].source_event_ids == []
    assert found.lead_events.count() == 3
    assert found.ordered().first().creation_event_id == "used"


def test_signin_hunt_isolates_unknown_users(spark):
    login = lambda user, at, code=0, risk=None: {
        "id": f"{user}{at}", "userId": user, "createdDateTime": at and stamp(at), "status": {"errorCode": code},
        "riskLevelDuringSignIn": risk,
    }
    records = [
        login("a", 1), login("a", 3601, 5, "high"), login("a", 3602), login("a", None, None, "hidden"),
        login(None, 1), login(None, 2),
    ]
    found = hunt(events(spark, "azure.entra.signin", records), 1, "entra_signin_inventory")
    rows = found.ordered().collect()
    assert len(rows) == 3 and [r.signins for r in rows] == [3, 1, 1]
    top = rows[0]
    assert (top.failures, top.unknown_outcomes, top.elevated_risk_observations, top.unavailable_risk_observations) == (1, 1, 1, 2)
    assert sum(len(r.event_uids) for r in inline_events(found, "entra_signin_inventory").collect()) == 5


def test_gcp_hunt_includes_unknown_creations(spark):
    records = [gcp_new_key(stamp(), status=None), gcp_new_key(stamp(1), "projects/-/x"), set_policy(stamp()), set_policy(stamp(3600)), set_policy(stamp(3600, 1))]
    rows = {r.key_name: r for r in hunt(events(spark, "gcp.audit", records), 1, "gcp_key_use").leads.collect()}
    assert rows["projects/-/x"].observation == "unresolvable"
    used = rows["projects/p/serviceAccounts/s/keys/k"]
    assert used.event_count == 2 and used.creation_outcome == "unknown"


@pytest.mark.parametrize("hours", [0, -1, 744.1])
def test_hunt_hours_are_bounded(spark, hours):
    with pytest.raises(ValueError, match="hours"):
        hunt(events(spark, "aws.cloudtrail", [stop()]), hours)
