import json

import pytest
from pyspark.sql import functions as F
from samples import attach, audit, azure, bucket_policy, credential, gcp, normalize, stamp, trail

from sparkwarden.functions import json_access
from sparkwarden.operators import quality
from sparkwarden.sources.catalog import SOURCES, faults, format_table, source_of
from sparkwarden.sources.normalize import Scope
from sparkwarden.sources.records import numbered_lines, parse_documents, parse_lines


def column(frame, name):
    return [r[0] for r in frame.orderBy("row").select(name).collect()]


def test_cloudtrail_outcomes_and_account(spark):
    records = [
        trail("A"),
        trail("A", errorCode="Denied"),
        trail("A", responseElements={"errorMessage": "no"}),
        trail("A", responseElements={"_return": False}),
        trail("A", responseElements={"_return": "false"}),
        trail("A", eventType="AwsServiceEvent"),
        trail("A", recipientAccountId=None, userIdentity={"accountId": "222"}),
        trail("A", recipientAccountId=5, sourceIPAddress="svc.example"),
    ]
    got = normalize(spark, "aws.cloudtrail", records).cache()
    assert column(got, "outcome") == ["success", "failure", "failure", "failure", "success", "unknown", "success", "success"]
    assert column(got, "account_id")[6:] == ["222", None]
    assert column(got, "quality")[7] == ["missing_account", "source_address_is_not_ip"]
    assert column(got, "scope_id") == column(got, "account_id")


def test_cloudtrail_refusals(spark):
    records = ["[1]", trail("A", eventTime="2024-01-01T00:00:00"), trail("A", eventSource=""), trail("A", at=None), attach()]
    got = column(normalize(spark, "aws.cloudtrail", records), "problems")
    assert "record_not_object" in got[0]
    assert got[1:] == [["invalid_event_time"], ["missing_service"], [], []]


def test_azure_scope_comes_from_the_record_or_the_collection(spark):
    records = [azure("x/y", stamp()), azure("x/y", stamp(), subscriptionId=None, tenantId=None)]
    own = normalize(spark, "azure.activity", records)
    assert column(own, "scope_id") == ["sub", None]
    declared = normalize(spark, "azure.activity", records, Scope("azure.subscription", "sub", "other")).cache()
    assert column(declared, "tenant_id") == ["ten", "other"]
    assert column(declared, "problems") == [["tenant_differs_from_collection"], []]


def test_entra_tenant_is_the_declared_one(spark):
    got = normalize(spark, "azure.entra.signin", [{"id": "1", "status": {"errorCode": 0}, "homeTenantId": "x"}])
    assert column(got, "scope_id") == ["t1"]
    bad = normalize(spark, "azure.entra.signin", [{"id": "1"}], Scope("azure.tenant", "a", "b"))
    assert column(bad, "problems") == [["collection_tenants_differ"]]


def test_entra_signin_outcomes(spark):
    codes = [0, 50126, None, True, "0", 0.0]
    got = normalize(spark, "azure.entra.signin", [{"status": {"errorCode": c}} for c in codes]).cache()
    assert column(got, "outcome") == ["success", "failure"] + ["unknown"] * 4
    assert column(got, "error_code")[:2] == [None, "50126"]


def test_entra_initiators(spark):
    who = [
        {"user": {"id": "u"}},
        {"app": {"servicePrincipalId": "s"}},
        {"user": {"id": "u"}, "app": {"servicePrincipalId": "s"}},
        {"user": {"id": "u"}, "app": {}},
        {},
    ]
    got = normalize(spark, "azure.entra.audit", [audit("x", stamp(), initiatedBy=w) for w in who]).cache()
    assert column(got, "actor_id") == ["u", "s", None, "u", None]
    assert column(got, "actor_type") == ["User", "ServicePrincipal", None, "User", None]
    assert "ambiguous_initiator" in column(got, "quality")[2]


def test_gcp_outcomes_and_scope(spark):
    statuses = [{}, {"code": 0}, {"code": 7}, None, {"code": "0"}, {"code": False}]
    records = [gcp("m", stamp(), payload={"status": s}) for s in statuses]
    records += [gcp("m", stamp(), operation={"id": "o", "last": last}) for last in (False, True)]
    records += [gcp("m", stamp(), logName=name) for name in ("folders/f/logs/a", "billingAccounts/b/logs/a")]
    got = normalize(spark, "gcp.audit", records).cache()
    assert column(got, "outcome") == [
        "success", "success", "failure", "unknown", "unknown", "unknown", "unknown", "success", "success", "success",
    ]
    assert column(got, "scope_type")[-2:] == ["gcp.folder", None]
    assert column(got, "quality")[-1] == ["unsupported_log_scope", "missing_scope"]
    assert json.loads(column(got, "source_event_id")[0]) == [f"m-{stamp()}", stamp()]


def test_gcp_needs_an_audit_log(spark):
    assert column(normalize(spark, "gcp.audit", [{"protoPayload": {"@type": "x"}}]), "problems") == [
        ["not_an_audit_log", "missing_service", "missing_action"]
    ]


def test_same_payload_in_two_scopes_is_two_events(spark):
    record = credential()
    uids = {
        normalize(spark, "azure.entra.audit", [record], Scope("azure.tenant", t, t)).first().event_uid
        for t in ("a", "b")
    }
    assert len(uids) == 2


@pytest.mark.parametrize(
    "fmt, text, expected",
    [
        ("cloudtrail-json", '{"Records":[{"a":1},2]}', [("/Records/0", None), ("/Records/1", None)]),
        ("cloudtrail-json", '{"a":1}', [("", None)]),
        ("cloudtrail-json", '{"Records":{}}', [("", "envelope_member_not_an_array")]),
        ("cloudtrail-json", '{"Records":[}', [("", "malformed_json")]),
        ("cloudtrail-json", "[1]", [("", "document_not_an_object")]),
        ("azure-activity-rest-json", '{"value":[{}]}', [("/value/0", None)]),
        ("graph-signin-json", '{"value":7}', [("", "envelope_member_not_an_array")]),
        ("gcp-audit-json", '[{"a":1},{"a":2}]', [("/0", None), ("/1", None)]),
        ("gcp-audit-json", '{"entries":[{"a":1}]}', [("/entries/0", None)]),
        ("gcp-audit-json", '{"a":1}', [("", None)]),
        ("jsonl", '{"a":1}\n\n{"a":2}\r\n{bad', [("line:1", None), ("line:3", None), ("line:4", "malformed_json")]),
        ("other", "{}", [("", "unsupported_format")]),
    ],
)
def test_envelopes(spark, fmt, text, expected):
    files = spark.createDataFrame([(fmt, bytearray(text.encode()))], "format string, content binary")
    got = parse_documents(files).select("record_pointer", "parse_problem").collect()
    assert [tuple(r) for r in got] == expected


def test_line_numbers_are_exact_across_splits(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "x" * (i % 37)}) if i % 5 else "" for i in range(1, 2001)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = numbered_lines(spark, [str(tmp_path / "log.jsonl")])
        assert numbered.rdd.getNumPartitions() > 1
        rows = parse_lines(numbered).select(
            "record_pointer", F.try_variant_get("record", "$.n", "int").alias("n")
        ).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1600 and all(r.record_pointer == f"line:{r.n}" for r in rows)


def test_source_table(spark):
    assert format_table(spark).count() == 6 and not faults(SOURCES)
    trail = source_of(SOURCES, "aws", "aws.cloudtrail")
    assert faults([trail, trail]) == ["aws.cloudtrail: listed 2 times"]
    assert faults([trail._replace(formats=())]) == ["aws.cloudtrail: no format"]
    for sources, provider in ((SOURCES, "gcp"), ([], "aws"), ([trail, trail], "aws")):
        with pytest.raises(ValueError, match="aws.cloudtrail"):
            source_of(sources, provider, "aws.cloudtrail")


def test_bucket_policy_lifts_its_deltas(spark):
    got = normalize(spark, "gcp.audit", [bucket_policy([{"action": "ADD"}])])
    assert got.select(F.to_json("binding_deltas")).first()[0] == '[{"action":"ADD"}]'


def test_members_of_their_own_give_what_paths_give(spark):
    texts = [
        '{"a":"x","b":{"c":"y","d":{"e":7},"@f":true},"g":[1],"h":null}', '{"a":1,"b":"text","g":{}}', '{"b":{"c":null,"d":[]}}',
        '{"b":{"c":""},"z":1}', "{}", "[1]", '"s"', "null", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = rows.withColumn("doc", F.parse_json("text"))
    members = json_access.Members("doc", ("a", "b", "g", "h"), {"b": ("c", "d")})
    paths = ["$.a", "$.b", "$.b.c", "$.b.d", "$.b.d.e", '$.b["@f"]', '$.b["c"]', "$.g", "$.g[0]", "$.h", "$.z", "$.ab", "$"]
    getters = ("text_at", "loose_text", "is_object", "is_array", "is_empty_object", "integer_at", "boolean_at", "value_at", "object_at", "type_at")

    def told(document):
        found = [getattr(json_access, g)(document, p) for g in getters for p in paths]
        return [F.to_json(c) if i // len(paths) in (7, 8) else c.cast("string") for i, c in enumerate(found)]

    plain = rows.select("id", F.array(*told(F.col("doc"))).alias("told")).collect()
    apart = members.opened(rows).select("id", F.array(*told(members)).alias("told")).collect()
    assert sorted(plain) == sorted(apart) and len(apart) == len(texts)


def test_a_record_is_not_searched_again_for_every_field(spark):
    for job in SOURCES:
        rows = spark.createDataFrame([("{}",)], "text string").select(F.parse_json("text").alias("record"))
        plan = job.normalize(rows)._jdf.queryExecution().analyzed().toString()
        assert plan.count("try_variant_get(record#") <= 3, job.source


def test_shapes_are_told_without_walking_documents(spark):
    texts = ['{"a":[1]}', "[1]", "[]", "{}", '"s"', "7", "null", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.parse_json("text").alias("doc"))
    for kind in ("OBJECT", "ARRAY"):
        rules = quality.event_rules()
        name = next(c for c, k in quality.DOCUMENT_SHAPES.items() if k == kind)
        assert "schema_of_variant" not in str(rules[f"shape:{name}"])
        told = rows.select(F.col("doc").alias(name)).select(rules[f"shape:{name}"], F.schema_of_variant(name).startswith(kind))
        assert [r[0] for r in told.collect()] == [not r[1] for r in told.collect()]
