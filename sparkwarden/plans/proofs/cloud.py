"""Provider logs derived from the activity table, through the whole pipeline:
JSON text, parsing, normalisation, detections, hunts, findings.

The SQL side never sees JSON: it states in relational terms what each record
means, so the two paths share nothing but the activity table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.quality import (
    declared_scope_rules,
    event_rules,
    scope_rules,
    source_id_conflicts,
    violations,
)
from sparkwarden.operators.timeline import HOUR_NS, context_timeline, timeline_index
from sparkwarden.plans.detect import detect
from sparkwarden.plans.detections import BASELINE, RESTART_AWARE, RULES
from sparkwarden.plans.hunts import aws_key_first_use, entra_signin_inventory, gcp_key_use
from sparkwarden.plans.proofs.registry import query
from sparkwarden.plans.table_logs import (
    EPOCH_US,
    RECORDS,
    SQUEEZE,
    documents,
    line_documents,
    normalized,
    record_texts,
    stored,
)
from sparkwarden.sources.catalog import SOURCES
from sparkwarden.sources.records import parse_documents

# ------------------------------------------------------------------ SQL side

ACTIVITY = f"""act AS (SELECT event_id AS id, user_id AS u, event_type AS kind, value AS v,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 {EPOCH_US} + (epoch_us(ts) - {EPOCH_US}) // {SQUEEZE} AS micros FROM events),
base AS (SELECT *, CASE WHEN id % 97 <> 0 THEN micros END AS t,
 CASE WHEN id % 97 <> 0 THEN micros * 1000 + id % 1000 END AS ns,
 CASE WHEN k % 10 = 0 THEN 'cloudtrail.amazonaws.com'
  WHEN k % 10 = 1 THEN '2001:DB8:0::' || upper(printf('%x', u))
  ELSE '10.0.' || (u // 256) || '.' || (u % 256) END AS source_address,
 CASE WHEN k % 10 = 0 THEN NULL
  WHEN k % 10 = 1 THEN '2001:db8::' || CASE WHEN u = 0 THEN '' ELSE printf('%x', u) END
  ELSE '10.0.' || (u // 256) || '.' || (u % 256) END AS source_ip FROM act)"""

AWS = f"""WITH {ACTIVITY}, aws AS (SELECT *,
 CASE WHEN id % 89 <> 0 THEN 'ev-' || id END AS source_event_id,
 CASE WHEN u % 22 <> 0 THEN lpad(CAST(u % 5 AS VARCHAR), 12, '0') END AS account_id,
 CASE WHEN k <> 60 THEN 'P' || u END AS actor_id,
 'arn:aws:iam::' || (u % 5) || ':user/u' || u AS actor_arn,
 'AKIA' || u AS credential_id,
 CASE WHEN kind IN ('signup', 'purchase') THEN 'iam.amazonaws.com'
  WHEN kind IN ('error', 'view') THEN 'cloudtrail.amazonaws.com'
  ELSE 'ec2.amazonaws.com' END AS service,
 CASE kind WHEN 'signup' THEN 'CreateAccessKey' WHEN 'error' THEN 'StopLogging'
  WHEN 'view' THEN 'StartLogging' WHEN 'click' THEN 'AuthorizeSecurityGroupIngress'
  ELSE CASE WHEN k % 2 = 0 THEN 'AttachUserPolicy' ELSE 'AttachRolePolicy' END END AS action,
 CASE WHEN v > 100 OR k = 50 OR (kind = 'click' AND k % 7 = 6) THEN 'failure'
  WHEN k % 17 = 16 THEN 'unknown' ELSE 'success' END AS outcome,
 CASE WHEN v > 100 THEN 'AccessDenied' END AS error_code,
 CASE WHEN kind = 'signup' AND k % 10 <> 9 THEN 'AKIA' || u END AS issued_key,
 CASE WHEN kind = 'signup' THEN 'user-' || u END AS issued_key_owner,
 CASE WHEN kind = 'purchase' THEN 'arn:aws:iam::aws:policy/'
  || CASE WHEN k % 5 <> 0 THEN 'AdministratorAccess' ELSE 'ReadOnlyAccess' END END AS policy_arn,
 CASE kind WHEN 'signup' THEN 'user-' || u WHEN 'purchase' THEN 'target-' || (u % 4) END
  AS policy_target,
 CASE WHEN kind IN ('error', 'view') THEN 'trail-' || (k % 2) END AS trail_name,
 CASE WHEN kind = 'click' THEN 'sg-' || u END AS security_group FROM base)
"""

_D1 = AWS + """SELECT a.source_event_id AS start_event_id, b.source_event_id AS end_event_id,
 (b.t - a.t) / 1e6 AS elapsed_seconds, a.account_id, a.issued_key AS created_key_id,
 a.actor_arn AS key_creator, a.issued_key_owner AS key_owner, b.actor_arn AS policy_actor,
 b.action AS policy_action, b.policy_target, b.policy_arn
FROM aws a JOIN aws b ON a.account_id = b.account_id AND a.issued_key = b.credential_id
 AND b.t > a.t AND b.t <= a.t + 1800000000
WHERE a.kind = 'signup' AND a.outcome = 'success' AND b.kind = 'purchase'
 AND b.outcome = 'success' AND b.k % 5 <> 0"""

_OPEN = """, opened AS (
 SELECT *, '0' AS permission_index, '0.0.0.0/0' AS cidr, list_extract(['tcp', '-1', 'udp', '6'],
  k % 4 + 1) AS protocol, k % 30 AS from_port, k % 30 + 10 AS to_port FROM aws
 WHERE kind = 'click' AND k % 2 = 0
 UNION ALL SELECT *, '0', '::/0', list_extract(['tcp', '-1', 'udp', '6'], k % 4 + 1),
  k % 30, k % 30 + 10 FROM aws WHERE kind = 'click' AND k % 3 = 0
 UNION ALL SELECT *, '1', '::/0', 'tcp', 3389, 3389 FROM aws WHERE kind = 'click' AND k % 6 = 0)
"""
_D2 = AWS + _OPEN + """SELECT a.source_event_id AS start_event_id,
 b.source_event_id AS end_event_id, (b.t - a.t) / 1e6 AS elapsed_seconds, a.account_id,
 a.actor_id, a.credential_id, a.trail_name AS trail, b.security_group, b.permission_index,
 b.cidr, b.protocol, b.from_port, b.to_port
FROM aws a JOIN opened b ON a.account_id = b.account_id AND a.actor_id = b.actor_id
 AND a.credential_id = b.credential_id AND b.t > a.t AND b.t <= a.t + 1800000000
WHERE a.kind = 'error' AND a.outcome = 'success' AND b.outcome = 'success'
 AND (b.protocol = '-1' OR (b.protocol IN ('tcp', '6')
  AND (22 BETWEEN b.from_port AND b.to_port OR 3389 BETWEEN b.from_port AND b.to_port)))"""
_D2R = _D2 + """ AND NOT EXISTS (SELECT 1 FROM aws r WHERE r.kind = 'view'
 AND r.outcome = 'success' AND r.account_id = a.account_id AND r.trail_name = a.trail_name
 AND r.t > a.t AND r.t < b.t)"""

AZURE = f"""WITH {ACTIVITY}, azure AS (SELECT *,
 CASE WHEN id % 89 <> 0 THEN 'ad-' || id END AS source_event_id,
 CASE WHEN k <> 3 THEN 'sub-' || (u % 5) END AS scope_id,
 CASE WHEN k <> 4 THEN 'ten-' || (u % 3) END AS tenant_id,
 CASE WHEN k <> 60 THEN 'obj-' || u END AS actor_id,
 CASE WHEN k <> 61 THEN 'ten-' || (u % 3) END AS actor_tenant_id,
 CASE WHEN kind = 'error' AND k % 2 = 1 THEN 'MICROSOFT.INSIGHTS/DIAGNOSTICSETTINGS/DELETE'
  WHEN kind = 'error' THEN 'Microsoft.Insights/diagnosticSettings/delete'
  WHEN kind = 'purchase' THEN 'Microsoft.Authorization/roleAssignments/write'
  ELSE 'Microsoft.Resources/tags/write' END AS action,
 CASE WHEN k % 8 <> 0 THEN 'Microsoft.Insights' ELSE 'azure.monitor.activity' END AS service,
 CASE WHEN v > 100 THEN 'failure' WHEN k % 17 = 16 THEN 'unknown' ELSE 'success' END AS outcome,
 '/subscriptions/' || (u % 5) || '/items/' || id AS resource_name FROM base)
"""
_D3 = AZURE + """SELECT a.source_event_id AS start_event_id, b.source_event_id AS end_event_id,
 (b.ns - a.ns) / 1e9 AS elapsed_seconds, a.scope_id, a.tenant_id, a.actor_id, a.actor_tenant_id,
 a.resource_name AS diagnostic_setting, b.resource_name AS role_assignment,
 a.action AS logging_action, b.action AS access_action
FROM azure a JOIN azure b ON a.scope_id = b.scope_id AND a.tenant_id = b.tenant_id
 AND a.actor_id = b.actor_id AND a.actor_tenant_id = b.actor_tenant_id
 AND b.ns > a.ns AND b.ns <= a.ns + 1800000000000
WHERE a.kind = 'error' AND b.kind = 'purchase' AND a.outcome = 'success'
 AND b.outcome = 'success'"""

_TENANT = "CASE WHEN u % 13 <> 0 THEN 'tenant-' || (u % 2) END"
SIGNIN = f"""WITH {ACTIVITY}, signin AS (SELECT *,
 CASE WHEN id % 89 <> 0 THEN 'si-' || id END AS source_event_id, {_TENANT} AS scope_id,
 CASE WHEN k % 20 <> 0 THEN 'usr-' || u END AS actor_id,
 CASE WHEN v > 100 THEN 'failure' WHEN k % 17 = 16 THEN 'unknown' ELSE 'success' END AS outcome,
 list_extract(['none', 'low', 'medium', 'high', 'hidden', NULL], k % 6 + 1) AS risk_level
 FROM base)
"""
_H2 = SIGNIN + """, anchored AS (SELECT *, CASE WHEN scope_id IS NULL OR actor_id IS NULL
  THEN id END AS lone, first_value(ns) OVER (PARTITION BY scope_id, actor_id,
  CASE WHEN scope_id IS NULL OR actor_id IS NULL THEN id END ORDER BY ns NULLS LAST, id) AS start
 FROM signin),
selected AS (SELECT * FROM anchored WHERE ns IS NULL OR ns <= start + {hours} * 3600000000000)
"""
AUDIT = f"""WITH {ACTIVITY}, audit AS (SELECT *,
 CASE WHEN id % 89 <> 0 THEN 'au-' || id END AS source_event_id, {_TENANT} AS scope_id,
 CASE WHEN k = 61 THEN NULL WHEN k = 62 THEN 'app-' || u WHEN k <> 60 THEN 'usr-' || u END
  AS actor_id,
 CASE WHEN k IN (60, 61) THEN NULL WHEN k = 62 THEN 'ServicePrincipal' ELSE 'User' END
  AS actor_type,
 CASE kind WHEN 'signup' THEN 'Add service principal credentials'
  WHEN 'purchase' THEN 'Add app role assignment to service principal'
  WHEN 'view' THEN 'unknown' ELSE 'Update application' END AS action,
 CASE WHEN k % 19 = 18 THEN 'Policy' ELSE 'ApplicationManagement' END AS category,
 CASE WHEN v > 100 THEN 'failure' WHEN k % 17 = 16 THEN 'unknown' ELSE 'success' END AS outcome
 FROM base)
"""
_D4 = AUDIT + """, targets AS (SELECT *, 'sp-' || (k % 4) AS target_id FROM audit
 UNION ALL SELECT *, 'sp-' || (k % 3) FROM audit)
SELECT DISTINCT a.id AS first_row, b.id AS second_row, a.source_event_id AS credential_event_id,
 b.source_event_id AS assignment_event_id, a.scope_id, a.actor_id AS initiating_user_id,
 a.target_id AS mentioned_service_principal_id, (b.ns - a.ns) / 1e9 AS elapsed_seconds
FROM targets a JOIN targets b ON a.scope_id = b.scope_id AND a.actor_id = b.actor_id
 AND a.target_id = b.target_id AND b.ns > a.ns AND b.ns <= a.ns + 1800000000000
WHERE a.kind = 'signup' AND b.kind = 'purchase' AND a.actor_type = 'User'
 AND b.actor_type = 'User' AND a.outcome = 'success' AND b.outcome = 'success'
 AND a.category = 'ApplicationManagement' AND b.category = 'ApplicationManagement'"""
_D4_OUT = f"""SELECT credential_event_id, assignment_event_id, scope_id, initiating_user_id,
 mentioned_service_principal_id, elapsed_seconds FROM ({_D4}) AS pairs"""

GCP = f"""WITH {ACTIVITY}, gcp AS (SELECT *,
 CASE WHEN id % 89 <> 0 AND id % 97 <> 0 THEN '["ins-' || id || '","'
  || strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%f')
  || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || 'Z"]' END AS source_event_id,
 CASE WHEN k % 23 = 22 THEN NULL WHEN u % 7 = 6 THEN 'gcp.folder' ELSE 'gcp.project' END
  AS scope_type,
 CASE WHEN k % 23 = 22 THEN NULL WHEN u % 7 = 6 THEN 'f-' || (u % 5)
  ELSE 'proj-' || (u % 5) END AS scope_id,
 CASE kind WHEN 'signup' THEN 'iam.googleapis.com'
  WHEN 'purchase' THEN 'cloudresourcemanager.googleapis.com'
  WHEN 'click' THEN 'storage.googleapis.com' ELSE 'compute.googleapis.com' END AS service,
 CASE kind WHEN 'signup' THEN 'google.iam.admin.v1.CreateServiceAccountKey'
  WHEN 'purchase' THEN 'SetIamPolicy' WHEN 'click' THEN 'storage.setIamPermissions'
  ELSE 'compute.instances.insert' END AS action,
 CASE WHEN k <> 77 THEN 'res-' || u END AS resource_name,
 'user:' || u AS actor_id,
 CASE WHEN k % 17 = 16 THEN 'unknown' WHEN v > 100 THEN 'failure'
  WHEN k % 29 = 28 THEN 'unknown' ELSE 'success' END AS outcome,
 CASE WHEN k % 17 <> 16 AND v > 100 THEN '7' END AS error_code,
 'projects/proj-' || (u % 5) || '/serviceAccounts/sa-' || u || '/keys/key-' || u AS own_key,
 FROM base), keyed AS (SELECT *,
 CASE WHEN k <> 60 THEN '//iam.googleapis.com/' || own_key END AS credential_id,
 CASE WHEN kind <> 'signup' OR k % 10 = 9 THEN NULL WHEN k % 10 = 8 THEN 'projects/-/bad'
  ELSE own_key END AS issued_key FROM gcp)
"""
_KEY_PATH = "projects/[^/]+/serviceAccounts/[^/]+/keys/[^/]+"
_D5 = GCP + f"""SELECT a.source_event_id AS creation_event_id,
 b.source_event_id AS policy_event_id, a.scope_type, a.scope_id,
 (b.ns - a.ns) / 1e9 AS elapsed_seconds, a.issued_key AS created_key_name,
 b.credential_id AS used_key_name, b.resource_name AS policy_resource, a.actor_id AS creator,
 b.actor_id AS policy_actor
FROM keyed a JOIN keyed b ON a.scope_type = b.scope_type AND a.scope_id = b.scope_id
 AND '//iam.googleapis.com/' || a.issued_key = b.credential_id
 AND b.ns > a.ns AND b.ns <= a.ns + 1800000000000
WHERE a.kind = 'signup' AND b.kind = 'purchase' AND a.scope_type = 'gcp.project'
 AND a.outcome = 'success' AND b.outcome = 'success'
 AND regexp_full_match(a.issued_key, '{_KEY_PATH}')"""
_D6 = GCP + """, deltas AS (
 SELECT *, '0' AS delta_index, 'allUsers' AS member, 'roles/storage.objectViewer' AS role
 FROM keyed WHERE kind = 'click' AND k % 2 = 0
 UNION ALL SELECT *, '1', 'allAuthenticatedUsers', 'roles/storage.admin' FROM keyed
 WHERE kind = 'click' AND k % 3 = 0 AND k % 5 = 0)
SELECT source_event_id AS policy_event_id, scope_id, resource_name AS bucket_resource, member,
 role, delta_index, actor_id FROM deltas
WHERE scope_type = 'gcp.project' AND outcome = 'success' AND resource_name IS NOT NULL"""

# ---------------------------------------------------------------- Spark side


def _micros(name: str, alias: str) -> Column:
    return F.unix_micros(name).alias(alias)


def _quality() -> Column:
    return F.array_join(F.array_sort("quality"), ",").alias("quality")


def events_of(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return normalized(spark, sf_dir, source).where(F.size("problems") == 0)


def _flags(*pairs: tuple[str, str]) -> str:
    """Sorted, comma-joined names of the flags whose condition holds."""
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in sorted(pairs))
    return f"concat_ws(',', {cases}) AS quality"


@query(AWS + f"""SELECT id, source_event_id, t AS event_us, t * 1000 AS event_ns,
 'aws.account' AS scope_type, account_id AS scope_id, account_id, actor_id, actor_arn,
 credential_id, source_address, source_ip, service, action, outcome, error_code, issued_key,
 issued_key_owner, policy_arn, policy_target, trail_name, security_group,
 CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mfa,
 CASE kind
  WHEN 'click' THEN '[{{"field":"/requestParameters/groupId","type":"groupId","value":"sg-' || u || '"}}]'
  WHEN 'signup' THEN '[{{"field":"/requestParameters/userName","type":"userName","value":"user-' || u || '"}}]'
  WHEN 'purchase' THEN '[{{"field":"/requestParameters/' || CASE WHEN k % 2 = 0 THEN 'userName","type":"userName'
   ELSE 'roleName","type":"roleName' END || '","value":"target-' || (u % 4)
   || '"}},{{"field":"/requestParameters/policyArn","type":"policyArn","value":"' || policy_arn || '"}}]'
  ELSE '[{{"field":"/requestParameters/name","type":"name","value":"trail-' || (k % 2) || '"}}]'
 END AS resources,
 {_flags(("missing_event_time", "t IS NULL"), ("missing_source_event_id", "source_event_id IS NULL"),
         ("missing_account", "account_id IS NULL"), ("source_address_is_not_ip", "k % 10 = 0"))}
FROM aws""")
def cloudtrail_events(spark, sf_dir):
    """CloudTrail records as event rows."""
    return events_of(spark, sf_dir, "aws.cloudtrail").select(
        "id", "source_event_id", _micros("event_time", "event_us"), "event_ns", "scope_type",
        "scope_id", "account_id", "actor_id", "actor_arn", "credential_id", "source_address",
        "source_ip", "service", "action", "outcome", "error_code", "issued_key",
        "issued_key_owner", "policy_arn", "policy_target", "trail_name", "security_group",
        F.try_variant_get("authentication", "$.mfa_authenticated", "boolean").alias("mfa"),
        F.to_json("resources").alias("resources"), _quality(),
    )


@query(AZURE + f"""SELECT id, source_event_id, t AS event_us, ns AS event_ns,
 'azure.subscription' AS scope_type, scope_id, tenant_id, actor_id, actor_tenant_id, source_ip,
 service, action, outcome, resource_name,
 {_flags(("timestamp_submicrosecond_precision_in_extensions", "t IS NOT NULL AND id % 1000 > 0"),
         ("missing_event_time", "t IS NULL"), ("missing_source_event_id", "source_event_id IS NULL"),
         ("missing_subscription", "scope_id IS NULL"), ("missing_tenant", "tenant_id IS NULL"),
         ("missing_actor_object_id", "actor_id IS NULL"),
         ("missing_actor_tenant_id", "actor_tenant_id IS NULL"),
         ("source_address_is_not_ip", "k % 10 = 0"), ("missing_resource_provider", "k % 8 = 0"))}
FROM azure""")
def azure_activity_events(spark, sf_dir):
    """Azure activity records as event rows, zone offsets and nanoseconds included."""
    return events_of(spark, sf_dir, "azure.activity").select(
        "id", "source_event_id", _micros("event_time", "event_us"), "event_ns", "scope_type",
        "scope_id", "tenant_id", "actor_id", "actor_tenant_id", "source_ip", "service", "action",
        "outcome", "resource_name", _quality(),
    )


_GRAPH_FLAGS = (
    ("missing_collection_tenant", "scope_id IS NULL"),
    ("missing_event_time", "t IS NULL"),
    ("timestamp_submicrosecond_precision_in_extensions", "t IS NOT NULL AND id % 1000 > 0"),
    ("missing_source_event_id", "source_event_id IS NULL"),
    ("missing_actor_id", "actor_id IS NULL"),
)


@query(SIGNIN + f"""SELECT id, source_event_id, ns AS event_ns, 'azure.tenant' AS scope_type,
 scope_id, scope_id AS tenant_id, actor_id, CASE WHEN actor_id IS NOT NULL THEN 'User' END AS actor_type,
 source_ip, 'signIn' AS action, outcome, CASE WHEN v > 100 THEN '50126' END AS error_code,
 risk_level, '[{{"id":"app-' || (k % 5) || '","type":"appId"}}]' AS resources,
 {_flags(*_GRAPH_FLAGS, ("missing_or_invalid_status_error_code", "outcome = 'unknown'"),
         ("source_address_is_not_ip", "k % 10 = 0"))} FROM signin""")
def entra_signin_events(spark, sf_dir):
    """Entra sign-ins as event rows."""
    return events_of(spark, sf_dir, "azure.entra.signin").select(
        "id", "source_event_id", "event_ns", "scope_type", "scope_id", "tenant_id", "actor_id",
        "actor_type", "source_ip", "action", "outcome", "error_code", "risk_level",
        F.to_json("resources").alias("resources"), _quality(),
    )


@query(AUDIT + f"""SELECT id, source_event_id, ns AS event_ns, scope_id, actor_id, actor_type,
 CASE WHEN k <> 62 THEN source_ip END AS source_ip, action, category, outcome,
 {_flags(*_GRAPH_FLAGS, ("ambiguous_initiator", "k = 61"),
         ("missing_or_unknown_result", "outcome = 'unknown'"), ("missing_action", "kind = 'view'"),
         ("source_address_is_not_ip", "k % 10 = 0 AND k <> 62"))} FROM audit""")
def entra_audit_events(spark, sf_dir):
    """Entra directory audits as event rows."""
    return events_of(spark, sf_dir, "azure.entra.audit").select(
        "id", "source_event_id", "event_ns", "scope_id", "actor_id", "actor_type", "source_ip",
        "action", "category", "outcome", _quality(),
    )


@query(GCP + f"""SELECT id, source_event_id, ns AS event_ns, scope_type, scope_id, actor_id,
 credential_id, source_ip, service, action, outcome, error_code, issued_key, resource_name,
 {_flags(("missing_event_time", "t IS NULL"), ("missing_source_event_id", "source_event_id IS NULL"),
         ("unsupported_log_scope", "scope_id IS NULL"), ("missing_scope", "scope_id IS NULL"),
         ("source_address_is_not_ip", "k % 10 = 0"), ("unknown_outcome", "k % 17 = 16"),
         ("operation_completion_unknown", "k % 29 = 28 AND k % 17 <> 16 AND v <= 100"))}
FROM keyed""")
def gcp_audit_events(spark, sf_dir):
    """Google Cloud audit entries as event rows."""
    return events_of(spark, sf_dir, "gcp.audit").select(
        "id", "source_event_id", "event_ns", "scope_type", "scope_id", "actor_id",
        "credential_id", "source_ip", "service", "action", "outcome", "error_code", "issued_key",
        "resource_name", _quality(),
    )


def _pointers(id_path: str, files: DataFrame) -> DataFrame:
    return parse_documents(files).select(
        "file_no",
        "record_pointer",
        F.try_variant_get("record", id_path, "string").alias("record_id"),
        F.col("parse_problem").isNotNull().alias("broken"),
    )


def _pointer_sql(prefix: str, pointer: str) -> str:
    return f"""SELECT event_id // 64 AS file_no, {pointer} AS record_pointer,
 CASE WHEN event_id % 89 <> 0 THEN '{prefix}' || event_id END AS record_id, false AS broken
FROM events"""


_AT = "(row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1)"


@query(_pointer_sql("ev-", f"'/Records/' || {_AT}"))
def cloudtrail_files(spark, sf_dir):
    """Records arrays with their pointers."""
    return _pointers("$.eventID", documents(spark, sf_dir, "aws.cloudtrail"))


@query(_pointer_sql("ev-", f"'line:' || ({_AT} * 2 + 1)"))
def cloudtrail_line_files(spark, sf_dir):
    """Line-delimited files: blank lines are skipped but counted."""
    return _pointers("$.eventID", line_documents(spark, sf_dir))


@query(_pointer_sql("ad-", f"'/value/' || {_AT}"))
def azure_activity_files(spark, sf_dir):
    return _pointers("$.eventDataId", documents(spark, sf_dir, "azure.activity"))


@query(_pointer_sql("si-", f"'/value/' || {_AT}"))
def entra_signin_files(spark, sf_dir):
    return _pointers("$.id", documents(spark, sf_dir, "azure.entra.signin"))


@query(_pointer_sql("au-", f"'/value/' || {_AT}"))
def entra_audit_files(spark, sf_dir):
    return _pointers("$.id", documents(spark, sf_dir, "azure.entra.audit"))


@query(_pointer_sql("ins-", f"CASE WHEN event_id // 64 % 2 = 0 THEN '/' ELSE '/entries/' END || {_AT}"))
def gcp_audit_files(spark, sf_dir):
    """Bare arrays and entries envelopes."""
    return _pointers("$.insertId", documents(spark, sf_dir, "gcp.audit"))


def _rule(spark: SparkSession, sf_dir: str, rule_id: str, drop: tuple, revision=BASELINE) -> DataFrame:
    rule = RULES.rules(revision)[rule_id]
    return rule.matches(stored(spark, sf_dir, rule.source)).drop(*drop)


_PAIR_HIDDEN = ("start_uid", "end_uid", "started_at", "ended_at")


@query(_D1)
def aws_new_key_admin_attach(spark, sf_dir):
    return _rule(spark, sf_dir, "aws_new_key_admin_attach", _PAIR_HIDDEN)


@query(_D2)
def aws_log_stop_public_ingress(spark, sf_dir):
    return _rule(spark, sf_dir, "aws_log_stop_public_ingress", _PAIR_HIDDEN)


@query(_D2R)
def aws_log_stop_public_ingress_restart_aware(spark, sf_dir):
    return _rule(spark, sf_dir, "aws_log_stop_public_ingress", _PAIR_HIDDEN, RESTART_AWARE)


@query(_D3)
def azure_diag_delete_role_assign(spark, sf_dir):
    return _rule(
        spark, sf_dir, "azure_diag_delete_role_assign", (*_PAIR_HIDDEN, "scope_type")
    )


@query(_D4_OUT)
def entra_sp_cred_app_role(spark, sf_dir):
    return _rule(
        spark, sf_dir, "entra_sp_cred_app_role",
        ("credential_uid", "assignment_uid", "scope_type", "tenant_id", "credential_added_at",
         "role_assigned_at"),
    )


@query(_D5)
def gcp_new_key_set_policy(spark, sf_dir):
    return _rule(
        spark, sf_dir, "gcp_new_key_set_policy",
        ("creation_uid", "policy_uid", "created_at", "policy_at"),
    )


@query(_D6)
def gcp_bucket_public_grant(spark, sf_dir):
    return _rule(
        spark, sf_dir, "gcp_bucket_public_grant", ("policy_uid", "scope_type", "event_time")
    )


_H1_FROM = """FROM (SELECT * FROM aws WHERE kind = 'signup' AND outcome = 'success') a
LEFT JOIN aws b ON a.account_id = b.account_id AND a.issued_key = b.credential_id
 AND b.t >= a.t AND b.t <= a.t + 5400000000 AND a.id <> b.id"""


@query(AWS + f"""SELECT a.source_event_id AS creation_event_id, a.account_id, a.t AS created_us,
 a.actor_arn AS creator, a.issued_key AS issued_key_id,
 CASE WHEN a.issued_key IS NULL OR a.t IS NULL OR a.account_id IS NULL THEN 'unresolvable'
  WHEN count(b.id) = 0 THEN 'no_use_observed' ELSE 'use_observed' END AS observation,
 min(b.t) AS first_us, max(b.t) AS last_us, count(b.id) AS event_count,
 count(DISTINCT b.service) AS distinct_services, count(DISTINCT b.action) AS distinct_actions,
 count(DISTINCT b.source_ip) AS distinct_source_ips,
 count(*) FILTER (WHERE b.outcome = 'failure') AS failures,
 count(*) FILTER (WHERE b.kind IN ('purchase', 'error', 'click')) AS sensitive_actions
{_H1_FROM} GROUP BY a.id, a.source_event_id, a.account_id, a.t, a.actor_arn, a.issued_key""")
def hunt_aws_key_first_use(spark, sf_dir):
    """First ninety minutes of every new access key."""
    found = aws_key_first_use(stored(spark, sf_dir, "aws.cloudtrail"), 1.5).leads
    return found.select(
        "creation_event_id", "account_id", _micros("created_at", "created_us"), "creator",
        "issued_key_id", "observation", _micros("first_use", "first_us"),
        _micros("last_use", "last_us"), "event_count", "distinct_services", "distinct_actions",
        "distinct_source_ips", "failures", "sensitive_actions",
    )


@query(AWS + f"SELECT a.t AS created_us, b.t AS used_us, b.source_event_id AS source_event_id"
       f" {_H1_FROM} WHERE b.id IS NOT NULL")
def hunt_aws_key_first_use_events(spark, sf_dir):
    """The uses behind the leads, one row each."""
    found = aws_key_first_use(stored(spark, sf_dir, "aws.cloudtrail"), 1.5)
    created = found.leads.select("creation_uid", _micros("created_at", "created_us"))
    return found.lead_events.join(created, "creation_uid").select(
        "created_us", F.expr("event_ns div 1000").alias("used_us"), "source_event_id"
    )


@query(_H2.format(hours="2") + """SELECT scope_id, actor_id,
 (scope_id IS NULL OR actor_id IS NULL) AS alone, min(t) AS first_us, max(t) AS last_us,
 count(*) AS signins, count(*) FILTER (WHERE outcome = 'failure') AS failures,
 count(*) FILTER (WHERE outcome = 'success') AS successes,
 count(*) FILTER (WHERE outcome = 'unknown') AS unknown_outcomes,
 count(DISTINCT source_ip) AS distinct_source_ips,
 count(*) FILTER (WHERE risk_level IN ('medium', 'high')) AS elevated_risk_observations,
 count(*) FILTER (WHERE risk_level IS NULL OR risk_level NOT IN ('none', 'low', 'medium', 'high'))
  AS unavailable_risk_observations, count(*) AS mfa_outcome_unknown
FROM selected GROUP BY scope_id, actor_id, lone""")
def hunt_entra_signin_inventory(spark, sf_dir):
    """Sign-ins within two hours of each user's first."""
    found = entra_signin_inventory(stored(spark, sf_dir, "azure.entra.signin"), 2).leads
    return found.select(
        "scope_id", "actor_id", F.col("unresolved_event_uid").isNotNull().alias("alone"),
        _micros("first_observed", "first_us"), _micros("last_observed", "last_us"), "signins",
        "failures", "successes", "unknown_outcomes", "distinct_source_ips",
        "elevated_risk_observations", "unavailable_risk_observations", "mfa_outcome_unknown",
    )


@query(_H2.format(hours="2") + "SELECT scope_id, actor_id, source_event_id, ns AS event_ns FROM selected")
def hunt_entra_signin_events(spark, sf_dir):
    found = entra_signin_inventory(stored(spark, sf_dir, "azure.entra.signin"), 2).lead_events
    return found.select("scope_id", "actor_id", "source_event_id", "event_ns")


_H3_FROM = f"""FROM (SELECT * FROM keyed WHERE kind = 'signup'
  AND outcome IN ('success', 'unknown')) a LEFT JOIN keyed b
 ON a.scope_type = b.scope_type AND a.scope_id = b.scope_id
 AND regexp_full_match(a.issued_key, '{_KEY_PATH}')
 AND '//iam.googleapis.com/' || a.issued_key = b.credential_id
 AND b.ns >= a.ns AND b.ns <= a.ns + 5400000000000 AND a.id <> b.id"""


@query(GCP + f"""SELECT a.source_event_id AS creation_event_id, a.scope_type, a.scope_id,
 a.t AS created_us, a.issued_key AS key_name, a.outcome AS creation_outcome,
 CASE WHEN a.issued_key IS NULL OR a.t IS NULL OR a.scope_id IS NULL
  OR NOT regexp_full_match(a.issued_key, '{_KEY_PATH}') THEN 'unresolvable'
  WHEN count(b.id) = 0 THEN 'no_use_observed' ELSE 'use_observed' END AS observation,
 min(b.t) AS first_us, max(b.t) AS last_us, count(b.id) AS event_count,
 count(DISTINCT b.service) AS distinct_services, count(DISTINCT b.action) AS distinct_actions,
 count(*) FILTER (WHERE b.outcome = 'failure') AS failures {_H3_FROM}
GROUP BY a.id, a.source_event_id, a.scope_type, a.scope_id, a.t, a.issued_key, a.outcome""")
def hunt_gcp_key_use(spark, sf_dir):
    """First ninety minutes of every new service-account key."""
    found = gcp_key_use(stored(spark, sf_dir, "gcp.audit"), 1.5).leads
    return found.select(
        "creation_event_id", "scope_type", "scope_id", _micros("created_at", "created_us"),
        "key_name", "creation_outcome", "observation", _micros("first_use", "first_us"),
        _micros("last_use", "last_us"), "event_count", "distinct_services", "distinct_actions",
        "failures",
    )


@query(GCP + f"""SELECT a.ns AS created_ns, b.ns AS used_ns, b.source_event_id AS source_event_id
 {_H3_FROM} WHERE b.id IS NOT NULL""")
def hunt_gcp_key_use_events(spark, sf_dir):
    events = stored(spark, sf_dir, "gcp.audit")
    found = gcp_key_use(events, 1.5)
    created = events.select(
        F.col("event_uid").alias("creation_uid"), F.col("event_ns").alias("created_ns")
    )
    return found.lead_events.join(created, "creation_uid").select(
        "created_ns", F.col("event_ns").alias("used_ns"), "source_event_id"
    )


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, *[job.source for job in SOURCES]).drop("id")


def _counted(sql: str, rule_id: str, key: str) -> str:
    return (
        f"SELECT '{rule_id}' AS rule_id, count(DISTINCT ({key})) AS findings, count(*) AS matches"
        f" FROM ({sql}) AS found"
    )


_PAIR_KEY = "start_row, end_row"
_WITH_ROWS = lambda sql: sql.replace(
    "SELECT a.source_event_id", "SELECT a.id AS start_row, b.id AS end_row, a.source_event_id", 1
)


def _finding_counts(d2: str) -> str:
    return " UNION ALL ".join(
        [
            _counted(_WITH_ROWS(_D1), "aws_new_key_admin_attach", _PAIR_KEY),
            _counted(_WITH_ROWS(d2), "aws_log_stop_public_ingress", _PAIR_KEY),
            _counted(_WITH_ROWS(_D3), "azure_diag_delete_role_assign", _PAIR_KEY),
            _counted(_D4, "entra_sp_cred_app_role", "first_row, second_row"),
            _counted(_WITH_ROWS(_D5), "gcp_new_key_set_policy", _PAIR_KEY),
            _counted(
                _D6.replace("SELECT source_event_id AS", "SELECT id, source_event_id AS", 1),
                "gcp_bucket_public_grant",
                "id, id",
            ),
        ]
    )


def _summary(events: DataFrame, revision: str = BASELINE) -> DataFrame:
    """Findings and matches of every rule of the revision; a rule that found nothing has 0."""
    found = detect(events, revision).findings.select(
        "rule_id", F.lit(1).cast("long").alias("findings"), "matches"
    )
    none = events.sparkSession.createDataFrame(
        [(rule_id, 0, 0) for rule_id in RULES.rules(revision)],
        "rule_id string, findings long, matches long",
    )
    return found.unionByName(none).groupBy("rule_id").agg(
        F.sum("findings").alias("findings"), F.sum("matches").alias("matches")
    )


@query(_finding_counts(_D2))
def findings_baseline(spark, sf_dir):
    """All rules over all sources: findings and matches per rule."""
    return _summary(all_events(spark, sf_dir))


@query(_finding_counts(_D2R))
def findings_restart_aware(spark, sf_dir):
    return _summary(all_events(spark, sf_dir), RESTART_AWARE)


_TIMELINE = f""", pairs AS ({_WITH_ROWS(_D1).removeprefix(AWS)}),
spans AS (SELECT p.start_row, p.end_row, a.account_id, a.t AS t0, b.t AS t1 FROM pairs p
 JOIN aws a ON a.id = p.start_row JOIN aws b ON b.id = p.end_row)
SELECT s.t0 AS start_us, s.t1 AS end_us, e.source_event_id, e.t AS event_us, e.action
FROM spans s JOIN aws e ON e.account_id = s.account_id AND e.t BETWEEN s.t0 AND s.t1"""


@query(AWS + _TIMELINE)
def finding_timelines(spark, sf_dir):
    """Context of every finding of one rule at once."""
    events = stored(spark, sf_dir, "aws.cloudtrail").drop("id")
    rules = RULES.for_source("aws", "aws.cloudtrail")
    findings = detect(events, rules=rules).findings.where("rule_id = 'aws_new_key_admin_attach'")
    timeline = context_timeline(findings, events, HOUR_NS // 12, ends=True)
    return timeline.select(
        F.col("span_start").alias("start_us"), F.col("span_end").alias("end_us"), "source_event_id",
        _micros("event_time", "event_us"), "action",
    )


@query(AWS + _TIMELINE.rpartition("SELECT s.t0")[0] + """SELECT e.source_event_id, e.account_id, e.t AS event_us,
 min(s.t0) AS first_us, max(s.t1) AS last_us, count(*) AS findings
FROM (SELECT DISTINCT start_row, end_row, account_id, t0, t1 FROM spans) s
JOIN aws e ON e.account_id = s.account_id AND e.t BETWEEN s.t0 AND s.t1
GROUP BY e.id, e.source_event_id, e.account_id, e.t""")
def timeline_spans(spark, sf_dir):
    """Every event in the span of any finding of one rule, once, with the findings that
    point to it."""
    events = stored(spark, sf_dir, "aws.cloudtrail").drop("id")
    rules = RULES.for_source("aws", "aws.cloudtrail")
    findings = detect(events, rules=rules).findings.where("rule_id = 'aws_new_key_admin_attach'")
    return timeline_index(findings, events).covered().select(
        "source_event_id", F.col("scope_id").alias("account_id"), "event_us", F.col("first_start").alias("first_us"),
        F.col("last_end").alias("last_us"), F.col("spans").alias("findings"),
    )


@query("""SELECT 'aws.cloudtrail' AS source, count(*) AS records, 0::BIGINT AS violations FROM events
UNION ALL SELECT 'azure.activity', count(*), 0 FROM events
UNION ALL SELECT 'azure.entra.signin', count(*), 0 FROM events
UNION ALL SELECT 'azure.entra.audit', count(*), 0 FROM events
UNION ALL SELECT 'gcp.audit', count(*), 0 FROM events""")
def event_contract(spark, sf_dir):
    """Every normalised row of every source meets the event and scope contracts."""
    events = all_events(spark, sf_dir).withColumn("row", F.col("event_uid"))
    events = events.withColumns(
        {f"declared_{c}": F.col(c) for c in ("scope_type", "scope_id", "tenant_id")}
    )
    rules = {**event_rules(), **scope_rules(), **declared_scope_rules()}
    broken = violations(events, ["source"], rules).groupBy("source").count()
    totals = events.groupBy("source").agg(F.count("*").alias("records"))
    return totals.join(broken, "source", "left").select(
        "source", "records", F.coalesce("count", F.lit(0)).alias("violations")
    )


# Damage done to a row, by its number, and the rules that must tell it.
_DAMAGE = {
    0: ({"outcome": "'maybe'"}, "outcome"),
    1: ({"service": "''"}, "empty:service"),
    2: ({"action": "NULL"}, "null:action"),
    3: ({"scope_type": "'gcp.project'"}, "scope_type,declared_scope_type"),
    4: ({"scope_type": "NULL", "scope_id": "'x'"}, "scope_id_without_type,declared_scope_type,declared_scope_id"),
    5: ({"tenant_id": "'t'"}, "tenant_without_meaning"),
    6: ({"declared_scope_id": "'other'"}, "declared_scope_id"),
    7: ({"provider": "'gcp'"}, "provider_source,scope_type"),
    8: ({"event_uid": "'evt_x'"}, "event_uid"),
    9: ({"resources": "parse_json('{}')"}, "shape:resources"),
    10: ({"raw": "parse_json('[]')"}, "shape:raw"),
    11: ({"declared_tenant_id": "'t'"}, "declared_tenant_id"),
}


@query(
    "SELECT rule, count(*) AS n FROM (SELECT event_id, unnest(CASE event_id % 13 "
    + " ".join(f"WHEN {k} THEN string_split('{rules}', ',')" for k, (_, rules) in _DAMAGE.items())
    + " END) AS rule FROM events WHERE user_id % 22 <> 0) AS broken GROUP BY rule"
)
def event_contract_damaged(spark, sf_dir):
    """Rows damaged in a known way: every rule of the contracts tells just its own."""
    events = stored(spark, sf_dir, "aws.cloudtrail").where("scope_id IS NOT NULL")
    before = {f"declared_{c}": F.col(c) for c in ("scope_type", "scope_id", "tenant_id")}
    rows = events.withColumns(before)
    changes: dict[str, str] = {}
    for number, (damage, _) in _DAMAGE.items():
        for name, value in damage.items():
            changes[name] = changes.get(name, "CASE id % 13") + f" WHEN {number} THEN {value}"
    rows = rows.withColumns({n: F.expr(f"{text} ELSE {n} END") for n, text in changes.items()})
    rules = {**event_rules(), **scope_rules(), **declared_scope_rules()}
    return violations(rows, ["id"], rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'invalid_event_time'
 WHEN event_id % 5 = 1 THEN 'missing_action,missing_service' WHEN event_id % 5 = 2 THEN
 'record_not_object' WHEN event_id % 5 = 3 THEN 'missing_action' ELSE '' END AS problems
FROM events""")
def refused_records(spark, sf_dir):
    """Damaged CloudTrail records and why each is refused; sound ones pass through."""
    texts = record_texts(spark, sf_dir, "aws.cloudtrail")
    damaged = texts.withColumn(
        "text",
        F.expr("""CASE id % 5
          WHEN 0 THEN '{"eventSource":"s","eventName":"n","eventTime":"2024-01-01T00:00:00"}'
          WHEN 1 THEN '{"eventSource":"","eventName":7}'
          WHEN 2 THEN '[1]' WHEN 3 THEN replace(text, '"eventName"', '"name"') ELSE text END"""),
    ).withColumn("record", F.parse_json("text")).drop("text")
    job = SOURCES[0]
    # A record that is no object lacks everything else too; report that alone.
    reasons = F.when(
        F.array_contains("problems", "record_not_object"), F.array(F.lit("record_not_object"))
    ).otherwise(F.array_sort("problems"))
    return job.normalize(damaged).select("id", F.array_join(reasons, ",").alias("problems"))


@query("""SELECT 'ev-' || (event_id - event_id % 4) AS source_event_id, count(*) AS deliveries
FROM events WHERE (event_id - event_id % 4) % 89 <> 0
GROUP BY 1, CASE WHEN user_id % 22 <> 0 THEN user_id % 5 END HAVING count(DISTINCT event_id) > 1""")
def conflicting_payloads(spark, sf_dir):
    """Different payloads under one source id within one account, an unknown one too."""
    events = stored(spark, sf_dir, "aws.cloudtrail")
    group = F.expr("id - id % 4")
    shared = events.withColumn(
        "source_event_id", F.when(group % 89 != 0, F.concat(F.lit("ev-"), group))
    )
    found = source_id_conflicts(shared)
    keys = ["scope_id", "source_event_id"]
    clash = found.select(F.col("scope_id").alias("c_scope"), F.col("source_event_id").alias("c_id"))
    same = F.col("scope_id").eqNullSafe(F.col("c_scope")) & (F.col("source_event_id") == F.col("c_id"))
    return (
        shared.join(clash, same, "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("deliveries"))
        .select("source_event_id", "deliveries")
    )


assert set(RECORDS) == {job.source for job in SOURCES}
