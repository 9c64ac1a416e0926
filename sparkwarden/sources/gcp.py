"""Google Cloud audit records (LogEntry holding an AuditLog payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG, scoped_uid
from sparkwarden.functions.instants import instant
from sparkwarden.functions.json_access import (
    Members,
    boolean_at,
    integer_at,
    is_empty_object,
    is_object,
    loose_text,
    object_at,
    text_at,
    value_at,
    variant_object,
)
from sparkwarden.sources.normalize import (
    STAMP_TEXT,
    finish,
    not_an_ip,
    prepared,
    reasons,
    source_ip,
    typed_reference,
    variant_list,
)

# Fixed formats and values.
AUDIT_TYPE = "type.googleapis.com/google.cloud.audit.AuditLog"
MEMBERS = ("logName", "insertId", "timestamp", "resource", "operation", "protoPayload")
INNER = {
    "protoPayload": (
        "serviceName", "methodName", "resourceName", "status", "requestMetadata", "authenticationInfo",
        "authorizationInfo", "response", "serviceData",
    )
}
LOG_NAME = r"^(projects|organizations|folders)/([^/]+)/logs/([^/]+)\z"
SCOPES = {
    "projects": "gcp.project",
    "organizations": "gcp.organization",
    "folders": "gcp.folder",
}


def normalize_gcp_audit(records: DataFrame, tag: str = IDENTITY_TAG) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    r = Members("record", MEMBERS, INNER)
    stamp = instant(F.col(STAMP_TEXT))
    owner = F.regexp_extract(F.col("log_name_"), LOG_NAME, 1)
    kinds = F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair])
    status_given = is_object(r, "$.protoPayload.status")
    staged = (
        prepared(
            records,
            {
                "event_time_": stamp.time,
                "nanos_": stamp.nanos,
                "time_refused_": stamp.refused,
                "log_name_": text_at(r, "$.logName"),
                "insert_id_": text_at(r, "$.insertId"),
                "service_": text_at(r, "$.protoPayload.serviceName"),
                "action_": text_at(r, "$.protoPayload.methodName"),
                "address_": text_at(r, "$.protoPayload.requestMetadata.callerIp"),
                "resource_": text_at(r, "$.protoPayload.resourceName"),
                "code_": F.when(status_given, integer_at(r, "$.protoPayload.status.code")),
                "empty_status_": is_empty_object(r, "$.protoPayload.status"),
                "pending_": is_object(r, "$.operation")
                & ~is_empty_object(r, "$.operation")
                & ~F.coalesce(boolean_at(r, "$.operation.last"), F.lit(False)),
            },
            r,
            text_at(r, "$.timestamp"),
        )
        .withColumns(
            {
                "scope_type_": F.try_element_at(kinds, owner),
                "scope_id_": F.nullif(
                    F.regexp_extract(F.col("log_name_"), LOG_NAME, 2), F.lit("")
                ),
                "ip_": source_ip(F.col("address_")),
                "reported_": F.when(F.col("code_") == 0, "success")
                .when(F.col("code_") != 0, "failure")
                .when(F.col("empty_status_"), "success")
                .otherwise("unknown"),
                "source_id_": F.when(
                    F.col("insert_id_").isNotNull() & F.col(STAMP_TEXT).isNotNull(),
                    F.to_json(F.array("insert_id_", STAMP_TEXT)),
                ),
            }
        )
        .withColumn("held_", F.col("pending_") & (F.col("reported_") == "success"))
    )
    return finish(
        staged,
        keep,
        {
            "event_uid": scoped_uid(
                r.whole(),
                F.lit("gcp"),
                F.lit("gcp.audit"),
                F.col("scope_type_"),
                F.col("scope_id_"),
                F.lit(None).cast("string"),
                tag,
            ),
            "source_event_id": F.col("source_id_"),
            "provider": F.lit("gcp"),
            "source": F.lit("gcp.audit"),
            "scope_type": F.col("scope_type_"),
            "scope_id": F.col("scope_id_"),
            "actor_id": text_at(r, "$.protoPayload.authenticationInfo.principalSubject"),
            "credential_id": text_at(
                r, "$.protoPayload.authenticationInfo.serviceAccountKeyName"
            ),
            "source_address": F.col("address_"),
            "source_ip": F.col("ip_"),
            "service": F.col("service_"),
            "action": F.col("action_"),
            "outcome": F.when(F.col("held_"), "unknown").otherwise(F.col("reported_")),
            "error_code": F.when(F.col("code_") != 0, F.col("code_").cast("string")),
            "resources": variant_list(typed_reference("gcp.resource", F.col("resource_"))),
            "authentication": object_at(r, "$.protoPayload.authenticationInfo"),
            "privilege_context": variant_object(
                authorizationInfo=value_at(r, "$.protoPayload.authorizationInfo")
            ),
            "extensions": variant_object(
                logName=value_at(r, "$.logName"),
                insertId=value_at(r, "$.insertId"),
                resource=value_at(r, "$.resource"),
                protoPayload=object_at(r, "$.protoPayload"),
                operation=value_at(r, "$.operation"),
                timestamp=value_at(r, "$.timestamp"),
                submicrosecond_nanos=F.col("nanos_"),
            ),
            "quality": reasons(
                ("missing_event_time", F.col("nanos_").isNull()),
                (
                    "unsupported_log_scope",
                    F.col("log_name_").isNotNull() & F.col("scope_id_").isNull(),
                ),
                ("missing_scope", F.col("scope_id_").isNull()),
                ("missing_source_event_id", F.col("source_id_").isNull()),
                ("source_address_is_not_ip", not_an_ip(F.col("address_"), F.col("ip_"))),
                ("unknown_outcome", F.col("reported_") == "unknown"),
                ("operation_completion_unknown", F.col("held_")),
            ),
            "issued_key": loose_text(r, "$.protoPayload.response.name"),
            "resource_name": loose_text(r, "$.protoPayload.resourceName"),
            "resource_type": loose_text(r, "$.resource.type"),
            "delta_type": loose_text(r, '$.protoPayload.serviceData["@type"]'),
            "binding_deltas": value_at(r, "$.protoPayload.serviceData.policyDelta.bindingDeltas"),
        },
        [
            (
                "not_an_audit_log",
                ~F.coalesce(text_at(r, '$.protoPayload["@type"]') == AUDIT_TYPE, F.lit(False)),
            ),
            ("invalid_event_time", F.col("time_refused_")),
            ("missing_service", F.col("service_").isNull()),
            ("missing_action", F.col("action_").isNull()),
        ],
    )
