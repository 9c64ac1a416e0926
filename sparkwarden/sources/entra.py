"""Microsoft Entra sign-in and directory-audit records (Graph v1.0 shapes).

The owning tenant is the one the collection declares; a guest's home tenant in
the record is never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG, scoped_uid
from sparkwarden.functions.instants import instant
from sparkwarden.functions.json_access import (
    Members,
    get_at,
    integer_at,
    is_empty_object,
    is_object,
    loose_text,
    text_at,
    value_at,
    variant_object,
)
from sparkwarden.sources.normalize import STAMP_TEXT, finish, not_an_ip, prepared, reasons, source_ip

SERVICE = "Microsoft Entra ID"
SIGNIN = Members(
    "record",
    ("id", "createdDateTime", "userId", "ipAddress", "appId", "resourceId", "status", "category",
     "conditionalAccessStatus", "isInteractive", "riskLevelDuringSignIn"),
)
AUDIT = Members(
    "record",
    ("id", "activityDateTime", "activityDisplayName", "category", "result", "initiatedBy", "targetResources"),
)


def _graph_stage(records: DataFrame, r: Members, time_path: str, address: Column) -> DataFrame:
    stamp = instant(F.col(STAMP_TEXT))
    return prepared(
        records,
        {
            "event_time_": stamp.time,
            "nanos_": stamp.nanos,
            "time_refused_": stamp.refused,
            "event_id_": text_at(r, "$.id"),
            "address_": address,
        },
        r,
        text_at(r, time_path),
    ).withColumns(
        {
            "ip_": source_ip(F.col("address_")),
            "tenant_": F.coalesce("declared_scope_id", "declared_tenant_id"),
        }
    )


def _graph_fields(r: Members, source: str, tag: str) -> dict[str, Column]:
    tenant = F.col("tenant_")
    return {
        "event_uid": scoped_uid(
            r.whole(), F.lit("azure"), F.lit(source), F.lit("azure.tenant"), tenant, tenant, tag
        ),
        "source_event_id": F.col("event_id_"),
        "provider": F.lit("azure"),
        "source": F.lit(source),
        "scope_type": F.lit("azure.tenant"),
        "scope_id": tenant,
        "tenant_id": tenant,
        "service": F.lit(SERVICE),
        "source_address": F.col("address_"),
        "source_ip": F.col("ip_"),
        "extensions": variant_object(graph=r.whole(), timestamp_submicrosecond_ns=F.col("nanos_")),
        "category": loose_text(r, "$.category"),
    }


def _graph_quality() -> list[tuple[str, Column]]:
    return [
        ("missing_collection_tenant", F.col("tenant_").isNull()),
        ("missing_event_time", F.col("nanos_").isNull()),
        ("timestamp_submicrosecond_precision_in_extensions", F.col("nanos_") > 0),
        ("missing_source_event_id", F.col("event_id_").isNull()),
    ]


def _graph_problems() -> list[tuple[str, Column]]:
    return [
        ("invalid_event_time", F.col("time_refused_")),
        ("collection_scope_not_tenant", F.col("declared_scope_type") != "azure.tenant"),
        (
            "collection_tenants_differ",
            F.col("declared_scope_id") != F.col("declared_tenant_id"),
        ),
    ]


def normalize_entra_signin(records: DataFrame, tag: str = IDENTITY_TAG) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    r = SIGNIN
    staged = _graph_stage(records, r, "$.createdDateTime", text_at(r, "$.ipAddress")).withColumns(
        {"code_": integer_at(r, "$.status.errorCode"), "actor_": text_at(r, "$.userId")}
    )
    code, actor = F.col("code_"), F.col("actor_")
    listed = [
        F.when(
            text_at(r, f"$.{key}").isNotNull(),
            F.to_variant_object(F.struct(F.lit(key).alias("type"), text_at(r, f"$.{key}").alias("id"))),
        )
        for key in ("appId", "resourceId")
    ]
    return finish(
        staged,
        keep,
        {
            **_graph_fields(r, "azure.entra.signin", tag),
            "action": F.lit("signIn"),
            "actor_id": actor,
            "actor_type": F.when(actor.isNotNull(), "User"),
            "outcome": F.when(code == 0, "success")
            .when(code != 0, "failure")
            .otherwise("unknown"),
            "error_code": F.when(code != 0, code.cast("string")),
            "resources": F.to_variant_object(F.array_compact(F.array(*listed))),
            "authentication": variant_object(
                mfa_authenticated=F.lit(None).cast("boolean"),
                conditionalAccessStatus=value_at(r, "$.conditionalAccessStatus"),
                status=value_at(r, "$.status"),
                isInteractive=value_at(r, "$.isInteractive"),
            ),
            "privilege_context": F.parse_json(F.lit("{}")),
            "quality": reasons(
                *_graph_quality(),
                ("missing_or_invalid_status_error_code", code.isNull()),
                ("missing_actor_id", actor.isNull()),
                ("source_address_is_not_ip", not_an_ip(F.col("address_"), F.col("ip_"))),
            ),
            "risk_level": loose_text(r, "$.riskLevelDuringSignIn"),
        },
        _graph_problems(),
    )


def normalize_entra_audit(records: DataFrame, tag: str = IDENTITY_TAG) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    r = AUDIT
    filled = lambda path: is_object(r, path) & ~is_empty_object(r, path)
    staged = _graph_stage(
        records, r, "$.activityDateTime", text_at(r, "$.initiatedBy.user.ipAddress")
    ).withColumns(
        {
            "both_": filled("$.initiatedBy.user") & filled("$.initiatedBy.app"),
            "user_": text_at(r, "$.initiatedBy.user.id"),
            "app_": text_at(r, "$.initiatedBy.app.servicePrincipalId"),
            "action_": text_at(r, "$.activityDisplayName"),
            "result_": text_at(r, "$.result"),
        }
    )
    actor = F.when(~F.col("both_"), F.coalesce("user_", "app_"))
    kind = F.when(~F.col("both_") & F.col("user_").isNotNull(), "User").when(
        ~F.col("both_") & F.col("app_").isNotNull(), "ServicePrincipal"
    )
    known = F.coalesce(F.col("result_").isin("success", "failure"), F.lit(False))
    targets = F.coalesce(
        get_at(r, "$.targetResources", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    return finish(
        staged,
        keep,
        {
            **_graph_fields(r, "azure.entra.audit", tag),
            "action": F.coalesce("action_", F.lit("unknown")),
            "actor_id": actor,
            "actor_type": kind,
            "outcome": F.when(known, F.col("result_")).otherwise("unknown"),
            "resources": F.to_variant_object(targets),
            "authentication": F.parse_json(F.lit("{}")),
            "privilege_context": F.parse_json(F.lit("{}")),
            "quality": reasons(
                *_graph_quality(),
                ("ambiguous_initiator", F.col("both_")),
                ("missing_actor_id", actor.isNull()),
                ("source_address_is_not_ip", not_an_ip(F.col("address_"), F.col("ip_"))),
                ("missing_or_unknown_result", ~known),
                ("missing_action", F.col("action_").isNull()),
            ),
            "target_resources": value_at(r, "$.targetResources"),
        },
        _graph_problems(),
    )
