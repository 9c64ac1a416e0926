"""Azure activity log records (REST event data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG, scoped_uid
from sparkwarden.functions.instants import instant
from sparkwarden.functions.json_access import Members, loose_text, text_at, value_at, variant_object
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

# Claim names, and members copied into ``extensions``.
ACTOR_CLAIM = '$.claims["http://schemas.microsoft.com/identity/claims/objectidentifier"]'
TENANT_CLAIM = '$.claims["http://schemas.microsoft.com/identity/claims/tenantid"]'
EXTENSION_FIELDS = (
    "caller", "claims", "authorization", "correlationId", "operationId", "category", "status",
    "subStatus", "properties", "subscriptionId", "tenantId", "resourceProviderName",
    "resourceGroupName",
)
MEMBERS = (
    *EXTENSION_FIELDS, "eventTimestamp", "eventDataId", "httpRequest", "operationName", "resourceId",
)
UNNAMED_SERVICE = "azure.monitor.activity"


def normalize_azure_activity(records: DataFrame, tag: str = IDENTITY_TAG) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    r = Members("record", MEMBERS)
    stamp = instant(F.col(STAMP_TEXT))
    staged = prepared(
        records,
        {
            "event_time_": stamp.time,
            "nanos_": stamp.nanos,
            "time_refused_": stamp.refused,
            "own_subscription_": text_at(r, "$.subscriptionId"),
            "own_tenant_": text_at(r, "$.tenantId"),
            "address_": text_at(r, "$.httpRequest.clientIpAddress"),
            "event_id_": text_at(r, "$.eventDataId"),
            "actor_": text_at(r, ACTOR_CLAIM),
            "actor_tenant_": text_at(r, TENANT_CLAIM),
            "service_": text_at(r, "$.resourceProviderName.value"),
            "action_": text_at(r, "$.operationName.value"),
            "status_": F.lower(text_at(r, "$.status.value")),
            "resource_": text_at(r, "$.resourceId"),
        },
        r,
        text_at(r, "$.eventTimestamp"),
    ).withColumns(
        {
            "ip_": source_ip(F.col("address_")),
            "subscription_": F.coalesce("own_subscription_", "declared_scope_id"),
            "tenant_": F.coalesce("own_tenant_", "declared_tenant_id"),
        }
    )
    declared_any = F.coalesce("declared_scope_type", "declared_scope_id", "declared_tenant_id")
    return finish(
        staged,
        keep,
        {
            "event_uid": scoped_uid(
                r.whole(),
                F.lit("azure"),
                F.lit("azure.activity"),
                F.lit("azure.subscription"),
                F.col("subscription_"),
                F.col("tenant_"),
                tag,
            ),
            "source_event_id": F.col("event_id_"),
            "provider": F.lit("azure"),
            "source": F.lit("azure.activity"),
            "scope_type": F.lit("azure.subscription"),
            "scope_id": F.col("subscription_"),
            "tenant_id": F.col("tenant_"),
            "actor_id": F.col("actor_"),
            "source_address": F.col("address_"),
            "source_ip": F.col("ip_"),
            "service": F.coalesce("service_", F.lit(UNNAMED_SERVICE)),
            "action": F.col("action_"),
            "outcome": F.when(F.col("status_") == "succeeded", "success")
            .when(F.col("status_") == "failed", "failure")
            .otherwise("unknown"),
            "resources": variant_list(
                typed_reference("azure.resource", F.col("resource_"), "/resourceId")
            ),
            "authentication": variant_object(claims=value_at(r, "$.claims")),
            "privilege_context": variant_object(authorization=value_at(r, "$.authorization")),
            "extensions": variant_object(
                actor_tenant_id=F.col("actor_tenant_"),
                timestamp_submicrosecond_ns=F.col("nanos_"),
                collection_scope=F.when(
                    declared_any.isNotNull(),
                    variant_object(
                        scope_type=F.col("declared_scope_type"),
                        scope_id=F.col("declared_scope_id"),
                        tenant_id=F.col("declared_tenant_id"),
                    ),
                ),
                **{name: value_at(r, f"$.{name}") for name in EXTENSION_FIELDS},
            ),
            "quality": reasons(
                ("timestamp_submicrosecond_precision_in_extensions", F.col("nanos_") > 0),
                ("missing_event_time", F.col("nanos_").isNull()),
                ("missing_source_event_id", F.col("event_id_").isNull()),
                ("missing_subscription", F.col("subscription_").isNull()),
                ("missing_tenant", F.col("tenant_").isNull()),
                ("missing_actor_object_id", F.col("actor_").isNull()),
                ("missing_actor_tenant_id", F.col("actor_tenant_").isNull()),
                ("source_address_is_not_ip", not_an_ip(F.col("address_"), F.col("ip_"))),
                ("missing_resource_provider", F.col("service_").isNull()),
            ),
            "actor_tenant_id": F.col("actor_tenant_"),
            "resource_name": loose_text(r, "$.resourceId"),
            "category": loose_text(r, "$.category"),
        },
        [
            ("invalid_event_time", F.col("time_refused_")),
            ("missing_action", F.col("action_").isNull()),
            (
                "collection_scope_not_subscription",
                F.col("declared_scope_type") != "azure.subscription",
            ),
            (
                "subscription_differs_from_collection",
                F.col("own_subscription_") != F.col("declared_scope_id"),
            ),
            (
                "tenant_differs_from_collection",
                F.col("own_tenant_") != F.col("declared_tenant_id"),
            ),
        ],
    )
