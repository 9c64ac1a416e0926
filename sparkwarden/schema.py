"""The event table: one row per audit record, whatever the provider.

``event_ns`` repeats ``event_time`` exact to the nanosecond. The columns after
``quality`` are payload fields that detections and hunts compare: they are
lifted out of the record once, at normalisation, so that later jobs prune the
wide ``raw`` and ``extensions`` documents from their scans.
"""

from __future__ import annotations

OUTCOMES = ("success", "failure", "unknown")

IDENTITY_COLUMNS = ("provider", "source", "scope_type", "scope_id", "tenant_id")

EVENT_COLUMNS: dict[str, str] = {
    "event_uid": "string",
    "source_event_id": "string",
    "event_time": "timestamp",
    "event_ns": "bigint",
    "provider": "string",
    "source": "string",
    "scope_type": "string",
    "scope_id": "string",
    "tenant_id": "string",
    "account_id": "string",
    "region": "string",
    "actor_id": "string",
    "actor_type": "string",
    "actor_arn": "string",
    "credential_id": "string",
    "source_address": "string",
    "source_ip": "string",
    "service": "string",
    "action": "string",
    "outcome": "string",
    "error_code": "string",
    "resources": "variant",
    "authentication": "variant",
    "privilege_context": "variant",
    "extensions": "variant",
    "raw": "variant",
    "quality": "array<string>",
    # Lifted payload fields.
    "issued_key": "string",
    "issued_key_owner": "string",
    "policy_arn": "string",
    "policy_target": "string",
    "trail_name": "string",
    "security_group": "string",
    "ip_permissions": "variant",
    "actor_tenant_id": "string",
    "resource_name": "string",
    "resource_type": "string",
    "category": "string",
    "target_resources": "variant",
    "delta_type": "string",
    "binding_deltas": "variant",
    "risk_level": "string",
}

PARTITION_COLUMNS = ("provider", "source", "event_date")

NON_NULL = (
    "event_uid", "provider", "source", "service", "action", "outcome",
    "resources", "authentication", "privilege_context", "extensions", "raw", "quality",
)

# Documents and the JSON type each must have.
DOCUMENT_SHAPES = {
    "raw": "OBJECT",
    "resources": "ARRAY",
    "authentication": "OBJECT",
    "privilege_context": "OBJECT",
    "extensions": "OBJECT",
}

TEXT_COLUMNS = (
    "event_uid", "source_event_id", "provider", "source", "scope_type", "scope_id",
    "tenant_id", "account_id", "region", "actor_id", "actor_type", "actor_arn",
    "credential_id", "source_address", "source_ip", "service", "action", "outcome",
    "error_code",
)
