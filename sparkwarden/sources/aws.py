"""AWS CloudTrail records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG, raw_uid
from sparkwarden.functions.instants import ISO_ZONED, extended, instant
from sparkwarden.functions.json_access import (
    Members,
    boolean_at,
    get_at,
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
)

# Request members that name a resource.
REFERENCE_FIELDS = ("groupId", "userName", "roleName", "name", "policyArn")
MEMBERS = (
    "eventVersion", "eventTime", "eventSource", "eventName", "awsRegion", "eventID", "eventType",
    "sourceIPAddress", "errorCode", "errorMessage", "recipientAccountId", "userIdentity",
    "requestParameters", "responseElements", "resources",
)
INNER = {
    "userIdentity": ("type", "principalId", "accountId", "arn", "accessKeyId", "sessionContext"),
    "requestParameters": (*REFERENCE_FIELDS, "ipPermissions"),
}


def normalize_cloudtrail(records: DataFrame, tag: str = IDENTITY_TAG) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    r = Members("record", MEMBERS, INNER)
    stamp = instant(F.col(STAMP_TEXT), ISO_ZONED, keep_nanos=False)
    address = text_at(r, "$.sourceIPAddress")
    staged = prepared(
        records,
        {
            "event_time_": stamp.time,
            "nanos_": stamp.nanos,
            "time_refused_": stamp.refused,
            "address_": address,
            "account_": F.coalesce(
                text_at(r, "$.recipientAccountId"), text_at(r, "$.userIdentity.accountId")
            ),
            "error_": F.coalesce(
                text_at(r, "$.errorCode"), text_at(r, "$.responseElements.errorCode")
            ),
            "message_": F.coalesce(
                text_at(r, "$.errorMessage"), text_at(r, "$.responseElements.errorMessage")
            ),
            "event_id_": text_at(r, "$.eventID"),
            "service_": text_at(r, "$.eventSource"),
            "action_": text_at(r, "$.eventName"),
            "mfa_": text_at(r, "$.userIdentity.sessionContext.attributes.mfaAuthenticated"),
            "session_": object_at(r, "$.userIdentity.sessionContext"),
        },
        r,
        extended(text_at(r, "$.eventTime")),
    ).withColumn("ip_", source_ip(F.col("address_")))
    failed = (
        F.col("error_").isNotNull()
        | F.col("message_").isNotNull()
        | F.coalesce(~boolean_at(r, "$.responseElements._return"), F.lit(False))
    )
    own = F.coalesce(
        get_at(r, "$.resources", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    references = F.array_compact(
        F.array(
            *[
                typed_reference(
                    name, text_at(r, f"$.requestParameters.{name}"), f"/requestParameters/{name}"
                )
                for name in REFERENCE_FIELDS
            ]
        )
    )
    return finish(
        staged,
        keep,
        {
            "event_uid": raw_uid(r.whole()),
            "source_event_id": F.col("event_id_"),
            "provider": F.lit("aws"),
            "source": F.lit("aws.cloudtrail"),
            "scope_type": F.lit("aws.account"),
            "scope_id": F.col("account_"),
            "account_id": F.col("account_"),
            "region": text_at(r, "$.awsRegion"),
            "actor_id": text_at(r, "$.userIdentity.principalId"),
            "actor_type": text_at(r, "$.userIdentity.type"),
            "actor_arn": text_at(r, "$.userIdentity.arn"),
            "credential_id": text_at(r, "$.userIdentity.accessKeyId"),
            "source_address": F.col("address_"),
            "source_ip": F.col("ip_"),
            "service": F.col("service_"),
            "action": F.col("action_"),
            "outcome": F.when(failed, "failure")
            .when(text_at(r, "$.eventType") == "AwsApiCall", "success")
            .otherwise("unknown"),
            "error_code": F.col("error_"),
            "resources": F.to_variant_object(F.concat(own, references)),
            "authentication": variant_object(
                mfa_authenticated=F.when(F.col("mfa_") == "true", F.lit(True)).when(
                    F.col("mfa_") == "false", F.lit(False)
                ),
                session_context=F.col("session_"),
            ),
            "privilege_context": variant_object(
                session_issuer=object_at(r, "$.userIdentity.sessionContext.sessionIssuer")
            ),
            "extensions": variant_object(
                eventVersion=value_at(r, "$.eventVersion"),
                userIdentity=object_at(r, "$.userIdentity"),
                requestParameters=value_at(r, "$.requestParameters"),
                responseElements=value_at(r, "$.responseElements"),
            ),
            "quality": reasons(
                ("missing_event_time", F.col("nanos_").isNull()),
                ("missing_source_event_id", F.col("event_id_").isNull()),
                ("missing_account", F.col("account_").isNull()),
                ("source_address_is_not_ip", not_an_ip(F.col("address_"), F.col("ip_"))),
            ),
            "issued_key": loose_text(r, "$.responseElements.accessKey.accessKeyId"),
            "issued_key_owner": loose_text(r, "$.responseElements.accessKey.userName"),
            "policy_arn": loose_text(r, "$.requestParameters.policyArn"),
            "policy_target": F.coalesce(
                loose_text(r, "$.requestParameters.userName"),
                loose_text(r, "$.requestParameters.roleName"),
            ),
            "trail_name": loose_text(r, "$.requestParameters.name"),
            "security_group": loose_text(r, "$.requestParameters.groupId"),
            "ip_permissions": value_at(r, "$.requestParameters.ipPermissions.items"),
        },
        [
            ("invalid_event_time", F.col("time_refused_")),
            ("missing_service", F.col("service_").isNull()),
            ("missing_action", F.col("action_").isNull()),
        ],
    )
