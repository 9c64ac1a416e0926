"""The detections, as rule declarations over the event table."""

from __future__ import annotations

from sparkwarden.operators.arrays import Elements
from sparkwarden.plans.rules import Evidence, RuleBook, Sequence, Single, Step

BASELINE, RESTART_AWARE = "baseline", "restart_aware"

ELAPSED = "(second_event_ns - first_event_ns) / 1e9D AS elapsed_seconds"
PAIR = (
    "first_event_uid AS start_uid",
    "second_event_uid AS end_uid",
    "first_source_event_id AS start_event_id",
    "second_source_event_id AS end_event_id",
    "first_event_time AS started_at",
    "second_event_time AS ended_at",
    ELAPSED,
)
PAIR_EVIDENCE = Evidence(("start_uid", "end_uid"), ("start_event_id", "end_event_id"))
COMMON = ("event_uid", "source_event_id", "event_time", "event_ns")

# Vendor action names, roles, resource formats.
ADMIN_POLICY = "arn:aws:iam::aws:policy/AdministratorAccess"
KEY_PATH = "^projects/[^/]+/serviceAccounts/[^/]+/keys/[^/]+\\\\z"
KEY_PREFIX = "//iam.googleapis.com/"
ADMIN_PORTS = (22, 3389)

aws_new_key_admin_attach = Sequence(
    first=Step(
        where="service = 'iam.amazonaws.com' AND action = 'CreateAccessKey'"
        " AND outcome = 'success'",
        carry=(
            *COMMON, "account_id", "issued_key AS key_id", "issued_key_owner", "actor_arn",
        ),
    ),
    second=Step(
        where="service = 'iam.amazonaws.com'"
        " AND action IN ('AttachUserPolicy', 'AttachRolePolicy') AND outcome = 'success'"
        f" AND policy_arn = '{ADMIN_POLICY}'",
        carry=(
            *COMMON, "account_id", "credential_id AS key_id", "actor_arn", "action",
            "policy_target", "policy_arn",
        ),
    ),
    keys=("account_id", "key_id"),
    output=(
        *PAIR,
        "account_id",
        "key_id AS created_key_id",
        "first_actor_arn AS key_creator",
        "first_issued_key_owner AS key_owner",
        "second_actor_arn AS policy_actor",
        "second_action AS policy_action",
        "second_policy_target AS policy_target",
        "second_policy_arn AS policy_arn",
    ),
)

_port = "cast(round(try_cast(try_variant_get(permission, '$.{}', 'string') AS double)) AS int)"
_protocol = "try_variant_get(permission, '$.ipProtocol', 'string')"
_reaches = " OR ".join(
    f"{port} BETWEEN {_port.format('fromPort')} AND {_port.format('toPort')}"
    for port in ADMIN_PORTS
)


def _public(ranges: str, member: str, anywhere: str) -> str:
    return (
        f"filter(transform(coalesce(try_variant_get(permission, '$.{ranges}.items',"
        f" 'array<variant>'), array()), r -> try_variant_get(r, '$.{member}', 'string')),"
        f" c -> c = '{anywhere}')"
    )


# Protocol, ports and public range must hold within one permission entry.
_open_ingress = Step(
    where="service = 'ec2.amazonaws.com' AND action = 'AuthorizeSecurityGroupIngress'"
    " AND outcome = 'success'",
    elements=(
        Elements(
            "ip_permissions",
            "permission",
            "permission_index",
            where=f"{_protocol} = '-1' OR ({_protocol} IN ('tcp', '6') AND ({_reaches}))",
        ),
        Elements(
            f"concat({_public('ipRanges', 'cidrIp', '0.0.0.0/0')},"
            f" {_public('ipv6Ranges', 'cidrIpv6', '::/0')})",
            "cidr",
            native=True,
        ),
    ),
    carry=(
        *COMMON,
        "account_id",
        "actor_id",
        "credential_id",
        "security_group",
        "permission_index",
        "cidr",
        f"{_protocol} AS protocol",
        f"{_port.format('fromPort')} AS from_port",
        f"{_port.format('toPort')} AS to_port",
    ),
)

_trail_step = (
    "service = 'cloudtrail.amazonaws.com' AND action = '{}' AND outcome = 'success'".format
)

aws_log_stop_public_ingress = Sequence(
    first=Step(
        where=_trail_step("StopLogging"),
        carry=(*COMMON, "account_id", "actor_id", "credential_id", "trail_name"),
    ),
    second=_open_ingress,
    keys=("account_id", "actor_id", "credential_id"),
    output=(
        *PAIR,
        "account_id",
        "actor_id",
        "credential_id",
        "first_trail_name AS trail",
        "second_security_group AS security_group",
        "second_permission_index AS permission_index",
        "second_cidr AS cidr",
        "second_protocol AS protocol",
        "second_from_port AS from_port",
        "second_to_port AS to_port",
    ),
)

aws_log_stop_public_ingress_restart_aware = Sequence(
    first=aws_log_stop_public_ingress.first,
    second=_open_ingress,
    keys=aws_log_stop_public_ingress.keys,
    output=aws_log_stop_public_ingress.output,
    blocker=Step(
        where=_trail_step("StartLogging"), carry=("event_ns", "account_id", "trail_name")
    ),
    blocker_keys=(("account_id", "account_id"), ("first_trail_name", "trail_name")),
)

_azure_keys = ("scope_type", "scope_id", "tenant_id", "actor_id", "actor_tenant_id")


def _azure_step(action: str) -> Step:
    return Step(
        where=f"scope_type = 'azure.subscription' AND lower(action) = '{action}'"
        " AND outcome = 'success'",
        carry=(*COMMON, *_azure_keys, "resource_name", "action"),
    )


azure_diag_delete_role_assign = Sequence(
    first=_azure_step("microsoft.insights/diagnosticsettings/delete"),
    second=_azure_step("microsoft.authorization/roleassignments/write"),
    keys=_azure_keys,
    output=(
        *PAIR,
        *_azure_keys,
        "first_resource_name AS diagnostic_setting",
        "second_resource_name AS role_assignment",
        "first_action AS logging_action",
        "second_action AS access_action",
    ),
)


def _directory_step(action: str) -> Step:
    return Step(
        where="scope_type = 'azure.tenant' AND scope_id IS NOT NULL AND actor_type = 'User'"
        " AND actor_id IS NOT NULL AND outcome = 'success'"
        f" AND category = 'ApplicationManagement' AND action = '{action}'",
        elements=(
            Elements(
                "target_resources",
                "target",
                where="try_variant_get(target, '$.type', 'string') = 'ServicePrincipal'"
                " AND schema_of_variant(try_variant_get(target, '$.id', 'variant')) = 'STRING'"
                " AND try_variant_get(target, '$.id', 'string') <> ''",
            ),
        ),
        carry=(
            *COMMON, "scope_type", "scope_id", "tenant_id", "actor_id",
            "try_variant_get(target, '$.id', 'string') AS target_id",
        ),
    )


entra_sp_cred_app_role = Sequence(
    first=_directory_step("Add service principal credentials"),
    second=_directory_step("Add app role assignment to service principal"),
    keys=("scope_id", "tenant_id", "actor_id", "target_id"),
    output=(
        "first_event_uid AS credential_uid",
        "second_event_uid AS assignment_uid",
        "first_source_event_id AS credential_event_id",
        "second_source_event_id AS assignment_event_id",
        "first_scope_type AS scope_type",
        "scope_id",
        "tenant_id",
        "actor_id AS initiating_user_id",
        "target_id AS mentioned_service_principal_id",
        "first_event_time AS credential_added_at",
        "second_event_time AS role_assigned_at",
        ELAPSED,
    ),
    distinct=True,
)

gcp_new_key_set_policy = Sequence(
    first=Step(
        where="scope_type = 'gcp.project' AND service = 'iam.googleapis.com'"
        " AND action = 'google.iam.admin.v1.CreateServiceAccountKey' AND outcome = 'success'"
        f" AND issued_key RLIKE '{KEY_PATH}'",
        carry=(
            *COMMON, "scope_type", "scope_id", f"'{KEY_PREFIX}' || issued_key AS key_name",
            "issued_key", "actor_id",
        ),
    ),
    second=Step(
        where="service = 'cloudresourcemanager.googleapis.com' AND action = 'SetIamPolicy'"
        " AND outcome = 'success'",
        carry=(
            *COMMON, "scope_type", "scope_id", "credential_id AS key_name", "resource_name",
            "actor_id",
        ),
    ),
    keys=("scope_type", "scope_id", "key_name"),
    output=(
        "first_event_uid AS creation_uid",
        "second_event_uid AS policy_uid",
        "first_source_event_id AS creation_event_id",
        "second_source_event_id AS policy_event_id",
        "scope_type",
        "scope_id",
        "first_event_time AS created_at",
        "second_event_time AS policy_at",
        ELAPSED,
        "first_issued_key AS created_key_name",
        "key_name AS used_key_name",
        "second_resource_name AS policy_resource",
        "first_actor_id AS creator",
        "second_actor_id AS policy_actor",
    ),
)

# Every condition on a delta must hold for the same delta.
gcp_bucket_public_grant = Single(
    Step(
        where="scope_type = 'gcp.project' AND scope_id IS NOT NULL"
        " AND service = 'storage.googleapis.com' AND action = 'storage.setIamPermissions'"
        " AND outcome = 'success' AND resource_type = 'gcs_bucket' AND resource_name <> ''"
        " AND delta_type = 'type.googleapis.com/google.iam.v1.logging.AuditData'",
        elements=(
            Elements(
                "binding_deltas",
                "delta",
                "delta_index",
                where="try_variant_get(delta, '$.action', 'string') = 'ADD'"
                " AND try_variant_get(delta, '$.member', 'string')"
                " IN ('allUsers', 'allAuthenticatedUsers')"
                " AND try_variant_get(delta, '$.role', 'string') IN"
                " ('roles/storage.objectViewer', 'roles/storage.objectAdmin',"
                " 'roles/storage.admin')",
            ),
        ),
        carry=(
            "event_uid AS policy_uid",
            "source_event_id AS policy_event_id",
            "scope_type",
            "scope_id",
            "event_time",
            "resource_name AS bucket_resource",
            "try_variant_get(delta, '$.member', 'string') AS member",
            "try_variant_get(delta, '$.role', 'string') AS role",
            "delta_index",
            "actor_id",
        ),
    )
)

_AWS = {"provider": "aws", "source": "aws.cloudtrail", "version": "1.0.0", "severity": "high"}
_RULES: dict[str, dict] = {
    "aws_new_key_admin_attach": {
        **_AWS,
        "title": "A fresh access key attached the administrator policy",
        "attack": ("T1098.001", "T1098.003"),
        "observed": "A key was created, then that same key attached the administrator policy.",
        "inferred": "Someone should check who holds the key; the purpose is not known.",
        "cannot_establish": ("intent", "a net gain of privilege", "later use of the policy"),
        "evidence": PAIR_EVIDENCE,
        "body": aws_new_key_admin_attach,
    },
    "aws_log_stop_public_ingress": {
        **_AWS,
        "title": "Logging was stopped, then an administration port opened to everyone",
        "attack": ("T1685.002", "T1686.001"),
        "observed": "One caller stopped a trail, then opened SSH or RDP to any address.",
        "inferred": "Someone should check why both happened; real reachability is not known.",
        "cannot_establish": ("intent", "that all logging ended", "reachability from outside"),
        "evidence": PAIR_EVIDENCE,
        "body": aws_log_stop_public_ingress,
    },
    "azure_diag_delete_role_assign": {
        "provider": "azure",
        "source": "azure.activity",
        "version": "1.0.0",
        "severity": "high",
        "title": "A diagnostic setting was deleted, then a role was assigned",
        "attack": ("T1685.002", "T1098.003"),
        "observed": "One actor deleted a diagnostic setting, then assigned a role.",
        "inferred": "Access may have changed while less of it was being recorded.",
        "cannot_establish": ("intent", "which export ended", "how strong the role is"),
        "evidence": PAIR_EVIDENCE,
        "body": azure_diag_delete_role_assign,
    },
    "entra_sp_cred_app_role": {
        "provider": "azure",
        "source": "azure.entra.audit",
        "version": "1.0.0",
        "severity": "medium",
        "title": "A service principal got a credential, then an app role",
        "attack": ("T1098.001",),
        "observed": "One user made both changes, and both name the same service principal.",
        "inferred": "The application may have gained lasting access.",
        "cannot_establish": ("intent", "which party received the role", "use of the credential"),
        "evidence": Evidence(
            ("credential_uid", "assignment_uid"),
            ("credential_event_id", "assignment_event_id"),
        ),
        "body": entra_sp_cred_app_role,
    },
    "gcp_new_key_set_policy": {
        "provider": "gcp",
        "source": "gcp.audit",
        "version": "1.0.0",
        "severity": "high",
        "title": "A fresh service-account key set a project policy",
        "attack": ("T1098.001",),
        "observed": "A key was created, then that same key set the policy of its project.",
        "inferred": "Someone should check who holds the key and what the policy changed.",
        "cannot_establish": ("intent", "who used the key", "what was granted"),
        "evidence": Evidence(
            ("creation_uid", "policy_uid"), ("creation_event_id", "policy_event_id")
        ),
        "body": gcp_new_key_set_policy,
    },
    "gcp_bucket_public_grant": {
        "provider": "gcp",
        "source": "gcp.audit",
        "version": "1.0.0",
        "severity": "high",
        "title": "A bucket was opened to everyone",
        "attack": ("T1098.003",),
        "observed": "A policy change added a public member to an object role of a bucket.",
        "inferred": "Objects may be readable beyond their audience.",
        "cannot_establish": ("intent", "sensitivity of the objects", "actual access"),
        "evidence": Evidence(("policy_uid",), ("policy_event_id",)),
        "body": gcp_bucket_public_grant,
    },
}
_RESTART_AWARE: dict[str, dict] = {
    "aws_log_stop_public_ingress": {
        "version": "1.1.0",
        "body": aws_log_stop_public_ingress_restart_aware,
        "notes": {"status": "experimental, not the default"},
    }
}

RULES = RuleBook.layered({BASELINE: [_RULES], RESTART_AWARE: [_RULES, _RESTART_AWARE]})
