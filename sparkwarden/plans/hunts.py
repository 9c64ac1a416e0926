"""Hunts: leads with counts, never verdicts.

Each hunt gives two tables: ``leads`` (one row each, scalars only) and
``lead_events`` (one row per lead and event). A lead on a very busy key then
never becomes one row with an unbounded list; ``inline_events`` attaches lists
to the leads that are small enough.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.instants import NANOS_PER_HOUR
from sparkwarden.operators.sequence import anchored_window, follow_ups, per_anchor
from sparkwarden.plans.detections import KEY_PREFIX

# Fixed values.
SENSITIVE_ACTIONS = (
    "AttachUserPolicy", "AttachRolePolicy", "StopLogging", "AuthorizeSecurityGroupIngress",
)
RATED_RISKS = ("none", "low", "medium", "high")
ELEVATED_RISKS = ("medium", "high")
KEY_PATH = r"^projects/[^/]+/serviceAccounts/[^/]+/keys/[^/]+\z"
MIN_HOURS_EXCLUSIVE, MAX_HOURS_INCLUSIVE = 0, 744


@dataclass(frozen=True)
class Leads:
    leads: DataFrame
    lead_events: DataFrame
    order: tuple[Column, ...]

    def ordered(self) -> DataFrame:
        """Leads in reading order (a global sort; for reports)."""
        return self.leads.orderBy(*self.order)


def horizon_ns(hours: float) -> int:
    if not MIN_HOURS_EXCLUSIVE < hours <= MAX_HOURS_INCLUSIVE:
        raise ValueError(
            f"hours must be above {MIN_HOURS_EXCLUSIVE} and at most {MAX_HOURS_INCLUSIVE}"
        )
    return round(hours * NANOS_PER_HOUR)


def _observation(unresolvable: Column) -> Column:
    return (
        F.when(unresolvable, "unresolvable")
        .when(F.coalesce("event_count", F.lit(0)) == 0, "no_use_observed")
        .otherwise("use_observed")
    )


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(name, F.lit(0)).alias(name) for name in names]


USE_COLUMNS = ("event_uid", "source_event_id", "event_time", "event_ns", "service", "action",
               "source_ip", "outcome")


def aws_key_first_use(events: DataFrame, hours: float = 24) -> Leads:
    """Every new access key with what it did in its first hours, unused ones too."""
    created = events.where(
        "service = 'iam.amazonaws.com' AND action = 'CreateAccessKey' AND outcome = 'success'"
    ).select(
        "event_uid", "source_event_id", "account_id", "event_time", "event_ns", "actor_arn",
        F.col("issued_key").alias("key_id"),
    )
    used = events.where("credential_id IS NOT NULL").select(
        "account_id", F.col("credential_id").alias("key_id"), *USE_COLUMNS
    )
    uses = follow_ups(
        created.select("account_id", "key_id", "event_uid", "event_ns"),
        used,
        ["account_id", "key_id"],
        horizon_ns(hours),
    )
    counted = per_anchor(
        created,
        uses,
        {
            "first_use": F.min("use_event_time"),
            "last_use": F.max("use_event_time"),
            "event_count": F.count("*"),
            "distinct_services": F.count_distinct("use_service"),
            "distinct_actions": F.count_distinct("use_action"),
            "distinct_source_ips": F.count_distinct("use_source_ip"),
            "failures": F.count_if(F.col("use_outcome") == "failure"),
            "sensitive_actions": F.count_if(F.col("use_action").isin(*SENSITIVE_ACTIONS)),
        },
    )
    leads = counted.select(
        F.col("event_uid").alias("creation_uid"),
        F.col("source_event_id").alias("creation_event_id"),
        "account_id",
        F.col("event_time").alias("created_at"),
        F.col("actor_arn").alias("creator"),
        F.col("key_id").alias("issued_key_id"),
        _observation(
            F.col("key_id").isNull() | F.col("event_time").isNull() | F.col("account_id").isNull()
        ).alias("observation"),
        "first_use",
        "last_use",
        *_zero("event_count", "distinct_services", "distinct_actions", "distinct_source_ips",
               "failures", "sensitive_actions"),
    )
    return Leads(
        leads,
        uses.select(
            F.col("anchor_event_uid").alias("creation_uid"),
            F.col("use_event_uid").alias("event_uid"),
            F.col("use_source_event_id").alias("source_event_id"),
            F.col("use_event_ns").alias("event_ns"),
        ),
        (F.desc("sensitive_actions"), F.desc("failures"), F.asc("creation_uid")),
    )


def entra_signin_inventory(events: DataFrame, hours: float = 24) -> Leads:
    """Sign-ins per user within hours of the user's first one; an unknown identity
    stays one row per event."""
    keys = ["scope_type", "scope_id", "tenant_id", "actor_id"]
    narrow = events.select(
        *keys, "event_uid", "source_event_id", "event_time", "event_ns", "outcome", "source_ip",
        "risk_level",
    )
    selected = anchored_window(narrow, keys, ("scope_id", "actor_id"), horizon_ns(hours))
    group = [*keys, F.col("unresolved_uid").alias("unresolved_event_uid")]
    risk = F.col("risk_level")
    leads = selected.groupBy(*group).agg(
        F.min("event_time").alias("first_observed"),
        F.max("event_time").alias("last_observed"),
        F.count("*").alias("signins"),
        F.count_if(F.col("outcome") == "failure").alias("failures"),
        F.count_if(F.col("outcome") == "success").alias("successes"),
        F.count_if(F.col("outcome") == "unknown").alias("unknown_outcomes"),
        F.count_distinct("source_ip").alias("distinct_source_ips"),
        F.count_if(risk.isin(*ELEVATED_RISKS)).alias("elevated_risk_observations"),
        F.count_if(risk.isNull() | ~risk.isin(*RATED_RISKS)).alias(
            "unavailable_risk_observations"
        ),
        F.count("*").alias("mfa_outcome_unknown"),
    )
    return Leads(
        leads,
        selected.select(*group, "event_uid", "source_event_id", "event_ns"),
        (
            F.desc("failures"),
            F.desc("elevated_risk_observations"),
            F.asc_nulls_last("scope_id"),
            F.asc_nulls_last("actor_id"),
            F.asc_nulls_last("unresolved_event_uid"),
        ),
    )


def gcp_key_use(events: DataFrame, hours: float = 24) -> Leads:
    """Every new service-account key with its use in its first hours."""
    created = events.where(
        "service = 'iam.googleapis.com'"
        " AND action = 'google.iam.admin.v1.CreateServiceAccountKey'"
        " AND outcome IN ('success', 'unknown')"
    ).select(
        "event_uid", "source_event_id", "scope_type", "scope_id", "event_time", "event_ns",
        F.col("issued_key").alias("issued_name"), "outcome",
    ).withColumn(
        "key_name",
        F.when(F.col("issued_name").rlike(KEY_PATH), F.concat(F.lit(KEY_PREFIX), "issued_name")),
    )
    used = events.where("credential_id IS NOT NULL").select(
        "scope_type", "scope_id", F.col("credential_id").alias("key_name"), *USE_COLUMNS
    )
    keys = ["scope_type", "scope_id", "key_name"]
    uses = follow_ups(
        created.select(*keys, "event_uid", "event_ns"), used, keys, horizon_ns(hours)
    )
    counted = per_anchor(
        created,
        uses,
        {
            "first_use": F.min("use_event_time"),
            "last_use": F.max("use_event_time"),
            "event_count": F.count("*"),
            "distinct_services": F.count_distinct("use_service"),
            "distinct_actions": F.count_distinct("use_action"),
            "failures": F.count_if(F.col("use_outcome") == "failure"),
        },
    )
    leads = counted.select(
        F.col("event_uid").alias("creation_uid"),
        F.col("source_event_id").alias("creation_event_id"),
        "scope_type",
        "scope_id",
        F.col("event_time").alias("created_at"),
        F.col("issued_name").alias("key_name"),
        F.col("outcome").alias("creation_outcome"),
        # An unusual or missing key name leaves the derived key NULL.
        _observation(
            F.col("key_name").isNull() | F.col("event_time").isNull() | F.col("scope_id").isNull()
        ).alias("observation"),
        "first_use",
        "last_use",
        *_zero("event_count", "distinct_services", "distinct_actions", "failures"),
    )
    return Leads(
        leads,
        uses.select(
            F.col("anchor_event_uid").alias("creation_uid"),
            F.col("use_event_uid").alias("event_uid"),
            F.col("use_source_event_id").alias("source_event_id"),
            F.col("use_event_ns").alias("event_ns"),
        ),
        (F.asc("creation_uid"),),
    )


@dataclass(frozen=True)
class Hunt:
    hunt_id: str
    provider: str
    source: str
    run: Callable[[DataFrame, float], Leads]
    lead_key: tuple[str, ...] = ("creation_uid",)
    list_order: tuple[str, ...] = ("event_uid",)
    default: bool = False


HUNTS = {
    h.hunt_id: h
    for h in (
        Hunt("aws_key_first_use", "aws", "aws.cloudtrail", aws_key_first_use, default=True),
        Hunt(
            "entra_signin_inventory",
            "azure",
            "azure.entra.signin",
            entra_signin_inventory,
            ("scope_type", "scope_id", "tenant_id", "actor_id", "unresolved_event_uid"),
            ("event_ns", "event_uid"),
        ),
        Hunt("gcp_key_use", "gcp", "gcp.audit", gcp_key_use),
    )
}


def hunt(events: DataFrame, hours: float = 24, hunt_id: str | None = None) -> Leads:
    """Run a hunt by name (or the default one) over the events of its source."""
    chosen = (
        next(h for h in HUNTS.values() if h.default) if hunt_id is None else HUNTS.get(hunt_id)
    )
    if chosen is None:
        raise ValueError(f"unknown hunt {hunt_id}")
    horizon_ns(hours)
    own = (F.col("provider") == chosen.provider) & (F.col("source") == chosen.source)
    return chosen.run(events.where(own), hours)


def inline_events(found: Leads, hunt_id: str) -> DataFrame:
    """Leads with all their event uids as one ordered list (NULL times last), and the
    distinct source ids in order, NULL (at most one) last. The row grows with the
    lead; ``lead_events`` holds the same as rows of bounded size."""
    spec = HUNTS[hunt_id]
    events, leads = found.lead_events, found.leads.alias("a")
    entry = F.struct(
        *[
            part.alias(f"o{i}_{j}")
            for i, c in enumerate(spec.list_order)
            for j, part in enumerate((F.col(c).isNull(), F.col(c)))
        ],
        F.col("event_uid").alias("uid"),
    )
    lists = [F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["uid"]).alias("event_uids")]
    if "source_event_id" in events.columns:
        # A struct, as collect_set leaves out a bare NULL.
        named = F.struct(F.col("source_event_id").isNull().alias("none"), F.col("source_event_id").alias("id"))
        ids = F.transform(F.array_sort(F.collect_set(named)), lambda x: x["id"])
        lists.append(ids.alias("source_event_ids"))
    gathered = events.groupBy(*spec.lead_key).agg(*lists).alias("l")
    match = F.lit(True)
    for k in spec.lead_key:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}"))
    total = "signins" if hunt_id == "entra_signin_inventory" else "event_count"
    empty = F.when(F.col(f"a.{total}") == 0, F.array().cast("array<string>"))
    names = [c for c in gathered.columns if c not in spec.lead_key]
    return leads.join(gathered, match, "left").select(
        "a.*", *(F.coalesce(f"l.{name}", empty).alias(name) for name in names)
    )
