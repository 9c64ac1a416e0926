"""Rules and hunts on a stream of events.

Every rule declared as a sequence or a single event runs here as it is declared; rules that
are free SQL or functions may hold operators that streams refuse, and are for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.instants import NANOS_PER_SECOND
from sparkwarden.plans.hunts import SENSITIVE_ACTIONS, horizon_ns
from sparkwarden.plans.rules import Rule, Sequence, Single
from sparkwarden.streaming.sequences import (
    STAMP,
    first_deliveries_within,
    stream_absent_between,
    stream_pairs,
)


def stream_matches(rule: Rule, events: DataFrame, delay: str) -> DataFrame:
    """The matches of ``rule`` in a stream of events, none later than ``delay``.

    Sequences emit a pair when its later half comes; with a blocker, when nothing can come
    between any more. A rule with ``distinct`` forgets matches after the delay."""
    body, rows = rule.body, rule.scoped(events.withWatermark(STAMP, delay))
    if isinstance(body, Single):
        return body.matches(rows)
    if not isinstance(body, Sequence):
        raise ValueError(f"rule {rule.rule_id} is neither a sequence nor a single event")
    window = body.within_seconds * NANOS_PER_SECOND
    pairs = stream_pairs(body.first.rows(rows), body.second.rows(rows), body.keys, window)
    if body.blocker is not None:
        carried = [STAMP, *(c for c in body.blocker.carry if c != STAMP)]
        blockers = rows.where(body.blocker.where).selectExpr(*carried)
        pairs = stream_absent_between(
            pairs,
            blockers,
            dict(body.blocker_keys),
            window,
            start="first_event_ns",
            end="second_event_ns",
            stamp="first_event_time",
        )
    out = pairs.selectExpr(*body.output)
    return out.dropDuplicates() if body.distinct else out


_USE = ("event_uid", "event_ns", STAMP, "service", "action", "source_ip", "outcome")
_COUNTS = ("event_count", "distinct_services", "distinct_actions", "distinct_source_ips", "failures", "sensitive_actions")


def stream_key_first_use(events: DataFrame, delay: str, hours: float = 24) -> DataFrame:
    """Every new access key with what it did in its first hours, as the hunt of the same name;
    a lead is emitted when its hours are over for the watermark, and at once where the key,
    its account or its time is unknown.

    Leads meet uses in an interval join and are counted there, all in Spark's own operators.
    Every lead comes as a use of itself too, which counts for nothing but the lead: so one
    without uses is found, and of one that came n times, n times n such pairs."""
    rows, horizon = events.withWatermark(STAMP, delay), horizon_ns(hours)
    created = rows.where(
        "service = 'iam.amazonaws.com' AND action = 'CreateAccessKey' AND outcome = 'success'"
    ).select(
        F.col("event_uid").alias("creation_uid"),
        F.col("source_event_id").alias("creation_event_id"),
        "account_id",
        F.unix_micros(STAMP).alias("created_us"),
        F.col("actor_arn").alias("creator"),
        F.col("issued_key").alias("issued_key_id"),
        "event_ns",
        STAMP,
    )
    names = ["creation_uid", "creation_event_id", "account_id", "created_us", "creator", "issued_key_id"]
    unknown = F.col("issued_key_id").isNull() | F.col(STAMP).isNull() | F.col("account_id").isNull()
    known = created.where(~unknown)
    used = rows.where("credential_id IS NOT NULL").select(
        "account_id", F.col("credential_id").alias("issued_key_id"), F.lit(False).alias("itself"), *_USE
    )
    itself = known.select(
        "account_id", "issued_key_id", F.lit(True).alias("itself"), F.col("creation_uid").alias("event_uid"),
        "event_ns", STAMP, *[F.lit(None).cast("string").alias(c) for c in _USE[3:]],
    )
    pairs = stream_pairs(
        known, used.unionByName(itself), ["account_id", "issued_key_id"], horizon,
        include_start=True, prefixes=("lead_", "use_"),
    )
    # A lead is no use of its own key, and no other lead counts as one.
    met = pairs.where((F.col("lead_creation_uid") == F.col("use_event_uid")) == F.col("use_itself"))
    use, us = ~F.col("use_itself"), F.unix_micros(F.col(f"use_{STAMP}"))
    carried = [n if n in ("account_id", "issued_key_id") else f"lead_{n}" for n in names]
    counted = met.groupBy(f"lead_{STAMP}", *carried).agg(
        F.min(F.when(use, us)).alias("first_use_us"),
        F.max(F.when(use, us)).alias("last_use_us"),
        F.sqrt(F.count_if("use_itself")).cast("long").alias("copies"),
        F.count_if(use).alias("event_count"),
        *[F.size(F.collect_set(f"use_{c}")).cast("long").alias(f"distinct_{c}s") for c in ("service", "action", "source_ip")],
        F.count_if(F.col("use_outcome") == "failure").alias("failures"),
        F.count_if(F.col("use_action").isin(*SENSITIVE_ACTIONS)).alias("sensitive_actions"),
    )
    copy = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    once = {c: F.call_function("div", F.col(c), F.col("copies")) for c in ("event_count", "failures", "sensitive_actions")}
    seen = F.when(F.col("event_count") > 0, "use_observed").otherwise("no_use_observed")
    leads = counted.withColumns(once).withColumn("copy", copy).select(
        *[F.col(c).alias(n) for c, n in zip(carried, names)],
        seen.alias("observation"), "first_use_us", "last_use_us", *_COUNTS,
    )
    zeros = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    none = [F.lit(None).cast("long").alias(c) for c in ("first_use_us", "last_use_us")]
    open_leads = created.where(unknown).select(*names, F.lit("unresolvable").alias("observation"), *none, *zeros)
    return leads.unionByName(open_leads)


def stream_first_deliveries(events: DataFrame, delay: str) -> DataFrame:
    """Events of a stream, each once however often it is delivered."""
    return first_deliveries_within(events, ["event_uid"], delay)
