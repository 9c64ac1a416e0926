"""Streams against the batch SQL: files of shuffled, repeated deliveries, taken in batches.

A delivery comes up to an hour of squeezed or plain time after its event, some come twice,
and files are written in order of arrival, so neither files nor rows are in order of time.
Spark moves filters below a watermark, which therefore moves with the rows a rule reads;
where results wait for it, the same activity (of much, a part) follows once more, long after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.plans.detections import BASELINE, RESTART_AWARE, RULES
from sparkwarden.plans.proofs import cloud, generic
from sparkwarden.plans.proofs.registry import ORACLES, query
from sparkwarden.plans.rules import Sequence
from sparkwarden.plans.table_logs import stored
from sparkwarden.shared import new_folder
from sparkwarden.streaming.feeds import caught_up, event_feed
from sparkwarden.streaming.rules import stream_first_deliveries, stream_key_first_use, stream_matches
from sparkwarden.streaming.sequences import stream_absent_between, stream_pairs

SLICES = 3
LATEST = 3600  # seconds between an event and its delivery
LATER_DAYS = 400
SECOND_US = 1_000_000
PER_FILE = 25_000  # deliveries
CLOSING = 20_000  # rows, about, that follow to move the watermark
UNREAD = ("raw", "extensions", "resources", "authentication", "privilege_context", "quality")  # by no rule


def feed(spark: SparkSession, events: DataFrame, *, closing: bool = False) -> tuple[DataFrame, str]:
    """``events`` (event_uid, event_time, event_ns) as a stream of deliveries, and the delay
    that covers them. Each slice is a micro-batch, of as many files as its rows need."""
    events = events.drop(*UNREAD)
    lot = F.pmod(F.xxhash64("event_uid"), F.lit(LATEST))
    arrival = F.coalesce(F.unix_micros("event_time"), F.lit(0)) + lot * SECOND_US
    first = events.withColumn("delivery", F.lit(1)).withColumn("arrival", arrival)
    again = first.where(lot % 7 == 0).withColumn("delivery", F.lit(2))
    again = again.withColumn("arrival", F.unix_micros("event_time") + LATEST * SECOND_US)
    rows = first.unionByName(again)
    known = F.when(F.col("event_time").isNotNull(), F.col("arrival"))
    low, high, count = first.agg(F.min(known), F.max(known), F.count("*")).first()
    files = max(2, -(-count // (SLICES * PER_FILE)))
    low, width = low or 0, ((high or 0) - (low or 0)) // SLICES + 1
    path = new_folder(spark, "feed")
    number = F.least(F.greatest(F.call_function("div", F.col("arrival") - low, F.lit(width)), F.lit(0)), F.lit(SLICES - 1))
    for part in range(SLICES):
        some = rows.where(number == part).drop("arrival")
        some.repartition(files, F.xxhash64("event_uid", "delivery")).write.mode("append").parquet(path)
    if closing:
        moved = F.col("event_time") + F.expr(f"INTERVAL '{LATER_DAYS}' DAY")
        ns = F.col("event_ns") + LATER_DAYS * 86_400 * 1_000_000_000
        # These only move the watermark, so that their number need not grow with the events.
        some = F.pmod(F.xxhash64("event_uid"), F.lit(max(1, count // CLOSING))) == 0
        late = events.where("event_time IS NOT NULL").where(some).withColumns(
            {"event_time": moved, "event_ns": ns, "event_uid": F.concat(F.lit("later-"), "event_uid"), "delivery": F.lit(1)}
        )
        late.repartition(2).write.mode("append").parquet(path)
    schema = spark.read.schema(rows.drop("arrival").schema).parquet(path).schema
    delay = (width // SECOND_US) + LATEST + 1
    return event_feed(spark, path, schema, files), f"{delay} seconds"


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity table with the columns streams go by."""
    events = generic.log(spark, sf_dir)
    uid = F.col("event_id").cast("string").alias("event_uid")
    stamp = F.col("ts").cast("timestamp").alias("event_time")
    return events.select("user_id", "event_id", "event_type", "event_ns", uid, stamp)


def _before(stamp: str) -> str:
    """Leaves out what the repeated activity adds."""
    return f"{stamp} < TIMESTAMP'2025-01-01 00:00:00'"


def _kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select("user_id", "event_id", "event_ns", "event_time")


@query("SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events")
def stream_dedupe(spark, sf_dir):
    """Every event once, from deliveries that repeat some."""
    events, delay = feed(spark, _plain(spark, sf_dir))
    once = caught_up(stream_first_deliveries(events, delay), "stream-dedupe")
    return once.select("event_id", "user_id", "event_type", F.unix_micros("event_time").alias("us"))


@query(ORACLES["seq_pair"])
def stream_pairs_within(spark, sf_dir):
    """Ordered pairs within half an hour, of deliveries without their repeats."""
    events, delay = feed(spark, _plain(spark, sf_dir))
    once = events.where("delivery = 1").withWatermark("event_time", delay)
    pairs = stream_pairs(_kind(once, "error"), _kind(once, "purchase"), ["user_id"], generic.HALF_HOUR)
    return generic._pair_columns(caught_up(pairs, "stream-pairs"))


@query(ORACLES["seq_pair_no_blocker"])
def stream_pairs_no_blocker(spark, sf_dir):
    """Ordered pairs within a day with no blocker strictly between."""
    events, delay = feed(spark, _plain(spark, sf_dir), closing=True)
    once = events.where("delivery = 1").withWatermark("event_time", delay)
    pairs = stream_pairs(_kind(once, "error"), _kind(once, "purchase"), ["user_id"], generic.DAY)
    open_pairs = stream_absent_between(
        pairs, _kind(once, "click"), {"user_id": "user_id"}, generic.DAY,
        start="first_event_ns", end="second_event_ns", stamp="first_event_time",
    )
    found = caught_up(open_pairs, "stream-no-blocker")
    return generic._pair_columns(found.where(_before("first_event_time")))


def _stream_rule(spark, sf_dir, rule_id: str, drop: tuple, revision: str = BASELINE):
    rule = RULES.rules(revision)[rule_id]
    waits = rule.body.blocker is not None if isinstance(rule.body, Sequence) else False
    events, delay = feed(spark, stored(spark, sf_dir, rule.source), closing=waits)
    matches = caught_up(stream_matches(rule, events.where("delivery = 1"), delay), "stream-rule")
    return (matches.where(_before("started_at")) if waits else matches).drop(*drop)


@query(ORACLES["aws_new_key_admin_attach"])
def stream_aws_new_key_admin_attach(spark, sf_dir):
    return _stream_rule(spark, sf_dir, "aws_new_key_admin_attach", cloud._PAIR_HIDDEN)


@query(ORACLES["aws_log_stop_public_ingress_restart_aware"])
def stream_aws_log_stop_restart_aware(spark, sf_dir):
    return _stream_rule(spark, sf_dir, "aws_log_stop_public_ingress", cloud._PAIR_HIDDEN, RESTART_AWARE)


@query(ORACLES["azure_diag_delete_role_assign"])
def stream_azure_diag_delete_role_assign(spark, sf_dir):
    return _stream_rule(spark, sf_dir, "azure_diag_delete_role_assign", (*cloud._PAIR_HIDDEN, "scope_type"))


@query(ORACLES["entra_sp_cred_app_role"])
def stream_entra_sp_cred_app_role(spark, sf_dir):
    hidden = ("credential_uid", "assignment_uid", "scope_type", "tenant_id", "credential_added_at", "role_assigned_at")
    return _stream_rule(spark, sf_dir, "entra_sp_cred_app_role", hidden)


@query(ORACLES["gcp_new_key_set_policy"])
def stream_gcp_new_key_set_policy(spark, sf_dir):
    hidden = ("creation_uid", "policy_uid", "created_at", "policy_at")
    return _stream_rule(spark, sf_dir, "gcp_new_key_set_policy", hidden)


@query(ORACLES["gcp_bucket_public_grant"])
def stream_gcp_bucket_public_grant(spark, sf_dir):
    hidden = ("policy_uid", "scope_type", "event_time")
    return _stream_rule(spark, sf_dir, "gcp_bucket_public_grant", hidden)


@query(ORACLES["hunt_aws_key_first_use"])
def stream_hunt_aws_key_first_use(spark, sf_dir):
    """First ninety minutes of every new access key."""
    events, delay = feed(spark, stored(spark, sf_dir, "aws.cloudtrail"), closing=True)
    found = caught_up(stream_key_first_use(events.where("delivery = 1"), delay, 1.5), "stream-first-use")
    found = found.where("coalesce(created_us, 0) < unix_micros(TIMESTAMP'2025-01-01 00:00:00')")
    return found.withColumnsRenamed({"first_use_us": "first_us", "last_use_us": "last_us"}).drop("creation_uid")
