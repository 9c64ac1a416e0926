"""Streams against the batch operators on small feeds, with restarts and late rows."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators.sequence import absent_between, first_after, sequence_pairs
from sparkwarden.plans.hunts import aws_key_first_use
from sparkwarden.shared import new_folder
from sparkwarden.streaming.feeds import caught_up, event_feed, started
from sparkwarden.streaming.rules import stream_key_first_use
from sparkwarden.streaming.sequences import (
    first_deliveries_within,
    stream_absent_between,
    stream_pairs,
)

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_uid string, kind string, account string, item string, event_time timestamp, event_ns long"
WITHIN = 600 * 10**9


def row(number, kind, account, item, seconds):
    at = None if seconds is None else START + timedelta(seconds=seconds)
    ns = None if seconds is None else int(START.timestamp() + seconds) * 10**9 + number % 3
    return f"e{number}", kind, account, item, at, ns


def rows(count=400, seed=1, shift=0):
    source = random.Random(seed)
    out = [
        row(
            i + shift, source.choice(["a", "b", "c"]), source.choice(["x", "y", None]), source.choice(["1", "2"]),
            None if source.random() < 0.02 else shift + source.randint(0, 3600),
        )
        for i in range(count)
    ]
    return out


def written(spark, path, *parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(path)


def of(frame, kind):
    return frame.where(F.col("kind") == kind).select("account", "event_uid", "item", "event_ns", "event_time")


def uids(frame):
    return sorted((r.first_event_uid, r.second_event_uid) for r in frame.collect())


def both(frame, streaming):
    pairs = (stream_pairs if streaming else sequence_pairs)(of(frame, "a"), of(frame, "b"), ["account"], WITHIN)
    keys = {"account": "account", "first_item": "item"}
    sides = {"start": "first_event_ns", "end": "second_event_ns"}
    if streaming:
        return pairs, stream_absent_between(pairs, of(frame, "c"), keys, WITHIN, **sides, stamp="first_event_time")
    return pairs, absent_between(pairs, of(frame, "c"), keys, WITHIN, **sides)


@pytest.mark.parametrize("blocked", [False, True])
def test_a_stream_that_stops_and_goes_on_equals_the_batch(spark, blocked):
    path, table, checkpoint = (new_folder(spark, p) for p in ("feed", "found", "checkpoint"))
    early, late, after = rows(seed=1), rows(seed=2, shift=2000), rows(seed=3, shift=90_000)
    random.Random(4).shuffle(early)
    written(spark, path, early)
    stream = event_feed(spark, path, spark.createDataFrame([], SCHEMA).schema, files=1)
    found = both(stream.withWatermark("event_time", "2 hours"), True)[blocked]
    for part in (late, after):
        started(found, table, checkpoint).awaitTermination()
        written(spark, path, part)
    started(found, table, checkpoint).awaitTermination()
    whole = both(spark.createDataFrame(early + late, SCHEMA), False)[blocked]
    got = spark.read.parquet(table).where("first_event_time < TIMESTAMP'2024-01-01 20:00:00'")
    assert uids(got) == uids(whole) and whole.count() > 20
    stamps = got.where("unix_micros(second_event_time) <> second_event_ns div 1000")
    assert stamps.count() == 0


def test_repeats_are_dropped_and_state_is_freed(spark):
    path = new_folder(spark, "feed")
    first = [row(i, "a", "x", "1", i * 10) for i in range(100)]
    written(spark, path, first, first[:60] + [row(500, "a", "x", "1", 50_000)], [row(501, "a", "x", "1", 90_000)])
    stream = event_feed(spark, path, spark.createDataFrame([], SCHEMA).schema, files=2)
    once = first_deliveries_within(stream, ["event_uid"], "1 hour")
    table, checkpoint = new_folder(spark, "once"), new_folder(spark, "checkpoint")
    query = started(once, table, checkpoint)
    query.awaitTermination()
    got = sorted(r.event_uid for r in spark.read.parquet(table).collect())
    assert got == sorted(r[0] for r in first) + ["e500", "e501"] or len(got) == len(set(got)) == 102
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    # a row older than the watermark is late and comes to nothing
    written(spark, path, [row(600, "a", "x", "1", 10)])
    started(once, table, checkpoint).awaitTermination()
    assert "e600" not in {r.event_uid for r in spark.read.parquet(table).collect()}


def test_an_empty_feed_gives_no_rows(spark):
    path = new_folder(spark, "feed")
    written(spark, path, [])
    stream = event_feed(spark, path, spark.createDataFrame([], SCHEMA).schema)
    assert caught_up(both(stream.withWatermark("event_time", "1 hour"), True)[1], "none").count() == 0


def test_first_after_meets_one_blocker(spark):
    source = random.Random(9)
    left = [(i, source.choice(["x", "y", None]), source.choice([None, *range(0, 900)])) for i in range(300)]
    right = [(source.choice(["x", "y", None]), source.choice([None, *range(0, 900)])) for _ in range(200)]
    frame = spark.createDataFrame(left, "i int, k string, at long")
    blockers = spark.createDataFrame(right, "key string, event_ns long")
    got = {r.i: r.nearest for r in first_after(frame, blockers, {"k": "key"}, 50, at="at", name="nearest").collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        after = [b for key, b in right if k is not None and key == k and at is not None and b is not None and b > at]
        want = min(after, default=None)
        # beyond the window either answer serves
        assert got[i] == want or (want is None or want > at + 50) and (got[i] is None or got[i] > at + 50)


def test_no_pair_meets_two_blockers(spark):
    pairs = spark.createDataFrame([("x", 10 * i, 10 * i + 5) for i in range(200)], "k string, s long, e long")
    blockers = spark.createDataFrame([("x", 1000 + i) for i in range(3000)], "key string, event_ns long")
    kept = absent_between(pairs, blockers, {"k": "key"}, 10_000, start="s", end="e")
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.s for r in kept.collect()) == [s for s in range(0, 2000, 10) if s + 5 <= 1000]


def test_feed_grows_in_files_not_in_rows_and_columns_nobody_reads(spark, monkeypatch):
    from sparkwarden.plans import table_logs
    from sparkwarden.plans.proofs import streams

    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).exists():
        pytest.skip("test tables not mounted")
    monkeypatch.setattr(table_logs, "PER_TASK", 100)
    assert table_logs.activity(spark, sf_dir).rdd.getNumPartitions() == 10  # of 1000 rows
    monkeypatch.setattr(streams, "PER_FILE", 50)
    monkeypatch.setattr(streams, "CLOSING", 100)
    plain = streams._plain(spark, sf_dir)
    events, _ = streams.feed(spark, plain.withColumn("raw", F.lit("wide")), closing=True)
    assert "raw" not in events.columns
    rows = caught_up(events.where("delivery = 1").select("event_uid", F.col("_metadata.file_path").alias("file")), "feed-rows")
    later = F.col("event_uid").startswith("later-")
    assert rows.where(~later).count() == plain.count()
    assert 0 < rows.where(later).count() < plain.count() // 2
    assert rows.where(~later).select("file").distinct().count() > 6


def test_first_use_is_counted_by_sparks_own_operators(spark):
    source, path = random.Random(11), new_folder(spark, "feed")
    schema = (
        "event_uid string, source_event_id string, account_id string, event_time timestamp, event_ns long, service string,"
        " action string, outcome string, actor_arn string, issued_key string, credential_id string, source_ip string"
    )

    def event(number, seconds, key, issued=None):
        uid, kind, account, _, at, ns = row(number, "CreateAccessKey" if issued else "StopLogging", source.choice([*"xxxy", None]), "", seconds)
        outcome = "success" if issued else source.choice(["failure", "success", None])
        service = "iam.amazonaws.com" if issued else source.choice(["s", None])
        return uid, f"id-{uid}", account, at, ns, service, kind, outcome, "arn", issued, key, source.choice(["a", "b", None])

    keys = ["k1", "k2", "k3", None]
    leads = [event(i, source.choice([None, *range(0, 9000)]), source.choice(keys), source.choice(["k1", "k2", "k9"])) for i in range(60)]
    uses = [event(100 + i, source.randint(0, 9000), source.choice(keys)) for i in range(400)]
    after = [event(900 + i, 200_000 + 50_000 * i, "k1") for i in range(3)]
    for part in (leads[:30] + uses[200:], leads[30:] + uses[:200], after):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
    stream = event_feed(spark, path, spark.createDataFrame([], schema).schema, files=2)
    found = stream_key_first_use(stream, "4 hours", 1.0)
    assert "TransformWithState" not in found._jdf.queryExecution().analyzed().toString()
    got = caught_up(found, "first-use")
    batch = aws_key_first_use(spark.createDataFrame(leads + uses + after, schema), 1.0).leads
    micros = {f"{ours}_us": F.unix_micros(theirs) for ours, theirs in (("created", "created_at"), ("first_use", "first_use"), ("last_use", "last_use"))}
    want = batch.withColumns(micros).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.observation for r in got.collect()} == {"use_observed", "no_use_observed", "unresolvable"}


def test_a_lead_that_came_twice_is_two_leads(spark):
    path = new_folder(spark, "feed")
    schema = (
        "event_uid string, source_event_id string, account_id string, event_time timestamp, event_ns long, service string,"
        " action string, outcome string, actor_arn string, issued_key string, credential_id string, source_ip string"
    )
    at = lambda s: (START + timedelta(seconds=s), int(START.timestamp() + s) * 10**9)
    lead = ("l", "l", "x", *at(0), "iam.amazonaws.com", "CreateAccessKey", "success", "arn", "k", "k", "a")
    alone = ("m", "m", "x", *at(1), "iam.amazonaws.com", "CreateAccessKey", "success", "arn", "n", None, "a")
    use = ("u", "u", "x", *at(5), "s", "StopLogging", "failure", "arn", None, "k", "a")
    after = [(f"z{i}", None, "x", *at(100_000 * i), "s", "t", None, "arn", None, "k", None) for i in (1, 2, 3)]
    for part in ([lead] * 3 + [alone] * 2 + [use], after):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = event_feed(spark, path, spark.createDataFrame([], schema).schema, files=1)
    got = caught_up(stream_key_first_use(stream, "1 hour", 1.0), "first-use-twice").collect()
    counted = sorted((r.creation_uid, r.event_count, r.failures, r.sensitive_actions, r.distinct_services) for r in got)
    assert counted == [("l", 1, 1, 1, 1)] * 3 + [("m", 0, 0, 0, 0)] * 2


def test_manifest_checks_spread_over_tasks(spark, monkeypatch):
    from sparkwarden.plans import table_logs
    from sparkwarden.plans.proofs import provenance

    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).exists():
        pytest.skip("test tables not mounted")
    monkeypatch.setattr(table_logs, "PER_TASK", 10)
    assert provenance.manifest_checks(spark, sf_dir).rdd.getNumPartitions() > 4  # cores, of one small file
