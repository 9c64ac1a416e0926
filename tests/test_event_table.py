"""The event table that rules read when it is written more than once; rules that find nothing."""

from pathlib import Path

import pytest
from oracle import compare, connect

from sparkwarden.plans import table_logs
from sparkwarden.plans.proofs import ORACLES, QUERIES

EVENTS = "/root/testdata/sf0.001/events.parquet"

pytestmark = pytest.mark.skipif(not Path(EVENTS).exists(), reason="test tables not mounted")


def test_write_that_ends_after_a_later_one(spark, tmp_path, monkeypatch):
    sf_dir, source, later = str(tmp_path), "gcp.audit", []
    spark.read.parquet(EVENTS).limit(100).write.parquet(f"{sf_dir}/events.parquet")
    normalized = table_logs.normalized

    def cut_off(*args):
        if not later:  # the caller gave up on this write and asked again; it still ends
            later.append(None)
            later[0] = table_logs.stored(spark, sf_dir, source)
        return normalized(*args)

    monkeypatch.setattr(table_logs, "normalized", cut_off)
    earlier = table_logs.stored(spark, sf_dir, source)
    for events in (earlier, later[0], table_logs.stored(spark, sf_dir, source)):
        assert (events.count(), events.select("id").distinct().count()) == (100, 100)


def test_rows_of_a_write_that_is_not_complete(spark, tmp_path, monkeypatch):
    sf_dir, source = str(tmp_path), "gcp.audit"
    spark.read.parquet(EVENTS).limit(100).write.parquet(f"{sf_dir}/events.parquet")
    monkeypatch.setattr(table_logs, "_WRITTEN", type(table_logs._WRITTEN)())
    table_logs.stored(spark, sf_dir, source)
    table_logs._WRITTEN.clear()  # as if the write had been cut off after its files were there
    twice = table_logs.stored(spark, sf_dir, source)
    assert (twice.count(), twice.select("id").distinct().count()) == (100, 100)


@pytest.mark.parametrize("name", ["findings_baseline", "findings_restart_aware"])
def test_rules_that_find_nothing(spark, tmp_path, name):
    one = spark.read.parquet(EVENTS).where("event_id < 7").coalesce(1)  # no rule has a finding here
    one.write.parquet(f"{tmp_path}/events.parquet")
    connection = connect(str(tmp_path / "no_views"))
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() == 6
    assert compare(found, connection, ORACLES[name]) is None
