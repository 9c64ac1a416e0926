"""Operators on the given tables directly: the activity table as an audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.identity import IDENTITY_TAG, raw_uid, scoped_uid
from sparkwarden.functions.instants import instant, epoch_nanos, seconds_between
from sparkwarden.functions.json_access import canonical_json, loose_text
from sparkwarden.functions.network import ip_text
from sparkwarden.functions.numbers import integer_from_text
from sparkwarden.operators.arrays import explode_json
from sparkwarden.operators.dedupe import absent_from, first_deliveries
from sparkwarden.operators.findings import finding_id
from sparkwarden.operators.quality import conflicts, repeated, violations
from sparkwarden.operators.sequence import (
    absent_between,
    anchored_window,
    follow_ups,
    per_anchor,
    sequence_pairs,
)
from sparkwarden.operators.timeline import within_spans
from sparkwarden.plans.proofs.registry import query
from sparkwarden.plans.rules import Query, Sequence, Step

SECOND = 10**9
HALF_HOUR, DAY = 1800 * SECOND, 86_400 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity with ``event_ns``, so that the time operators apply."""
    return table(spark, sf_dir, "events").withColumn(
        "event_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    )


def of_type(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds)).select("user_id", "event_id", "event_ns")


def _pairs(events: DataFrame, within: int) -> DataFrame:
    return sequence_pairs(of_type(events, "error"), of_type(events, "purchase"), ["user_id"], within)


_PAIR = """FROM events a JOIN events b ON a.user_id = b.user_id
 AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '{window}'
WHERE a.event_type = 'error' AND b.event_type = 'purchase'"""
_HALF_HOUR_PAIR, _DAY_PAIR = _PAIR.format(window="30 minutes"), _PAIR.format(window="24 hours")
_NO_CLICK = """ AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click'
 AND c.user_id = a.user_id AND c.ts > a.ts AND c.ts < b.ts)"""


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "user_id",
        F.col("first_event_id").alias("first_id"),
        F.col("second_event_id").alias("second_id"),
        seconds_between(F.col("first_event_ns"), F.col("second_event_ns")).alias("elapsed_seconds"),
    )


_PAIR_COLUMNS = """SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id,
 (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS elapsed_seconds """


@query(_PAIR_COLUMNS + _HALF_HOUR_PAIR)
def seq_pair(spark, sf_dir):
    """Ordered pairs within half an hour."""
    return _pair_columns(_pairs(log(spark, sf_dir), HALF_HOUR))


@query(_PAIR_COLUMNS + _DAY_PAIR + _NO_CLICK)
def seq_pair_no_blocker(spark, sf_dir):
    """Ordered pairs within a day with no blocker strictly between."""
    events = log(spark, sf_dir)
    kept = absent_between(
        _pairs(events, DAY),
        of_type(events, "click"),
        {"user_id": "user_id"},
        DAY,
        start="first_event_ns",
        end="second_event_ns",
    )
    return _pair_columns(kept)


_FIRST_USE = """FROM (SELECT * FROM events WHERE event_type = 'signup') a LEFT JOIN events b
 ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '24 hours'
 AND a.event_id <> b.event_id"""


@query(f"""SELECT a.event_id AS anchor_id, a.user_id,
 CASE WHEN count(b.event_id) = 0 THEN 'no_use_observed' ELSE 'use_observed' END AS observation,
 count(b.event_id) AS event_count, count(DISTINCT b.event_type) AS distinct_types,
 count(DISTINCT b.props) AS distinct_props,
 count(*) FILTER (WHERE b.event_type = 'error') AS errors,
 min(epoch_us(b.ts)) AS first_use, max(epoch_us(b.ts)) AS last_use
{_FIRST_USE} GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.event_id, a.user_id"))
def first_use_inventory(spark, sf_dir):
    """Every sign-up with what its user did in the next day, idle ones too."""
    events = log(spark, sf_dir)
    anchors = of_type(events, "signup")
    uses = follow_ups(
        anchors,
        events.select("user_id", "event_id", "event_ns", "event_type", "props"),
        ["user_id"],
        DAY,
        uid="event_id",
    )
    counted = per_anchor(
        anchors,
        uses,
        {
            "n": F.count("*"),
            "types": F.count_distinct("use_event_type"),
            "props": F.count_distinct("use_props"),
            "errors": F.count_if(F.col("use_event_type") == "error"),
            "first_use": F.min(F.expr("use_event_ns div 1000")),
            "last_use": F.max(F.expr("use_event_ns div 1000")),
        },
        uid="event_id",
    )
    zero = lambda name, alias: F.coalesce(name, F.lit(0)).alias(alias)
    return counted.select(
        F.col("event_id").alias("anchor_id"),
        "user_id",
        F.when(F.col("n") > 0, "use_observed").otherwise("no_use_observed").alias("observation"),
        zero("n", "event_count"),
        zero("types", "distinct_types"),
        zero("props", "distinct_props"),
        zero("errors", "errors"),
        "first_use",
        "last_use",
    )


@query(f"SELECT a.event_id AS anchor_id, b.event_id AS use_id {_FIRST_USE} WHERE b.event_id IS NOT NULL")
def first_use_events(spark, sf_dir):
    """The events behind the inventory, one row each."""
    events = log(spark, sf_dir)
    uses = follow_ups(
        of_type(events, "signup"),
        events.select("user_id", "event_id", "event_ns"),
        ["user_id"],
        DAY,
        uid="event_id",
    )
    return uses.select(
        F.col("anchor_event_id").alias("anchor_id"), F.col("use_event_id").alias("use_id")
    )


_ANCHORED = """WITH marked AS (SELECT *, CASE WHEN user_id % 10 <> 0 THEN user_id END AS owner,
 CASE WHEN event_id % 50 <> 0 THEN ts END AS seen FROM events),
anchored AS (SELECT *, first_value(seen) OVER (PARTITION BY owner,
  CASE WHEN owner IS NULL THEN event_id END ORDER BY seen NULLS LAST, event_id) AS start
 FROM marked),
selected AS (SELECT * FROM anchored WHERE seen IS NULL OR seen <= start + INTERVAL '48 hours')
"""


def _anchored(spark, sf_dir):
    marked = log(spark, sf_dir).selectExpr(
        "if(user_id % 10 <> 0, user_id, NULL) AS owner",
        "event_id",
        "if(event_id % 50 <> 0, event_ns, NULL) AS event_ns",
        "event_type",
        "props",
    )
    return anchored_window(marked, ["owner"], ["owner"], 2 * DAY, uid="event_id")


@query(_ANCHORED + """SELECT owner, CASE WHEN owner IS NULL THEN event_id END AS unresolved_id,
 count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
 count(DISTINCT props) AS distinct_props, min(epoch_us(seen)) AS first_seen,
 max(epoch_us(seen)) AS last_seen FROM selected GROUP BY 1, 2""")
def anchored_inventory(spark, sf_dir):
    """Events within two days of their user's first; unknown users stand alone."""
    return (
        _anchored(spark, sf_dir)
        .groupBy("owner", F.col("unresolved_uid").alias("unresolved_id"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count_distinct("props").alias("distinct_props"),
            F.min(F.expr("event_ns div 1000")).alias("first_seen"),
            F.max(F.expr("event_ns div 1000")).alias("last_seen"),
        )
    )


@query(_ANCHORED + "SELECT event_id, owner FROM selected")
def anchored_events(spark, sf_dir):
    return _anchored(spark, sf_dir).select("event_id", "owner")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k_text FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 20 AND 22
 AND event_type IN ('view', 'error')""")
def json_predicate(spark, sf_dir):
    """Predicates on JSON members and IN lists."""
    document = F.parse_json("props")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("view", "error"))
        .where(F.try_variant_get(document, "$.k", "int").between(20, 22))
        .select("event_id", loose_text(document, "$.k").alias("k_text"))
    )


@query("""WITH members AS (
 SELECT l_orderkey, l_linenumber, 0 AS place, l_quantity AS q, l_returnflag AS flag FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 1, 50 - l_quantity, 'R' FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 2, l_quantity, 'X' FROM lineitem)
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(place AS VARCHAR) AS place, q AS quantity
FROM members WHERE flag = 'R' AND 45 BETWEEN q AND q + 5""")
def explode_same_element(spark, sf_dir):
    """All conditions on one member of a JSON array, after unnesting it."""
    member = lambda q, flag: F.struct(q.alias("q"), flag.alias("flag"))
    quantity = F.col("l_quantity")
    documents = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.to_variant_object(
            F.array(
                member(quantity, F.col("l_returnflag")),
                member(50 - quantity, F.lit("R")),
                member(quantity, F.lit("X")),
            )
        ).alias("members"),
    )
    q = F.try_variant_get("member", "$.q", "double")
    return (
        explode_json(documents, "members", "member", "place")
        .where((loose_text(F.col("member"), "$.flag") == "R") & F.lit(45).between(q, q + 5))
        .select("order_id", "line", "place", q.alias("quantity"))
    )


@query("""SELECT c_custkey AS id, unnest(['0', '1', '2']) AS element_index,
 unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS element FROM customer
UNION ALL SELECT c_custkey, unnest(['name', 'segment']), unnest([c_name, c_mktsegment])
 FROM customer""")
def unnest_keys(spark, sf_dir):
    """Unnesting gives array indexes as text, and the member names of objects."""
    rows = table(spark, sf_dir, "customer")
    as_list = rows.select(
        F.col("c_custkey").alias("id"),
        F.to_variant_object(
            F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
        ).alias("document"),
    )
    as_object = rows.select(
        F.col("c_custkey").alias("id"),
        F.to_variant_object(
            F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
        ).alias("document"),
    )
    both = [
        explode_json(d, "document", "value_", "element_index").select(
            "id", "element_index", F.col("value_").cast("string").alias("element")
        )
        for d in (as_list, as_object)
    ]
    return both[0].unionByName(both[1])


@query(f"""SELECT event_id, 'evt_' || sha256(replace(props, ': ', ':')) AS raw_uid,
 'evt_v2_' || sha256('["{IDENTITY_TAG}","azure","azure.activity","azure.subscription",'
  || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE '"sub-' || user_id || '"' END || ',null,'
  || replace(props, ': ', ':') || ']') AS scoped_uid FROM events""")
def event_identity(spark, sf_dir):
    """Both identity schemes over canonical records."""
    record = F.parse_json("props")
    scope_id = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("sub-"), F.col("user_id")))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        raw_uid(record).alias("raw_uid"),
        scoped_uid(
            record, F.lit("azure"), F.lit("azure.activity"), F.lit("azure.subscription"), scope_id,
            none,
        ).alias("scoped_uid"),
    )


@query("""SELECT o_orderkey AS id, '{"a":{"b":[1,null,"' || o_orderstatus || '"],"é":'
 || o_orderkey || '},"m":"' || o_orderpriority || '","z":' || o_custkey || '}' AS canonical
FROM orders""")
def canonical_document(spark, sf_dir):
    """Canonical text: sorted keys at every depth, no white space, non-ASCII kept."""
    text = F.concat(
        F.lit('{ "z" : '), "o_custkey", F.lit(', "m":"'), "o_orderpriority",
        F.lit('", "a": {"é" : '), "o_orderkey", F.lit(', "b":[1, null, "'), "o_orderstatus",
        F.lit('" ] } }'),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), canonical_json(F.parse_json(text)).alias("canonical")
    )


@query("""SELECT user_id, event_type, min(event_id) AS one_id, max(event_id) AS other_id
FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_id) > 1""")
def source_id_conflicts(spark, sf_dir):
    """Identities carried by more than one record."""
    found = conflicts(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")
    return found.withColumnsRenamed({"one_uid": "one_id", "other_uid": "other_id"})


@query("""SELECT nullif(user_id % 4, 0) AS scope, event_type AS source_id, count(*) AS n
FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def ambiguous_ids(spark, sf_dir):
    """Repeated keys; NULL keys are equal to each other."""
    rows = table(spark, sf_dir, "events").select(
        F.nullif(F.col("user_id") % 4, F.lit(0)).alias("scope"),
        F.col("event_type").alias("source_id"),
    )
    return repeated(rows, ["scope", "source_id"]).withColumnRenamed("count", "n")


@query("""WITH batch AS (SELECT event_id, 'a' AS file, event_id AS pointer FROM events
 UNION ALL SELECT event_id, 'b', event_id FROM events WHERE event_id % 3 = 0
 UNION ALL SELECT event_id, 'c', event_id FROM events WHERE event_id % 7 = 0)
SELECT event_id AS event_uid, min(file) AS file, min(pointer) AS pointer FROM batch
WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') GROUP BY 1""")
def dedupe_deliveries(spark, sf_dir):
    """New events of a batch with repeated deliveries, against those already stored."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_uid"), F.col("event_id").alias("pointer"), "event_type"
    )
    batch = (
        events.withColumn("file", F.lit("a"))
        .unionByName(events.where("event_uid % 3 = 0").withColumn("file", F.lit("b")))
        .unionByName(events.where("event_uid % 7 = 0").withColumn("file", F.lit("c")))
    )
    stored = events.where("event_type = 'view'").select("event_uid")
    return first_deliveries(batch.drop("event_type"), stored, ["file", "pointer"]).select(
        "event_uid", "file", "pointer"
    )


@query("""SELECT DISTINCT user_id, event_type FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b
 WHERE b.event_id % 5 = 0 AND b.user_id = a.user_id AND b.event_type = a.event_type)""")
def insert_if_absent(spark, sf_dir):
    """Set difference by key against what is stored."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    keys = ["user_id", "event_type"]
    return absent_from(events.select(*keys), events.where("event_id % 5 = 0"), keys)


_FINDING = """'finding_' || substr(sha256('["error_purchase","1.0.0","0000",["' || {a} || '","'
 || {b} || '"]]'), 1, 24)"""


@query(f"""SELECT {_FINDING.format(a="'e' || a.user_id || '-' || a.event_id", b="'d' || epoch_us(date_trunc('day', b.ts))")} AS finding_id,
 count(*) AS matches {_DAY_PAIR} GROUP BY 1""")
def evidence_grouping(spark, sf_dir):
    """Matches grouped by their ordered evidence; the id is a hash of it."""
    pairs = _pairs(log(spark, sf_dir), DAY)
    uids = F.array(
        F.concat(F.lit("e"), "user_id", F.lit("-"), "first_event_id"),
        F.concat(F.lit("d"), F.expr("(second_event_ns div 86400000000000) * 86400000000")),
    )
    return (
        pairs.select(finding_id("error_purchase", "1.0.0", "0000", uids).alias("finding_id"))
        .groupBy("finding_id")
        .agg(F.count("*").alias("matches"))
    )


@query(f"""WITH pairs AS (SELECT nullif(a.user_id % 10, 0) AS scope, a.user_id,
 a.event_id AS first_id, b.event_id AS second_id, a.ts AS t0, b.ts AS t1 {_HALF_HOUR_PAIR})
SELECT p.first_id, p.second_id, e.event_id AS context_id FROM pairs p JOIN events e
 ON p.user_id = e.user_id AND p.scope IS NOT DISTINCT FROM nullif(e.user_id % 10, 0)
 AND e.ts BETWEEN p.t0 AND p.t1""")
def context_timeline(spark, sf_dir):
    """Events of the same scope between the ends of each pair; NULL equals NULL."""
    events = log(spark, sf_dir).withColumn("scope", F.nullif(F.col("user_id") % 10, F.lit(0)))
    spans = _pairs(events, HALF_HOUR).withColumn("scope", F.nullif(F.col("user_id") % 10, F.lit(0)))
    found = within_spans(
        spans,
        events.select("scope", "user_id", "event_id", "event_ns"),
        ["user_id", "scope"],
        start="first_event_ns",
        end="second_event_ns",
        width=HALF_HOUR,
        null_safe=["scope"],
    )
    return found.select(
        F.col("first_event_id").alias("first_id"),
        F.col("second_event_id").alias("second_id"),
        F.col("ctx_event_id").alias("context_id"),
    )


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, 'late' AS reason FROM lineitem
WHERE l_shipdate > TIMESTAMP '2001-01-01' UNION ALL
SELECT l_orderkey, l_linenumber, 'large' FROM lineitem WHERE l_quantity >= 48""")
def union_ranges(spark, sf_dir):
    """Two filtered branches, duplicates kept."""
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda where, reason: lines.where(where).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.lit(reason).alias("reason"),
    )
    return pick("l_shipdate > timestamp_ntz '2001-01-01'", "late").unionByName(
        pick("l_quantity >= 48", "large")
    )


@query("SELECT DISTINCT a.user_id, CAST(b.ts AS DATE) AS day " + _DAY_PAIR)
def distinct_pairs(spark, sf_dir):
    pairs = _pairs(log(spark, sf_dir), DAY)
    day = F.to_date(F.timestamp_micros(F.expr("second_event_ns div 1000")))
    return pairs.select("user_id", day.alias("day")).distinct()


@query("SELECT event_type AS source, count(*) AS events FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("events"))


@query("""WITH mixed AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(event_type)
 ELSE event_type END AS action FROM events)
SELECT a.event_id AS first_id, b.event_id AS second_id FROM mixed a JOIN mixed b
 ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2 hours'
WHERE lower(a.action) = 'signup' AND lower(b.action) = 'click'""")
def case_insensitive_action(spark, sf_dir):
    """A declared sequence rule with case-insensitive actions."""
    carry = ("user_id", "event_id", "event_ns")
    rule = Sequence(
        Step("lower(action) = 'signup'", carry),
        Step("lower(action) = 'click'", carry),
        ("user_id",),
        ("first_event_id AS first_id", "second_event_id AS second_id"),
        within_seconds=7200,
    )
    mixed = log(spark, sf_dir).withColumn(
        "action", F.expr("if(event_id % 2 = 0, upper(event_type), event_type)")
    )
    return rule.matches(mixed)


@query("""SELECT c.c_custkey AS id, o.o_orderkey AS order_id FROM customer c JOIN orders o
 ON '//key/' || c.c_name = '//key/Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0')
WHERE regexp_full_match(c.c_name, 'Customer#[0-9]+[02468]')""")
def key_prefix_join(spark, sf_dir):
    """Join on a derived key behind a full-match guard."""
    keys = table(spark, sf_dir, "customer").where(F.col("c_name").rlike(r"^Customer#[0-9]+[02468]\z"))
    used = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("//key/Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("key"),
    )
    return keys.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("//key/"), "c_name").alias("key")
    ).join(used, "key").select("id", "order_id")


@query("""SELECT a.event_id AS id, b.o_orderkey AS order_id FROM events a JOIN orders b
 ON nullif(a.event_id % 997, 0) IS NOT DISTINCT FROM nullif(b.o_orderkey % 9973, 0)""")
def null_safe_lookup(spark, sf_dir):
    """Join in which unknown equals unknown. Orders of a remainder travel in lists, of those
    within a million keys, so that an event meets a list and not each order; every pair is a row."""
    a = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.nullif(F.col("event_id") % 997, F.lit(0)).alias("x")
    )
    b = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.nullif(F.col("o_orderkey") % 9973, F.lit(0)).alias("y")
    )
    block = F.expr("order_id div 1000000").alias("block")
    lists = b.groupBy("y", block).agg(F.collect_list(F.struct("order_id")).alias("orders"))
    return a.join(lists, F.col("x").eqNullSafe(F.col("y"))).select("id", F.inline("orders"))


@query("""SELECT o_orderkey AS id, 'status' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority LIKE '1%'""")
def violations_report(spark, sf_dir):
    """One row per broken rule, in one pass."""
    return violations(
        table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id"),
        ["id"],
        {
            "status": ~F.col("o_orderstatus").isin("O", "F"),
            "price": F.col("o_totalprice") > 400000,
            "priority": F.col("o_orderpriority").startswith("1"),
        },
    )


@query("""WITH scoped AS (SELECT * FROM events WHERE user_id % 2 = 0)
SELECT a.event_id AS first_id, b.event_id AS second_id FROM scoped a JOIN scoped b
 ON a.user_id // 4 = b.user_id // 4 AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '6 hours'
WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM scoped c
 WHERE c.event_type = 'click' AND c.user_id // 4 = a.user_id // 4 AND c.ts > a.ts AND c.ts < b.ts)""")
def scoped_rule(spark, sf_dir):
    """A rule in SQL whose every read, the exclusion included, sees its scope only."""
    rule = Query("""SELECT a.event_id AS first_id, b.event_id AS second_id
        FROM {events} a JOIN {events} b ON a.team = b.team AND a.slot_a = b.slot
         AND b.event_ns > a.event_ns AND b.event_ns <= a.event_ns + 21600000000000
        WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND b.copy = 0
        AND NOT EXISTS (SELECT 1 FROM {events} c WHERE c.event_type = 'click' AND c.copy = 0
         AND c.team = a.team AND c.slot BETWEEN a.slot_0 AND a.slot_0 + 1
         AND c.event_ns > a.event_ns AND c.event_ns < b.event_ns)""")
    slot = "event_ns div 21600000000000"
    scoped = log(spark, sf_dir).where("user_id % 2 = 0").selectExpr(
        "event_id", "event_type", "user_id div 4 AS team", "event_ns", f"{slot} AS slot",
        f"{slot} AS slot_0", f"explode(array({slot}, {slot} + 1)) AS slot_a",
    ).withColumn("copy", F.expr("slot_a - slot_0"))
    return rule.matches(scoped)


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line,
 try_cast(CAST(l_extendedprice AS VARCHAR) AS INTEGER) AS price,
 try_cast(l_returnflag AS INTEGER) AS flag,
 try_cast(' ' || l_linenumber || 'e2 ' AS INTEGER) AS scaled FROM lineitem""")
def integers_from_text(spark, sf_dir):
    """Integers from decimal and exponent text."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        integer_from_text(F.col("l_extendedprice").cast("string")).alias("price"),
        integer_from_text(F.col("l_returnflag")).alias("flag"),
        integer_from_text(F.concat(F.lit(" "), "l_linenumber", F.lit("e2 "))).alias("scaled"),
    )


@query("""SELECT event_id,
 CASE WHEN event_id % 4 = 3 THEN NULL
  ELSE epoch_us(ts) * 1000 + event_id % 1000 - CASE WHEN event_id % 4 = 1 THEN 19800000000000
  ELSE 0 END END AS event_ns,
 event_id % 4 = 3 AS refused FROM events""")
def zoned_instants(spark, sf_dir):
    """Zoned text to exact nanoseconds; text without a zone is refused."""
    nanos = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        nanos,
        F.element_at(F.array(*map(F.lit, ("Z", "+05:30", "+00:00", ""))), (F.col("event_id") % 4 + 1).cast("int")),
    )
    stamp = instant(F.col("text"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", text.alias("text"))
        .select(
            "event_id",
            epoch_nanos(stamp.time, stamp.nanos).alias("event_ns"),
            stamp.refused.alias("refused"),
        )
    )


@query("""SELECT event_id, CASE event_id % 4
 WHEN 0 THEN (event_id % 256) || '.' || (user_id % 256) || '.0.1'
 WHEN 1 THEN 'fe80::' || printf('%x', event_id % 65535 + 1)
 WHEN 2 THEN printf('%x', event_id % 65535 + 1) || ':0:1::' || printf('%x', user_id % 65535 + 1)
 END AS ip FROM events""")
def ip_literals(spark, sf_dir):
    """IPv4 and IPv6 literals in compressed form; anything else is NULL."""
    n, m = F.expr("event_id % 65535 + 1"), F.expr("user_id % 65535 + 1")
    text = (
        F.when(F.expr("event_id % 4 = 0"), F.expr("(event_id % 256) || '.' || (user_id % 256) || '.0.1'"))
        .when(F.expr("event_id % 4 = 1"), F.concat(F.lit("FE80:0:0:0::0:"), F.lpad(F.hex(n), 4, "0")))
        .when(
            F.expr("event_id % 4 = 2"),
            F.concat(F.hex(n), F.lit(":0:1:0:0:0:0:"), F.hex(m)),
        )
        .otherwise(F.concat(F.lit("host-"), F.col("event_id"), F.lit(".example.net")))
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", text.alias("text"))
        .select("event_id", ip_text(F.col("text")).alias("ip"))
    )
