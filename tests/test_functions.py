import ipaddress
import json
import random

from pyspark.sql import functions as F

from sparkwarden.functions.instants import ISO_ZONED, epoch_nanos, extended, instant
from sparkwarden.functions.json_access import (
    boolean_at,
    canonical_json,
    integer_at,
    is_array,
    is_empty_object,
    is_object,
    loose_text,
    text_at,
)
from sparkwarden.functions.network import ip_text
from sparkwarden.functions.numbers import integer_from_text, ratio


def test_getters_are_type_strict(spark):
    values = ['"x"', '""', "1", "0", "0.0", "true", "false", '"false"', "null", "{}", '{"b":1}', "[]"]
    rows = spark.createDataFrame([(v, json.dumps({"a": json.loads(v)})) for v in values], "v string, t string")
    v = F.parse_json("t")
    got = {
        r[0]: tuple(r[1:])
        for r in rows.select(
            "v", text_at(v, "$.a"), loose_text(v, "$.a"), integer_at(v, "$.a"), boolean_at(v, "$.a"),
            is_object(v, "$.a"), is_array(v, "$.a"), is_empty_object(v, "$.a"),
        ).collect()
    }
    assert got['"x"'] == ("x", "x", None, None, False, False, False)
    assert got['""'] == (None, "", None, None, False, False, False)
    assert got["1"][:4] == (None, "1", 1, None)
    assert got["0"][2] == 0 and got["0.0"][2] is None
    assert got["true"][:4] == (None, "true", None, True)
    assert got["false"][3] is False and got['"false"'][3] is None
    assert got["null"] == (None, None, None, None, False, False, False)
    assert got["{}"][4:] == (True, False, True)
    assert got['{"b":1}'][4:] == (True, False, False)
    assert got["[]"][4:] == (False, True, False)


def test_canonical_text_sorts_and_keeps_the_last_duplicate(spark):
    rows = spark.createDataFrame([('{"b": {"z":1,"a":"é"}, "a": [1, null], "b2":1, "b2":2}',)], "t string")
    assert rows.select(canonical_json(F.parse_json("t"))).first()[0] == (
        '{"a":[1,null],"b":{"a":"é","z":1},"b2":2}'
    )


def test_basic_forms_of_instants(spark):
    same = ["2025-02-03T12:30:15Z", "20250203T123015Z", "2025-02-03T12:30:15+0000", "2025-02-03 12:30:15+00",
            "20250203T143015+0200", "20250203T113015-01", "2025-02-03T123015+00:00"]
    other = {"20250203T123015.25Z": 250_000, "20250203T1230Z": -15_000_000, "2025-02-03T12:30+00": -15_000_000,
             "2025-02-03 12:30Z": -15_000_000, "2025-02-03T13:30+01:00": -15_000_000}
    refused = ["2025-02-03", "20250203", "20250203T123015", "2025-02-03T12:30:15", "20251303T123015Z", "x+0000", "", "12:30+00"]
    rows = spark.createDataFrame([(t,) for t in [*same, *other, *refused, None]], "t string")
    stamp = instant(extended(F.col("t")), ISO_ZONED, keep_nanos=False)
    found = {r.t: (r.us, r.refused) for r in rows.select("t", F.unix_micros(stamp.time).alias("us"), stamp.refused.alias("refused")).collect()}
    base = 1_738_585_815_000_000
    assert [found[t] for t in same] == [(base, False)] * len(same)
    assert {t: found[t] for t in other} == {t: (base + more, False) for t, more in other.items()}
    assert [found[t] for t in refused] == [(None, True)] * len(refused)
    assert found[None] == (None, False)


def test_instants(spark):
    cases = {
        "2024-01-01T00:00:00Z": 1704067200000000000,
        "2024-01-01T02:00:00.123456789+02:00": 1704067200123456789,
        "1969-12-31T23:59:59.999999999Z": -1,
        "2024-01-01T00:00:00": None,
        "2024-02-30T00:00:00Z": None,
        "2024-01-01T00:00:00.1234567890Z": None,
        "2024-01-01T24:00:00Z": None,
        "2024-01-01T00:00:00Z\n": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    stamp = instant(F.col("t"))
    got = {r[0]: (r[1], r[2]) for r in rows.select("t", epoch_nanos(stamp.time, stamp.nanos), stamp.refused).collect()}
    for text, expected in cases.items():
        assert got[text] == (expected, expected is None), text
    coarse = instant(F.col("t"), ISO_ZONED, keep_nanos=False)
    assert rows.select(epoch_nanos(coarse.time, coarse.nanos)).collect()[1][0] == 1704067200123456000


def test_ip_literals_equal_the_standard_library(spark):
    random.seed(7)
    group = lambda: random.choice(["0", "0", "00", "1", "0db8", "ABCD", "ffff"])
    texts = [":".join(group() for _ in range(8)) for _ in range(300)]
    for _ in range(500):
        g = [group() for _ in range(8)]
        i = random.randint(0, 7)
        texts.append(":".join(g[:i]) + "::" + ":".join(g[random.randint(i, 8):]))
    texts += [
        "::", "::1", "1::", ":::", "1::2::3", "1:2", "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4", "::1.2.3.4",
        "::1.2.3", "g::", "1.2.3.4", "01.2.3.4", "256.1.1.1", "a.example", "1.2.3.4:80", "", "1.2.3.4\n", "12345::",
    ]

    def expected(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip_text(F.col("t"))).collect()
    assert [r for r in rows if r[1] != expected(r[0])] == []


def test_numbers(spark):
    rows = spark.createDataFrame([(t,) for t in ("22.5", "1e2", " 22 ", "x", None, "99999999999")], "t string")
    assert [r[0] for r in rows.select(integer_from_text(F.col("t"))).collect()] == [23, 100, 22, None, None, None]
    assert spark.range(1).select(ratio(F.lit(2), F.lit(3)), ratio(F.lit(1), F.lit(0))).first() == (0.666667, None)
