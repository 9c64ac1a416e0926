"""Secrets in whole texts: fixed patterns, and random-looking tokens by a test battery.

Everything is DataFrame functions. Three patterns give the base spans. Beyond them,
each long token whose characters fit an encoding (hexadecimal, base32, base64) is
tested for being random: chi-squared uniformity of its alphabet, the runs test about
the middle of the alphabet, and the lag-one serial correlation. The smallest of the
three p-values, times three, speaks for the token. Within bands of length, Benjamini
and Hochberg's step-up rule at ``RATE`` picks the tokens that are not random, so that
among those the expected share of truly random ones stays below the rate; all other
tested tokens are reported as ``random`` unless a base span already covers part of them.

The rule needs the ranks of all p-values. They are counted per band in tenths of a
decade, at most ``BINS`` counts for each of five bands, whatever the table's size.

Positions count code points from 0, ends are exclusive. Given results: null text is
empty and has no spans; its digest is that of the empty string. Every row gives one
row, repeated rows too; empty tables give none. Extra columns are ignored, except that
``redacted`` carries the documents' own columns through and leaves a null text null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.shared import kept

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run is maximal, so asking for its least length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
# name, pattern of the whole token, alphabet in its coding order; the first that fits counts
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
RATE = 0.01
BINS = 400
BANDS = (28, 40, 64, 128)  # lower ends of all length bands but the first
MASK = "[SECRET]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _running_sum(numbers: Column) -> Column:
    """Inclusive sums of a long array that is not empty, by stretches of its square root."""

    def within(array: Column, width: Column) -> Column:
        def extended(sums: Column, stretch: Column) -> Column:
            part = _sum(F.slice(array, stretch * width + 1, width))
            return F.concat(sums, F.array(F.element_at(sums, -1) + part))

        stretches = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / width).cast("int"))
        before = F.aggregate(stretches, F.array(F.lit(0).cast("long")), extended)

        def total(sums: Column) -> Column:
            def at(i: Column) -> Column:
                inside = F.pmod(i, width)
                return F.get(sums, F.floor(i / width).cast("int")) + _sum(F.slice(array, i - inside + 1, inside + 1))

            return F.transform(F.sequence(F.lit(0), F.size(array) - 1), at)

        return _let(before, total)

    return _let(
        numbers, lambda array: _let(F.ceil(F.sqrt(F.size(array))).cast("int"), lambda width: within(array, width))
    )


_SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of all leftmost matches: the stretches between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group)
    gaps = F.split(text, pattern, -1)

    def spans(whole: Column) -> Column:
        steps = F.zip_with(
            F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: (F.length(g) + F.length(m)).cast("long")
        )
        pairs = F.zip_with(_running_sum(steps), whole, lambda end, m: F.struct(end.alias("end"), F.length(m).alias("n")))
        return F.zip_with(
            pairs,
            values,
            lambda p, v: F.struct(
                (p["end"] - p["n"]).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), v.alias("value")
            ),
        )

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def _upper_tail(z: Column) -> Column:
    """P(N > z) of the standard normal, within 1e-7 for z >= 0 (Abramowitz and Stegun
    26.2.17) and by symmetry below."""
    # Fixed values of that formula.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(z: Column) -> Column:
        def area(t: Column) -> Column:
            series = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
            return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * series

        return _let(_let(1 / (1 + F.lit(0.2316419) * F.abs(z)), area), lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return _let(z, tail)


def _battery(token: Column, alphabet: str) -> Column:
    """The combined p-value of a token over its alphabet."""
    size = len(alphabet)
    symbols = F.array(*(F.lit(c) for c in alphabet))
    place = F.transform(F.regexp_extract_all(token, F.lit("."), 0), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))

    def count(symbol: Column) -> Column:
        return (F.length(token) - F.length(F.replace(token, symbol, F.lit("")))).cast("double")

    squares = F.aggregate(symbols, F.lit(0.0), lambda sum_, c: sum_ + count(c) * count(c))
    zero = F.struct(
        F.lit(-1.0).alias("last"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"),
        F.lit(0.0).alias("high"), F.lit(1.0).alias("runs"),
    )
    half = size / 2

    def step(s: Column, x: Column) -> Column:
        follows = s["last"] >= 0
        turned = follows & ((s["last"] >= half) != (x >= half))
        return F.struct(
            x.alias("last"), (s["x"] + x).alias("x"), (s["xx"] + x * x).alias("xx"),
            (s["xy"] + F.when(follows, s["last"] * x).otherwise(0.0)).alias("xy"),
            (s["high"] + F.when(x >= half, 1.0).otherwise(0.0)).alias("high"),
            (s["runs"] + F.when(turned, 1.0).otherwise(0.0)).alias("runs"),
        )

    def p_value(s: Column) -> Column:
        n = F.length(token).cast("double")
        df = size - 1
        chi = squares * size / n - n
        # Wilson and Hilferty's cube root
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        product = 2 * s["high"] * (n - s["high"])
        mean = product / n + 1
        spread = product * (product - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, F.abs(s["runs"] - mean) / F.sqrt(spread)).otherwise(40.0)
        middle = s["x"] / n
        variance = s["xx"] - n * middle * middle
        # products around the middle; the two ends enter the sum once each
        serial = s["xy"] - middle * (2 * s["x"] - s["last"]) + middle * middle * (n - 1)
        z_serial = F.when(variance > 0, F.abs(serial / variance) * F.sqrt(n)).otherwise(40.0)
        least = F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_serial))
        return F.least(F.lit(1.0), 3 * least)

    return F.aggregate(place, zero, step, p_value)


_TESTED = "array<struct<start:long,kind:int,end:long,band:int,bin:int>>"


def _tested(text: Column, base: Column) -> Column:
    """Tokens outside base spans with their length band and p-value bin."""

    def fitting(token: Column) -> Column:
        body = F.regexp_replace(token, "=+$", "")
        p = F.lit(None).cast("double")
        for _, pattern, alphabet in reversed(ENCODINGS):
            p = F.when(token.rlike(pattern), _battery(body, alphabet)).otherwise(p)
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
        return F.when(mixed, p)

    def tested(s: Column) -> Column:
        size = s["end"] - s["start"]
        band = F.lit(0)
        for lower in BANDS:
            band = band + (size >= lower).cast("int")

        def tenths(p: Column) -> Column:
            return F.when(p > 0, F.least(F.floor(-10 * F.log10(p)), F.lit(BINS - 1))).when(p == 0, F.lit(BINS - 1))

        place = _let(fitting(s["value"]), tenths).cast("int")
        return F.struct(
            s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"),
            band.alias("band"), place.alias("bin"),
        )

    def free(s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    fresh = F.filter(_matches(text, TOKEN, 3), free)
    results = F.filter(F.transform(fresh, tested), lambda t: t["bin"].isNotNull())
    return F.when(text.rlike(TOKEN), results).otherwise(F.array().cast(_TESTED))


def _not_random_from(tested: DataFrame) -> dict[int, int]:
    """Per band the least bin that is called not random. ``tested`` is the stored table."""
    counts: dict[int, dict[int, int]] = {}
    rows = tested.select(F.explode("tested").alias("t")).groupBy("t.band", "t.bin").count().collect()
    for row in rows:  # at most BINS per band
        counts.setdefault(row["band"], {})[row["bin"]] = row["count"]
    least = {}
    for band, bins in counts.items():
        total, below = sum(bins.values()), 0
        for place in sorted(bins, reverse=True):
            below += bins[place]
            if 10 ** (-place / 10) <= RATE * below / total:
                least[band] = place
    return least


def _scanned(docs: DataFrame, names: list[str]) -> DataFrame:
    """The ``names`` columns with ``base`` and ``tested`` spans, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = _let(base_spans(text), lambda base: F.struct(base.alias("base"), _tested(text, base).alias("tested")))
    found = docs.withColumn("found", both)
    return kept(found.select(*names, "found.base", "found.tested"), "secret-scan")


def _all_spans(scanned: DataFrame) -> Column:
    """Base and random spans in order."""
    limits = _not_random_from(scanned)
    kept_tokens = F.filter("tested", lambda t: _is_random(t, limits))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return F.array_sort(F.concat(F.transform("base", plain), F.transform(kept_tokens, plain)))


def _is_random(tested: Column, limits: dict[int, int]) -> Column:
    verdict = F.lit(True)
    for band, place in limits.items():
        verdict = F.when(tested["band"] == band, tested["bin"] < place).otherwise(verdict)
    return verdict


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    scanned = _scanned(narrow, ["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(_all_spans(scanned)).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``MASK``; n_chars,
    where there is such a column, becomes the new length of a changed text."""
    names = docs.columns
    inner = [f"column_{i}" for i in range(len(names))]
    at = next(i for i, n in enumerate(names) if n.lower() == "text")
    numbered = docs.toDF(*inner).withColumn("text", F.col(inner[at]))
    scanned = _scanned(numbered, inner)
    text = F.col(inner[at])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substr(text, (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int"))
        new = span["start"] >= s["at"]
        begins = F.when(new, F.concat(s["out"], gap, F.lit(MASK))).otherwise(s["out"])
        # a touching or overlapping span lengthens the one before it
        joined = (span["start"] == s["at"]) & (s["at"] > 0) & s["out"].endswith(MASK)
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(joined, s["out"]).otherwise(begins).alias("out"))

    def rest(s: Column) -> Column:
        return F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int")))

    spans = _all_spans(scanned)
    clean = F.aggregate("spans", start, step, rest)
    changed = F.size("spans") > 0
    out = scanned.withColumn("spans", spans).withColumn("new", F.when(changed, clean).otherwise(text))
    columns = []
    for name, column in zip(names, inner):
        value = F.col(column)
        if column == inner[at]:
            value = F.col("new")
        elif name.lower() == "n_chars":
            value = F.when(changed, F.length("new").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return out.select(*columns)
