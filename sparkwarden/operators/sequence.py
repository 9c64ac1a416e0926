"""Ordered correlation of events on the nanosecond axis ``event_ns``.

Every join here is an equi join on the caller's keys *and* a time bucket as wide
as the window, with the exact bounds as a residual condition. A key that holds a
large share of all rows is so spread over its buckets and is never compared with
all of its own history; what is left in one bucket AQE's skew join can split.
NULL keys and NULL times never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIME = "event_ns"


def time_bucket(ns: Column, width_ns: int) -> Column:
    """Whole-number bucket; monotone, and at most one step per ``width_ns``."""
    return F.call_function("div", ns, F.lit(width_ns))


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in df.columns if c not in keys]


def sequence_pairs(
    first: DataFrame,
    second: DataFrame,
    keys: Sequence[str],
    within_ns: int,
    *,
    include_start: bool = False,
    prefixes: tuple[str, str] = ("first_", "second_"),
) -> DataFrame:
    """Pairs with equal keys and ``first < second <= first + within``.

    ``include_start`` closes the lower bound. The result has the keys and the
    other columns of both sides, prefixed."""
    a, b = prefixes
    slot = time_bucket(F.col(TIME), within_ns)
    left = first.where(F.col(TIME).isNotNull()).select(
        *keys,
        *_prefixed(first, a, keys),
        F.explode(F.array(slot, slot + 1)).alias("bucket_"),
    )
    right = second.where(F.col(TIME).isNotNull()).select(
        *keys, *_prefixed(second, b, keys), slot.alias("bucket_")
    )
    start, end = F.col(a + TIME), F.col(b + TIME)
    lower = end >= start if include_start else end > start
    return (
        left.join(right, [*keys, "bucket_"])
        .where(lower & (end <= start + F.lit(within_ns)))
        .drop("bucket_")
    )


def first_after(
    rows: DataFrame, blockers: DataFrame, keys: dict[str, str], within_ns: int, *, at: str, name: str
) -> DataFrame:
    """As-of join: ``rows`` with ``name``, the time of the first blocker strictly after ``at``
    with equal keys; it may be NULL where none is within ``within_ns``.

    Rows and blockers of one key and time slot are merged in order of time, latest first, and
    the least blocker so far is carried along; a slot also gets the blockers of the next one.
    So every row meets one blocker, however many there are. NULL keys and times never match;
    such rows stay, spread over their slots."""
    names = [f"key_{i}_" for i in range(len(keys))]
    ours = rows.select(
        "*",
        *[F.col(c).alias(n) for c, n in zip(keys, names)],
        time_bucket(F.col(at), within_ns).alias("slot_"),
        F.col(at).alias("at_"),
        F.lit(None).cast("long").alias("block_"),
    )
    known = F.col(TIME).isNotNull()
    for column in keys.values():
        known = known & F.col(column).isNotNull()
    slot = time_bucket(F.col(TIME), within_ns)
    times = blockers.where(known).select(
        *[F.col(c).alias(n) for c, n in zip(keys.values(), names)],
        F.explode(F.array(slot, slot - 1)).alias("slot_"),
        F.col(TIME).alias("at_"),
        F.col(TIME).alias("block_"),
        F.lit(True).alias("is_block_"),
    )
    merged = ours.unionByName(times, allowMissingColumns=True)
    # At one time rows come before blockers, so that these are not after them.
    order = Window.partitionBy(*names, "slot_").orderBy(F.desc("at_"), F.asc_nulls_first("is_block_"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn(name, F.min("block_").over(so_far)).where(F.col("is_block_").isNull())
    return found.select(*rows.columns, name)


def absent_between(
    pairs: DataFrame,
    blockers: DataFrame,
    keys: dict[str, str],
    within_ns: int,
    *,
    start: str,
    end: str,
) -> DataFrame:
    """Pairs with no blocker strictly between ``start`` and ``end``.

    ``keys`` maps pair columns to blocker columns; ``within_ns`` is the longest
    span of a pair. Each pair is compared with the first blocker after its start."""
    met = first_after(pairs, blockers, keys, within_ns, at=start, name="next_block_")
    free = F.col("next_block_").isNull() | (F.col("next_block_") >= F.col(end))
    return met.where(free).drop("next_block_")


def follow_ups(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    within_ns: int,
    *,
    uid: str = "event_uid",
) -> DataFrame:
    """Events at or after an anchor, up to and including the horizon, in long form:
    one row per (anchor, event), columns prefixed ``anchor_`` and ``use_``."""
    pairs = sequence_pairs(
        anchors, events, keys, within_ns, include_start=True, prefixes=("anchor_", "use_")
    )
    return pairs.where(F.col(f"anchor_{uid}") != F.col(f"use_{uid}"))


def per_anchor(
    anchors: DataFrame,
    uses: DataFrame,
    aggregates: dict[str, Column],
    *,
    uid: str = "event_uid",
) -> DataFrame:
    """Every anchor with aggregates over its uses; anchors without any stay.

    The uses are reduced to one row per anchor before they meet the anchors."""
    reduced = uses.groupBy(F.col(f"anchor_{uid}").alias("reduced_uid")).agg(
        *[column.alias(name) for name, column in aggregates.items()]
    )
    return anchors.join(reduced, F.col(uid) == F.col("reduced_uid"), "left").drop("reduced_uid")


def anchored_window(
    events: DataFrame,
    keys: Sequence[str],
    known: Sequence[str],
    horizon_ns: int,
    *,
    uid: str = "event_uid",
) -> DataFrame:
    """Events within a horizon of the first one of their key (inclusive).

    Events with a NULL among ``known`` stand alone, each under its own uid in
    ``unresolved_uid``. Events without a time stay. The first time is a map-side
    combined minimum that is joined back, not a window over the whole key, so a
    hot key never has to sit in one task."""
    unknown = F.lit(False)
    for column in known:
        unknown = unknown | F.col(column).isNull()
    isolated = events.withColumn("unresolved_uid", F.when(unknown, F.col(uid)))
    alone = isolated.where(unknown)
    grouped = isolated.where(~unknown)
    first = grouped.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(
        F.min(TIME).alias("window_start_ns")
    )
    condition = F.lit(True)
    for k in keys:
        same = F.col(k) == F.col(f"key_{k}") if k in known else F.col(k).eqNullSafe(F.col(f"key_{k}"))
        condition = same if k == keys[0] else condition & same
    within = F.col(TIME).isNull() | (
        F.col(TIME) <= F.col("window_start_ns") + F.lit(horizon_ns)
    )
    kept = grouped.join(first, condition).where(within)
    return kept.select(*isolated.columns).unionByName(alone)
