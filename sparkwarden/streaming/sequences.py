"""Ordered correlation on streams: repeated deliveries, pairs, absence, first use.

Rows may come in any order as long as none is later than the delay of the watermark on
``event_time`` (a timestamp); what is later is dropped, and state older than it is freed.
Exact bounds are compared in ``event_ns``. NULL keys and NULL times never match.

What must wait for rows that may still come (absence, counts of a first use) is kept by key
*and* time bucket as wide as the window, as in the batch operators: a hot key's state is
spread over its buckets, every bucket has one timer, and when the watermark passes the
bucket's last possible row its result is emitted and its state is gone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from sparkwarden.functions.instants import NANOS_PER_SECOND
from sparkwarden.operators.sequence import TIME, time_bucket

STAMP = "event_time"
NANOS_PER_MILLI = 1_000_000

Close = Callable[[list[Row], Iterator[Row]], Iterable[Row]]


def first_deliveries_within(rows: DataFrame, uid: Sequence[str], delay: str) -> DataFrame:
    """The first delivery of every event; repeats come within ``delay`` of event time."""
    return rows.withWatermark(STAMP, delay).dropDuplicatesWithinWatermark(list(uid))


def _seconds(ns: int) -> Column:
    """An interval that is at least ``ns`` long."""
    return F.expr(f"INTERVAL '{-(-ns // NANOS_PER_SECOND) + 1}' SECOND")


def stream_pairs(
    first: DataFrame,
    second: DataFrame,
    keys: Sequence[str],
    within_ns: int,
    *,
    include_start: bool = False,
    prefixes: tuple[str, str] = ("first_", "second_"),
) -> DataFrame:
    """As ``sequence_pairs``: equal keys and ``first < second <= first + within``, with
    ``include_start`` the lower bound too. Both sides carry a watermark; a row is kept until
    no partner of it can come any more."""
    a, b = prefixes
    left = first.where(F.col(TIME).isNotNull()).select(
        *[F.col(k) for k in keys], *[F.col(c).alias(a + c) for c in first.columns if c not in keys]
    )
    right = second.where(F.col(TIME).isNotNull()).select(
        *[F.col(k).alias(f"other_{k}") for k in keys],
        *[F.col(c).alias(b + c) for c in second.columns if c not in keys],
    )
    start, end = F.col(a + TIME), F.col(b + TIME)
    bounds = (end >= start if include_start else end > start) & (end <= start + F.lit(within_ns))
    # The same bounds on the watermarked columns, a little wider, let Spark free its state.
    slack = F.expr("INTERVAL '1' SECOND")
    state = (F.col(b + STAMP) >= F.col(a + STAMP) - slack) & (F.col(b + STAMP) <= F.col(a + STAMP) + _seconds(within_ns))
    same = F.lit(True)
    for k in keys:
        same = (F.col(k) == F.col(f"other_{k}")) if k == keys[0] else same & (F.col(k) == F.col(f"other_{k}"))
    pairs = left.join(right, same & state & bounds).drop(*[f"other_{k}" for k in keys])
    # Operators that follow take a single watermarked column: that of the first side.
    return pairs.withColumn(b + STAMP, F.timestamp_micros(F.unix_micros(b + STAMP)))


class BucketProcessor(StatefulProcessor):
    """Holds the rows of two sides of one (key, bucket) until its timer, then closes it."""

    def __init__(self, left: StructType, right: StructType, within_ns: int, close: Close):
        self.left_type, self.right_type = left, right
        self.within_ns, self.close_bucket = within_ns, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getListState("left", self.left_type)
        self.right = handle.getListState("right", self.right_type)
        self.armed = handle.getValueState("armed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        left, right = [], []
        for row in rows:
            side, rows_of, names = ("left", left, self.left_type) if row["is_left"] else ("right", right, self.right_type)
            rows_of.append(tuple(row[side][name] for name in names.names))
        if left:
            self.left.appendList(left)
        if right:
            self.right.appendList(right)
        if not self.armed.exists():
            # Left rows lie in the bucket, right ones in it or the next.
            at = ((key[-1] + 2) * self.within_ns) // NANOS_PER_MILLI + 1
            self.handle.registerTimer(at)
            self.armed.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = [Row(*self.left_type.names)(*row) for row in self.left.get()] if self.left.exists() else []
        right = (Row(*self.right_type.names)(*row) for row in (self.right.get() if self.right.exists() else ()))
        yield from self.close_bucket(left, right)
        self.left.clear()
        self.right.clear()
        self.armed.clear()

    def close(self) -> None:
        pass


def _payload(frame: DataFrame, names: Sequence[str]) -> StructType:
    return StructType([StructField(n, frame.schema[n].dataType) for n in names])


def closed_buckets(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str],
    within_ns: int,
    close: Close,
    result: StructType,
    *,
    left_time: str = TIME,
    left_stamp: str = STAMP,
) -> DataFrame:
    """``close(left rows, right rows)`` for every key and bucket of left times, when all rows
    of both sides up to the window's end have come. ``keys`` maps left to right columns; all
    other columns are handed to ``close``. Right rows are in ``event_ns``."""
    names = [f"key_{i}" for i in range(len(keys))]
    left_names = [c for c in left.columns if c != left_stamp]
    right_names = [c for c in right.columns if c != STAMP and c not in keys.values()]
    types = _payload(left, left_names), _payload(right, right_names)
    start, at = time_bucket(F.col(left_time), within_ns), time_bucket(F.col(TIME), within_ns)

    def known(columns: Iterable[str], time: str) -> Column:
        condition = F.col(time).isNotNull()
        for column in columns:
            condition = condition & F.col(column).isNotNull()
        return condition

    ours = left.where(known(keys, left_time)).select(
        *[F.col(c).alias(n) for c, n in zip(keys, names)],
        start.alias("bucket"),
        F.lit(True).alias("is_left"),
        F.struct(*left_names).alias("left"),
        F.lit(None).cast(types[1]).alias("right"),
        F.col(left_stamp).alias(STAMP),
    )
    theirs = right.where(known(keys.values(), TIME)).select(
        *[F.col(c).alias(n) for c, n in zip(keys.values(), names)],
        F.explode(F.array(at, at - 1)).alias("bucket"),
        F.lit(False).alias("is_left"),
        F.lit(None).cast(types[0]).alias("left"),
        F.struct(*right_names).alias("right"),
        STAMP,
    )
    return (
        ours.unionByName(theirs)
        .groupBy(*names, "bucket")
        .transformWithState(BucketProcessor(*types, within_ns, close), result, "Append", "EventTime")
    )


def stream_absent_between(
    pairs: DataFrame, blockers: DataFrame, keys: dict[str, str], within_ns: int, *, start: str, end: str, stamp: str
) -> DataFrame:
    """As ``absent_between``: pairs with no blocker strictly between ``start`` and ``end``.
    ``stamp`` is the watermarked column of the pairs that goes with ``start``. A pair meets
    the first blocker after its start, and no other."""

    def close(left: list[Row], right: Iterator[Row]) -> Iterator[Row]:
        times = sorted(row[TIME] for row in right)
        for pair in left:
            after = bisect_right(times, pair[start])
            if after == len(times) or times[after] >= pair[end]:
                yield pair

    # Times travel as microseconds: a Python time would depend on the worker's zone.
    times = [f.name for f in pairs.schema.fields if f.dataType.typeName() == "timestamp"]
    plain = pairs.select("*", *[F.unix_micros(c).alias(f"{c}_us") for c in times]).drop(*[c for c in times if c != stamp])
    result = _payload(plain, [c for c in plain.columns if c != stamp])
    narrow = blockers.select(*dict.fromkeys(keys.values()), TIME, STAMP)
    kept = closed_buckets(plain, narrow, keys, within_ns, close, result, left_time=start, left_stamp=stamp)
    return kept.withColumns({c: F.timestamp_micros(f"{c}_us") for c in times}).select(*pairs.columns)
