"""Repair of conversation structure by the cheapest edits (``coalescence``).

Rows of a conversation go by turn, nulls first; rows of one turn by role, then by the MD5 of
role and text. A row's first fault counts: blank (no character but ASCII blanks), duplicate
(role and text seen earlier in the conversation), truncated (the last such character is
none of ``.!?``). Blank and duplicate rows must be deleted; other rows may be kept, given
another role or deleted, and empty user or assistant rows inserted, so that the initials of
the roles read ``(s?(ua)+)?`` at the least cost, ties to the least audit string.

Which role and text was seen in an earlier turn is found on keys alone: minima per
conversation and digest combine before their shuffle, and only repeats over several turns
are joined back, as marker rows that sort just before the rows they mark. So a task keeps no
set of what it has seen. Texts are shuffled once, to their conversation, sorted there, and
streamed: a task holds a batch, and the edits that are still open. A conversation of any
length is thus streamed by one task in bounded memory, because the digest of its repaired
rows is one SHA-256 over its text in order and can be computed by no more than one; all work
on single rows is done before the shuffle, by many.

Given results: null conv_id, turn, role and text are one space where text is made of them
(hash, role, text); rows with a null conv_id are one conversation; repeated rows are
duplicates; a conversation whose rows are all dropped gives zeros, an empty audit and the
digest of nothing; an empty table gives no rows; roles are judged by their first character;
extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.coalescence import NOTHING, Survivors, replayed

BLANKS = " \t\n\x0b\x0c\r"
ENDS = tuple(".!?")
MARKER, ROW, DROPPED = 0, 1, 2
DROP, EMPTY, UNMARK, REPEAT, AS_USER = range(5)
PARTS = 20
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and kind after the damage that the CRC-32 of
    ``conv_id:turn`` modulo 20 chooses; a dropped row stays as a mark of its conversation."""
    blank = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in ("text", "role"))
    lot = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        role.alias("role"),
        text.alias("text"),
        F.pmod(F.crc32(name.cast("binary")), F.lit(PARTS)).alias("lot"),
    )
    dropped = F.col("lot") == DROP
    copies = F.when(F.col("lot") == REPEAT, F.array(F.lit(ROW), F.lit(ROW)))
    kinds = copies.when(dropped, F.array(F.lit(DROPPED))).otherwise(F.array(F.lit(ROW)))
    new_text = (
        F.when(dropped | (F.col("lot") == EMPTY), "")
        .when(F.col("lot") == UNMARK, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    new_role = F.when(F.col("lot") == AS_USER, "user").otherwise(F.col("role"))
    return lot.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), F.explode(kinds).alias("kind"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for rows as they are; nulls become one space as well."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text, F.lit(ROW).alias("kind"))


def streamed(rows: DataFrame) -> DataFrame:
    """``rows`` and the markers of repeats, each conversation sorted in one partition."""
    digest = F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary"))
    whole = rows.withColumn("digest", F.when(F.col("kind") == ROW, digest))
    keys = whole.where(F.col("kind") == ROW).select("conv_id", "turn", "role", "digest")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    spread = keys.groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.max(when).alias("last"))
    spread = spread.where("first < last").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    again = keys.join(spread, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    again = again.where(when > F.col("first")).select("conv_id", "turn", "role", F.lit("").alias("text"), "digest")
    marked = whole.unionByName(again.withColumn("kind", F.lit(MARKER)))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "kind"]
    return marked.repartition("conv_id").sortWithinPartitions(*order)


class _Conversation:
    """Counts, and the survivors of the rows so far."""

    def __init__(self, conv_id: int | None, whole: bool) -> None:
        self.conv_id, self.survivors = conv_id, Survivors(digest=not whole)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = None  # known turns come in order
        self.initial: str | None = None
        self.seen = self.place = None  # digest and place of a row known to be a repeat
        self.open: deque | None = deque() if whole else None
        self.state, self.number = NOTHING, 0

    def add(self, turn: int | None, role: str, text: str, digest: str, kind: int) -> None:
        if kind == DROPPED:
            return
        repeat = self.seen == digest and self.place == turn
        self.seen, self.place = digest, turn
        if kind == MARKER:
            return
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        end = text.rstrip(BLANKS)
        repeat = bool(end) and repeat
        cut = bool(end) and not repeat and not end.endswith(ENDS)
        self.blank += not end
        self.duplicate += repeat
        self.truncated += cut
        if self.open is not None:
            self.open.append((role, text))
        self.survivors.step(role, text, not end or repeat, cut)

    def repaired(self) -> Iterator[tuple]:
        """The rows that became final since the last call."""
        edits = self.survivors.taken()
        rows = iter(self.open.popleft, None)
        for self.state, role, text in replayed(self.state, edits, rows):
            yield self.conv_id, self.number, role, text
            self.number += 1

    def summary(self) -> tuple:
        cost, digest = self.survivors.close()
        gaps = 0 if self.turn is None else self.turn - self.least + 1 - self.turns
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, gaps, *faults, cost, self.survivors.taken(), digest)


SUMMARY = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [(c, pa.string()) for c in ("audit", "repaired_sha256")]
)
MESSAGE = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _conversations(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    schema = MESSAGE if whole else SUMMARY
    now: _Conversation | None = None
    for batch in bounded(batches):
        out: list[tuple] = []
        names = ("conv_id", "turn", "role", "text", "digest", "kind")
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out += _ended(now, whole)
                now = _Conversation(conv_id, whole)
            now.add(*row)
        if whole:
            out += now.repaired()
        yield _batch(out, schema)
    if now is not None:
        yield _batch(_ended(now, whole), schema)


def _ended(conversation: _Conversation, whole: bool) -> list[tuple]:
    if not whole:
        return [conversation.summary()]
    conversation.survivors.close()
    return list(conversation.repaired())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, counts of faults, cost, audit and the SHA-256 of the
    repaired ``role:text`` lines. ``rows`` come from ``damaged`` or ``undamaged``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _conversations(batches, whole=False)

    counts = ", ".join(f"{c} long" for c in SUMMARY.names[1:7])
    return streamed(rows).mapInArrow(summed, f"conv_id long, {counts}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role and text. A task
    hands rows on as soon as their edits are final."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _conversations(batches, whole=True)

    return streamed(rows).mapInArrow(listed, "conv_id long, place long, role string, text string")
