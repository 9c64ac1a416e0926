"""Shared pieces of the per-source normalisers.

A normaliser maps ``records`` (a VARIANT column ``record`` plus any key columns
of the caller) to event columns and ``problems``, an array of reasons for
refusing the row. Declared collection scope comes as columns
``declared_scope_type``, ``declared_scope_id`` and ``declared_tenant_id``, so
one job normalises the files of many data sets at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.instants import epoch_nanos
from sparkwarden.functions.json_access import Members, is_object
from sparkwarden.functions.network import ip_text
from sparkwarden.schema import EVENT_COLUMNS

STAMP_TEXT = "stamp_text_"
DECLARED = ("declared_scope_type", "declared_scope_id", "declared_tenant_id")


@dataclass(frozen=True)
class Scope:
    """A declared collection scope; None means not declared."""

    scope_type: str | None = None
    scope_id: str | None = None
    tenant_id: str | None = None


def with_declared_scope(records: DataFrame, scope: Scope | None) -> DataFrame:
    scope = scope or Scope()
    return records.withColumns(
        {
            "declared_scope_type": F.lit(scope.scope_type).cast("string"),
            "declared_scope_id": F.lit(scope.scope_id).cast("string"),
            "declared_tenant_id": F.lit(scope.tenant_id).cast("string"),
        }
    )


def prepared(records: DataFrame, stage: dict[str, Column], members: Members, stamp: Column) -> DataFrame:
    """Records with the declared scope present, ``members`` of the record opened, the text of
    its time as ``stamp_text_`` and staged helper columns added.

    The staged values come out of a one-row generator. Spark does not push a
    later filter on them below it, so no filter repeats the JSON extraction."""
    if "declared_scope_type" not in records.columns:
        records = with_declared_scope(records, None)
    staged = F.struct(*[column.alias(name) for name, column in stage.items()])
    first = F.struct(stamp.alias(STAMP_TEXT))  # read by several of the staged values
    return members.opened(records).select("*", F.inline(F.array(first))).select("*", F.inline(F.array(staged)))


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in pairs]))


def source_ip(address: Column) -> Column:
    return ip_text(address)


def not_an_ip(address: Column, ip: Column) -> Column:
    return address.isNotNull() & ip.isNull()


def finish(
    staged: DataFrame,
    keep: list[str],
    fields: dict[str, Column],
    problems: list[tuple[str, Column]],
) -> DataFrame:
    """Caller's key columns, then every event column (typed NULL where the source
    has no such field), then the problems."""
    fields = {
        **fields,
        "raw": F.col("record"),
        "event_ns": epoch_nanos(F.col("event_time_"), F.col("nanos_")),
        "event_time": F.col("event_time_"),
    }
    columns = [
        (fields[name] if name in fields else F.lit(None)).cast(kind).alias(name)
        if kind not in ("variant", "array<string>")
        else (fields[name] if name in fields else F.lit(None).cast(kind)).alias(name)
        for name, kind in EVENT_COLUMNS.items()
    ]
    return staged.select(
        *keep,
        *columns,
        reasons(("record_not_object", ~is_object(F.col("record"))), *problems).alias("problems"),
    )


def typed_reference(kind: str, value: Column, field: str | None = None) -> Column:
    """A ``{type, value, field}`` member for ``resources`` as VARIANT, NULL without a value."""
    members = {"type": F.lit(kind), "value": value}
    if field:
        members["field"] = F.lit(field)
    return F.when(
        value.isNotNull(),
        F.to_variant_object(F.struct(*[c.alias(n) for n, c in members.items()])),
    )


def variant_list(*members: Column) -> Column:
    """VARIANT array of the members that are not NULL."""
    return F.to_variant_object(F.array_compact(F.array(*members)))
