"""Unnesting JSON arrays, with the predicate kept on one element.

Filter *after* unnesting: conditions on different elements of one array must not
combine into a match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_json(
    df: DataFrame, document: Column | str, value: str, key: str | None = None
) -> DataFrame:
    """One row per member of a VARIANT array or object, none for anything else.

    ``key`` is the member name, or the array index as text (so '10' < '2')."""
    if isinstance(document, str):
        document = F.expr(document)
    spark = df.sparkSession
    members = spark.tvf.variant_explode(document.outer())
    rows = df.lateralJoin(members)
    index = F.coalesce(F.col("key"), F.col("pos").cast("string"))
    columns = [df[c] for c in df.columns] + [F.col("value").alias(value)]
    return rows.select(*columns, *([index.alias(key)] if key else []))


@dataclass(frozen=True)
class Elements:
    """An unnesting step of a rule, as SQL expressions.

    ``array`` is a VARIANT (or, with ``native``, an ARRAY) expression over the
    row; ``where`` then sees the element under ``value``."""

    array: str
    value: str
    key: str | None = None
    where: str | None = None
    native: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.native:
            out = df.select("*", F.explode(F.expr(self.array)).alias(self.value))
        else:
            out = explode_json(df, self.array, self.value, self.key)
        return out.where(self.where) if self.where else out
