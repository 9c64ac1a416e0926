"""Type-strict access to JSON held as VARIANT, and its canonical text.

A bare ``variant_get(v, path, 'string')`` turns the number 1 into ``'1'``. Audit
identities must not be coerced like that, so the ``*_at`` getters look at the
stored type first. The ``loose_text`` getter keeps the coercion, for predicates
that compare the text of any scalar.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Members:
    """A VARIANT column whose ``names`` lie in columns of their own (``opened``), and so do
    members of these named ``inner``.

    Every path from the root of an object passes its members one by one; the getters below
    start at the deepest of these columns instead."""

    document: str
    names: Sequence[str]
    inner: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def whole(self) -> Column:
        return F.col(self.document)

    def _within(self, name: str) -> Members:
        return Members(f"{self.document}_{name}", self.inner.get(name, ()))

    def opened(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the members, read in one pass; NULL where absent, or in no object."""
        fields = ", ".join(f"`{name}`: variant" for name in self.names)
        members = F.try_variant_get(self.whole(), "$", f"struct<{fields}>")
        columns = [self._within(name).document for name in self.names]
        rows = rows.select("*", F.inline(F.array(members)).alias(*columns))
        for name in self.inner:
            rows = self._within(name).opened(rows)
        return rows

    def get(self, path: str, kind: str) -> Column:
        member = re.match(r"\$\.(\w+)(?=[.\[]|\Z)", path)
        if member is None or member[1] not in self.names:
            return F.try_variant_get(self.whole(), path, kind)
        return self._within(member[1]).get("$" + path[member.end() :], kind)


def get_at(document: Column | Members, path: str, kind: str) -> Column:
    """The value at ``path`` as ``kind``; NULL where it is absent or no ``kind``."""
    if isinstance(document, Members):
        return document.get(path, kind)
    return F.try_variant_get(document, path, kind)


def value_at(document: Column | Members, path: str) -> Column:
    """The JSON value at ``path`` as VARIANT; NULL where the path is absent."""
    return get_at(document, path, "variant")


def type_at(document: Column | Members, path: str) -> Column:
    return F.schema_of_variant(value_at(document, path))


def loose_text(document: Column | Members, path: str) -> Column:
    """Text of any value; JSON null and absent are NULL."""
    return get_at(document, path, "string")


def text_at(document: Column | Members, path: str) -> Column:
    """The value when it is a non-empty JSON string, else NULL."""
    text = F.when(type_at(document, path) == "STRING", loose_text(document, path))
    return F.nullif(text, F.lit(""))  # outermost, so that the text is read once


def is_object(document: Column | Members, path: str = "$") -> Column:
    """Only objects can be read as a struct; unlike a type name, this does not
    walk the whole value."""
    return get_at(document, path, "struct<_:variant>").isNotNull()


def is_array(document: Column | Members, path: str = "$") -> Column:
    return get_at(document, path, "array<variant>").isNotNull()


def is_empty_object(document: Column | Members, path: str) -> Column:
    return F.coalesce(
        F.size(F.map_keys(get_at(document, path, "map<string,variant>"))) == 0,
        F.lit(False),
    )


def object_at(document: Column | Members, path: str) -> Column:
    """The object at ``path``, or an empty object for anything else."""
    return F.when(is_object(document, path), value_at(document, path)).otherwise(
        F.parse_json(F.lit("{}"))
    )


def integer_at(document: Column | Members, path: str) -> Column:
    """The value when it is a JSON integer (not 0.0, not true, not "0")."""
    return F.when(type_at(document, path) == "BIGINT", get_at(document, path, "bigint"))


def boolean_at(document: Column | Members, path: str) -> Column:
    """The value when it is a JSON boolean (the string "false" is not one)."""
    return F.when(type_at(document, path) == "BOOLEAN", get_at(document, path, "boolean"))


def variant_object(**fields: Column) -> Column:
    """A VARIANT object with the given members; NULL members stay as JSON null."""
    return F.to_variant_object(F.struct(*[column.alias(name) for name, column in fields.items()]))


def canonical_json(document: Column) -> Column:
    """Sorted keys, no white space, non-ASCII kept as is."""
    return F.to_json(document)


def digest(content: Column) -> Column:
    """Lower-case hex SHA-256 of text or bytes."""
    return F.sha2(content, 256)
