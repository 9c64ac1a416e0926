"""Rules as data: what to select, what to correlate, what counts as evidence.

A rule is a small declaration that the operators turn into one DataFrame plan.
Its definition hash is part of every finding id, so a changed rule gives new
finding ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.instants import NANOS_PER_SECOND
from sparkwarden.operators.arrays import Elements
from sparkwarden.operators.sequence import absent_between, sequence_pairs

HALF_HOUR = 1800


@dataclass(frozen=True)
class Evidence:
    """Which match columns hold the supporting event uids, in order.

    Either ``columns`` (with the columns of their source ids, where the match
    carries them) or one ``list_column``."""

    columns: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    list_column: str | None = None

    def __post_init__(self):
        if bool(self.columns) == bool(self.list_column):
            raise ValueError("evidence names either columns or a list column")
        if len(set(self.columns)) != len(self.columns) or not all(self.columns):
            raise ValueError("evidence columns must be distinct names")
        if self.source_ids and len(self.source_ids) != len(self.columns):
            raise ValueError("evidence source ids must pair with its columns")


@dataclass(frozen=True)
class Step:
    """Events of one kind: a predicate, array members, and the columns to carry."""

    where: str
    carry: tuple[str, ...]
    elements: tuple[Elements, ...] = ()

    def rows(self, events: DataFrame) -> DataFrame:
        out = events.where(self.where)
        for step in self.elements:
            out = step.apply(out)
        return out.selectExpr(*self.carry)


@dataclass(frozen=True)
class Sequence:
    """``first`` then ``second`` with equal keys, within a number of seconds, unless
    a ``blocker`` lies strictly between."""

    first: Step
    second: Step
    keys: tuple[str, ...]
    output: tuple[str, ...]
    within_seconds: int = HALF_HOUR
    blocker: Step | None = None
    blocker_keys: tuple[tuple[str, str], ...] = ()
    distinct: bool = False

    def matches(self, events: DataFrame) -> DataFrame:
        window = self.within_seconds * NANOS_PER_SECOND
        pairs = sequence_pairs(
            self.first.rows(events), self.second.rows(events), self.keys, window
        )
        if self.blocker is not None:
            pairs = absent_between(
                pairs,
                self.blocker.rows(events),
                dict(self.blocker_keys),
                window,
                start="first_event_ns",
                end="second_event_ns",
            )
        out = pairs.selectExpr(*self.output)
        return out.distinct() if self.distinct else out


@dataclass(frozen=True)
class Single:
    """One event, or one member of its arrays, is a match by itself."""

    step: Step

    def matches(self, events: DataFrame) -> DataFrame:
        return self.step.rows(events)


@dataclass(frozen=True)
class Query:
    """A rule written as Spark SQL over ``{events}``."""

    sql: str

    def matches(self, events: DataFrame) -> DataFrame:
        return events.sparkSession.sql(self.sql, events=events)


@dataclass(frozen=True)
class Custom:
    """A rule as a function; ``version_text`` must change with its meaning."""

    function: Callable[[DataFrame], DataFrame]
    version_text: str

    def matches(self, events: DataFrame) -> DataFrame:
        return self.function(events)


Body = Sequence | Single | Query | Custom


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: str
    provider: str
    source: str
    title: str
    severity: str
    attack: tuple[str, ...]
    observed: str
    inferred: str
    cannot_establish: tuple[str, ...]
    evidence: Evidence
    body: Body
    notes: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("rule_id", "version", "provider", "source", "title", "severity"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value:
                raise ValueError(f"rule {self.rule_id!r} needs {name}")

    @property
    def definition_sha256(self) -> str:
        if isinstance(self.body, Custom):
            text = self.body.version_text
        elif isinstance(self.body, Query):
            text = self.body.sql
        else:
            text = json.dumps(asdict(self.body), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    def scoped(self, events: DataFrame) -> DataFrame:
        """Every read of the rule, blockers included, sees one source only."""
        return events.where((F.col("provider") == self.provider) & (F.col("source") == self.source))

    def matches(self, events: DataFrame) -> DataFrame:
        return self.body.matches(self.scoped(events))


class RuleBook:
    """Rules by revision. A revision is a list of layers; a later layer replaces
    single fields of a rule of an earlier one."""

    def __init__(self, revisions: dict[str, dict[str, Rule]]):
        if not revisions:
            raise ValueError("a rule book needs at least one revision")
        for rules in revisions.values():
            for rule_id, rule in rules.items():
                if rule_id != rule.rule_id:
                    raise ValueError(f"rule {rule.rule_id} is filed under {rule_id}")
        self._revisions = {name: dict(rules) for name, rules in revisions.items()}

    @classmethod
    def layered(cls, layers: dict[str, list[dict[str, dict]]]) -> RuleBook:
        book = {}
        for revision, parts in layers.items():
            merged: dict[str, dict] = {}
            for part in parts:
                for rule_id, fields in part.items():
                    merged.setdefault(rule_id, {"rule_id": rule_id}).update(fields)
            book[revision] = {rule_id: Rule(**fields) for rule_id, fields in merged.items()}
        return cls(book)

    def revisions(self) -> tuple[str, ...]:
        return tuple(self._revisions)

    def rules(self, revision: str) -> dict[str, Rule]:
        if revision not in self._revisions:
            raise ValueError(f"unknown rule revision {revision}")
        return dict(self._revisions[revision])

    def for_source(self, provider: str, source: str) -> RuleBook:
        return RuleBook(
            {
                name: {
                    k: r for k, r in rules.items() if (r.provider, r.source) == (provider, source)
                }
                for name, rules in self._revisions.items()
            }
        )
