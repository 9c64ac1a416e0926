"""The log sources as a table of plain values, one entry per source.

Adding a source is adding an entry: what data sets may declare for it, and the two
DataFrame functions that read it. ``parse`` maps file contents to records,
``normalize`` maps records to event columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.sources.aws import normalize_cloudtrail
from sparkwarden.sources.azure import normalize_azure_activity
from sparkwarden.sources.entra import normalize_entra_audit, normalize_entra_signin
from sparkwarden.sources.gcp import normalize_gcp_audit
from sparkwarden.sources.records import parse_documents


class LogSource(NamedTuple):
    provider: str
    source: str
    formats: tuple[str, ...]
    scope_types: tuple[str, ...]
    tenant_allowed: bool
    record_is_identity: bool  # the record alone, without its scope, names the event
    normalize: Callable[..., DataFrame]
    parse: Callable[[DataFrame], DataFrame] = parse_documents


Sources = Sequence[LogSource]

# Names of providers, sources, formats and scope types.
SOURCES: Sources = (
    LogSource(
        "aws", "aws.cloudtrail", ("cloudtrail-json", "jsonl"), ("aws.account",),
        False, True, normalize_cloudtrail,
    ),
    LogSource(
        "azure", "azure.activity", ("azure-activity-rest-json",),
        ("azure.subscription", "azure.tenant"), True, False, normalize_azure_activity,
    ),
    LogSource(
        "azure", "azure.entra.signin", ("graph-signin-json",), ("azure.tenant",),
        True, False, normalize_entra_signin,
    ),
    LogSource(
        "azure", "azure.entra.audit", ("graph-directory-audit-json",), ("azure.tenant",),
        True, False, normalize_entra_audit,
    ),
    LogSource(
        "gcp", "gcp.audit", ("gcp-audit-json",), ("gcp.project", "gcp.organization", "gcp.folder"),
        False, False, normalize_gcp_audit,
    ),
)


def faults(sources: Sources) -> list[str]:
    """What is wrong with a table of sources; empty when it can be used."""
    names = [entry.source for entry in sources]
    out = [f"{name}: listed {names.count(name)} times" for name in sorted(set(names)) if names.count(name) > 1]
    out += [f"{entry.source}: no format" for entry in sources if not all(entry.formats) or not entry.formats]
    return out


def source_of(sources: Sources, provider: str, source: str) -> LogSource:
    """The entry for a provider's source, from a table without faults."""
    problems = faults(sources)
    found = [entry for entry in sources if (entry.provider, entry.source) == (provider, source)]
    if problems or not found:
        raise ValueError("; ".join(problems) or f"no source {source} of provider {provider}")
    return found[0]


def format_table(spark: SparkSession, sources: Sources = SOURCES) -> DataFrame:
    """One row per source and format; a handful of rows."""
    return spark.createDataFrame(
        [
            (e.provider, e.source, name, list(e.scope_types), e.tenant_allowed, e.record_is_identity)
            for e in sources
            for name in e.formats
        ],
        "provider string, source string, format string, scope_types array<string>, "
        "tenant_allowed boolean, record_is_identity boolean",
    )
