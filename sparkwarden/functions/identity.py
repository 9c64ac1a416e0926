"""Event identity: a hash of the canonical record, qualified by its scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions.json_access import canonical_json, digest

# Leading member of the scoped identity array. A deployment that already holds
# identifiers made under another tag passes that tag to keep them.
IDENTITY_TAG = "sparkwarden.event.v2"


def raw_uid(record: Column) -> Column:
    """Identity of a record that names its own account in its body."""
    return F.concat(F.lit("evt_"), digest(canonical_json(record)))


def scoped_uid(
    record: Column,
    provider: Column,
    source: Column,
    scope_type: Column,
    scope_id: Column,
    tenant_id: Column,
    tag: str = IDENTITY_TAG,
) -> Column:
    """Identity of a record within an ownership scope: the same payload in two
    scopes gives two events."""
    head = F.to_json(F.array(F.lit(tag), provider, source, scope_type, scope_id, tenant_id))
    body = F.concat(F.rtrim(head, F.lit("]")), F.lit(","), canonical_json(record), F.lit("]"))
    return F.concat(F.lit("evt_v2_"), digest(body))
