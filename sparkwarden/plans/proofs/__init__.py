"""Registered queries: every operator over whole tables, with the SQL it must equal."""

from sparkwarden.plans.proofs import cloud, generic, imports, provenance, scored, streams  # noqa: F401
from sparkwarden.plans.proofs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
