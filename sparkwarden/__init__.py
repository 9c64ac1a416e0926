"""Security analytics over cloud audit logs, written as Spark DataFrame jobs."""

from sparkwarden.session import build_session, configure

__all__ = ["build_session", "configure"]
