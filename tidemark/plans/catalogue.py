"""All queries of the engine."""

from __future__ import annotations

from tidemark.plans import archive_queries, audit_queries, factor_queries, registered_queries, registry, study_queries, trust_queries  # noqa: F401
from tidemark.plans.registry import flagship, oracle_sql, queries  # noqa: F401
