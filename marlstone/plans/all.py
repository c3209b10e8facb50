"""All queries of the plans."""

from __future__ import annotations

from marlstone.plans import aggregating, changing, further, joining, ordering, physical, scalars, scans, streams, summaries, texts  # noqa: F401
from marlstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
