"""All queries of the engine itself."""

from __future__ import annotations

from helixgrid.plans import alignment_queries, read_queries, region_queries, rna_queries  # noqa: F401  they register their queries
from helixgrid.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
