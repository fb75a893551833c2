"""All bound queries of the engine."""

from __future__ import annotations

from placeloom.plans import entity_queries, more_queries, pipeline_queries, registry, relational_queries, text_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
