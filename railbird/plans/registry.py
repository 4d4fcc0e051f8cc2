"""All registered queries and their checking SQL."""

from __future__ import annotations

from railbird.plans import (
    derive_queries,
    flow_queries,
    hand_queries,
    people_queries,
    report_queries,
    source_queries,
    stat_queries,
    view_queries,
)

MODULES = [view_queries, report_queries, stat_queries, derive_queries, people_queries, flow_queries, hand_queries, source_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
