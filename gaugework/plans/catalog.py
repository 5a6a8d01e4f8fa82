"""All registered queries of the evaluation operators."""

from __future__ import annotations

from gaugework.plans import agreement_queries, decision_queries, model_queries, policy_queries, signal_queries, source_queries  # noqa: F401  they register themselves
from gaugework.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
