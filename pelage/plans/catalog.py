"""All registered queries."""

from __future__ import annotations

from pelage.plans import (  # noqa: F401
    dataset_queries, embedding_queries, geometry_queries, io_queries, model_queries,
)
from pelage.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
