"""All registered queries of this subpackage."""

from __future__ import annotations

from pelage.llm import (  # noqa: F401
    concat_queries, decontamination_queries, importance_queries, index_queries, jaccard_queries, packing_queries, pivot_queries, repeated_queries,
    resample_queries, resharding_queries, secret_queries, suffix_queries, url_queries,
)
from pelage.llm.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
