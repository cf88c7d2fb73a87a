"""Seeded pseudo-random order that does not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_key(seed: int, *columns: Column | str) -> Column:
    """``md5(seed|c1|c2…)``: a uniform hex string; sorting by it shuffles the rows."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
