"""Joins whose strategy depends on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count shows at most ``max_rows`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
