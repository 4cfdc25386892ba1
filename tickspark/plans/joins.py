"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (a bounded job). Beyond the
    bound the frame is returned unchanged and Spark plans a shuffle join
    (AQE may still convert it at runtime from measured sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
