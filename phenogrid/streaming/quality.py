"""An extension beyond batch: object tables that arrive while a screen is imaged, as a stream.

The same column rules as in batch. Late fields are accepted for `delay`; then a window's wells are final.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import expr as X


def running_counts(stream: DataFrame, by: Sequence[str], feats: Sequence[str], ts: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window, by, n, and each feature's mean, for append mode."""
    rows = X.ingest(stream, feats).withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in feats])
