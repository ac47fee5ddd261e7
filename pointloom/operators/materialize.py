"""Results that must not be computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.scratch import shared_dir


def stable(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder, which outlives executors. Where partitions decide a result (sampled ranges), two computations could differ."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
