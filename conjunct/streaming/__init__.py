"""Incremental item supports; the study that this engine serves has no streaming operators of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_supports(item_tid: DataFrame) -> DataFrame:
    """Item supports of a stream of (tid, item): algebraic, so outputMode('complete') or ('update') keeps them right."""
    return item_tid.groupBy("item").agg(F.count(F.lit(1)).alias("support"))
