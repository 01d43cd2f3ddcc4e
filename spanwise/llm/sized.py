"""Broadcast only what is measured to be small; anything larger is joined by shuffling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BYTES = 48


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as JSON and a fixed share for each: about what a broadcast takes. Measure a written table, not a plan."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES)).first()[0] or 0


def maybe_broadcast(df: DataFrame, most_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most_bytes``."""
    return F.broadcast(df) if measured_bytes(df) <= most_bytes else df
