"""The five-class gate: thresholds by strictness, firings, hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals

#: Threshold at strictness 0 and at 100, and whether the class counts as nsfw.
THRESHOLDS = {
    "drawings": (0.50, 0.50, False),
    "hentai": (1.00, 0.50, True),
    "neutral": (0.30, 1.00, False),
    "porn": (0.75, 0.10, True),
    "sexy": (0.90, 0.10, True),
}
LEAD_MS, LINGER_MS = 500, 1500


def threshold(name: str, strictness: Column) -> Column:
    """t0 + (t100 - t0) * clamp(s, 0, 100) / 100 in 32-bit floats; the quotient is cast back, as FLOAT / FLOAT is DOUBLE."""
    low, high, _ = THRESHOLDS[name]
    low, high = F.lit(low).cast("float"), F.lit(high).cast("float")
    s = F.greatest(F.lit(0), F.least(F.lit(100), strictness)).cast("float")
    return (low + ((high - low) * s / F.lit(100.0).cast("float")).cast("float")).cast("float")


def fires(strictness: Column) -> Column:
    """The best nsfw margin is not negative and beats the best sfw margin."""
    margin = {n: (F.col(n) - threshold(n, strictness)).cast("float") for n in THRESHOLDS}
    bad = F.greatest(*[m for n, m in margin.items() if THRESHOLDS[n][2]])
    good = F.greatest(*[m for n, m in margin.items() if not THRESHOLDS[n][2]])
    return (bad >= 0) & (bad > good)


def firings(scores: DataFrame, strictness: int = 40) -> DataFrame:
    return scores.where(fires(F.lit(strictness)))


def hysteresis(fired: DataFrame, durations: DataFrame, by: str = "video_id") -> DataFrame:
    """Merged ``s, e``: each firing covers [t - 500, t + 1500] inside [0, duration]; touching ones join."""
    spans = fired.join(durations, by)
    spans = spans.select(by, F.greatest(F.lit(0), F.col("pts_ms") - LEAD_MS).alias("s"), F.least(F.col("duration_ms"), F.col("pts_ms") + LINGER_MS).alias("e"))
    return intervals.merge(spans, 1, [by])
