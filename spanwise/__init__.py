"""Interval and event analytics on Spark, with operators for training-data pipelines."""

from spanwise.session import ship

__all__ = ["ship"]
