"""Interval and event analytics on Spark."""
