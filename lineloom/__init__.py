"""Curation, measurement and evaluation of array-column time series on Spark."""

from lineloom.session import drop_scratch, get_spark, materialize, shared_dir

__all__ = ["drop_scratch", "get_spark", "materialize", "shared_dir"]
