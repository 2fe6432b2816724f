"""callroute: routing and analysis of telephony control traffic as Spark DataFrames.

Every operator is a DataFrame -> DataFrame function built from native Spark
expressions, so the same code runs in batch jobs and inside Structured
Streaming micro-batches.
"""

from callroute.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
