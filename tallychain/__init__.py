"""Growth metrics of a two-environment blockchain, computed with Spark DataFrames."""

from tallychain.period import PERIOD_KEYS, Period
from tallychain.sources.tables import ParquetSources, Sources

__all__ = ["PERIOD_KEYS", "ParquetSources", "Period", "Sources"]
