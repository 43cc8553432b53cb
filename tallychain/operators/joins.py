"""Joins of small result frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_outer_fill(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key`` (coalesced) with 0 for the counts of a missing side."""
    counts = [c for c in (*left.columns, *right.columns) if c != key]
    return left.join(right, on=key, how="full").fillna(0, subset=counts)


def join_aligned(*series: DataFrame, key: str = "date") -> DataFrame:
    """Inner join of series that share their key: only keys in all of them stay."""
    return reduce(lambda a, b: a.join(b, on=key, how="inner"), series)


def combine_one_row(*frames: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames.

    The rows are stacked and folded by an aggregate, so no cross join is planned.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
