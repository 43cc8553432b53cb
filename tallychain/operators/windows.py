"""Window operators over bucket rows.

They order one row per bucket (hours, days, weeks or months of a period), never raw
rows, so the single-partition window without a ``by`` stays small at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tallychain.constants import ROLLING_ROWS


def ordered(order: str | Column, by: tuple[str, ...] = ()) -> WindowSpec:
    order = F.col(order) if isinstance(order, str) else order
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def prev(value: str | Column, order: str | Column, by: tuple[str, ...] = (), rows: int = 1) -> Column:
    """Value ``rows`` rows back."""
    return F.lag(value, rows).over(ordered(order, by))


def cumulative(value: str | Column, order: str | Column, by: tuple[str, ...] = ()) -> Column:
    """Running sum; rows with an equal order value share one total."""
    return F.sum(value).over(ordered(order, by))


def rolling_mean(
    value: str | Column, order: str | Column, by: tuple[str, ...] = (), rows: int = ROLLING_ROWS
) -> Column:
    """Mean of the last ``rows`` rows that exist (gaps in time are not filled)."""
    frame = ordered(order, by).rowsBetween(1 - rows, 0)
    return F.sum(value).over(frame).cast("double") / F.nullif(F.count(value).over(frame), F.lit(0))


def pct_change(value: Column, previous: Column) -> Column:
    """Change in percent; NULL without a previous value or with a previous 0."""
    return (value - previous) / F.nullif(previous, F.lit(0)) * 100


def ma_pct_change(
    value: str | Column, order: str | Column, rows: int = 28, lag: int = 14
) -> tuple[Column, Column, Column]:
    """Moving mean, the mean ``lag`` rows earlier, and the change in percent.

    The lagged mean is the mean of the same frame shifted by ``lag``, so all three
    come from one pass over one window order.
    """
    mean = rolling_mean(value, order, rows=rows)
    frame = ordered(order).rowsBetween(1 - rows - lag, -lag)
    count = F.count(value).over(frame)
    lagged = F.sum(value).over(frame).cast("double") / F.nullif(count, F.lit(0))
    return mean, lagged, pct_change(mean, lagged)
