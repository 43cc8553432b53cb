"""Reshaping of metric frames for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "—"


def unpivot_measures(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, str] | list[str],
    name: str = "series",
    value: str = "value",
) -> DataFrame:
    """Wide to long; ``measures`` may map a column to the label it gets."""
    labels = measures if isinstance(measures, dict) else {m: m for m in measures}
    numbers = [F.col(m).cast("double").alias(label) for m, label in labels.items()]
    return df.select(*keys, *numbers).unpivot(keys, list(labels.values()), name, value)


def series_order(df: DataFrame, series: str, order: list[str], alias: str = "series_order") -> DataFrame:
    """Stacking rank of each series; a series that is not listed comes last."""
    rank: Column | None = None
    for position, label in enumerate(order, start=1):
        test = F.col(series) == label
        rank = F.when(test, position) if rank is None else rank.when(test, position)
    last = F.lit(len(order) + 1)
    return df.withColumn(alias, last if rank is None else rank.otherwise(last))


def share_of_bucket(df: DataFrame, bucket: str, measure: str, alias: str = "share") -> DataFrame:
    """Each row's part of its bucket's total; NULL where the total is 0."""
    total = F.sum(measure).over(Window.partitionBy(bucket))
    return df.withColumn(alias, F.col(measure) / F.nullif(total, F.lit(0)))


def total_by_type(df: DataFrame, kind: str, measure: str) -> DataFrame:
    return df.groupBy(kind).agg(F.sum(measure).alias(measure))


def latest_bucket_share(df: DataFrame, bucket: str, kind: str, measure: str) -> DataFrame:
    """Sum per type in the newest bucket."""
    sums = df.groupBy(bucket, kind).agg(F.sum(measure).alias(measure))
    newest = F.max(bucket).over(Window.partitionBy())  # over one row per bucket and type
    latest = sums.withColumn("_newest", newest).where(F.col(bucket) == F.col("_newest"))
    return latest.select(kind, measure)


def sum_by_bucket_series(df: DataFrame, bucket: str, series: str, value: str) -> DataFrame:
    return df.groupBy(bucket, series).agg(F.sum(value).alias(value))


def split_types(df: DataFrame, kind: str, label: str) -> DataFrame:
    """The rows of one series of a long frame."""
    return df.where(F.col(kind) == label)


def coerce_types(
    df: DataFrame, numbers: tuple[str, ...] = (), timestamps: tuple[str, ...] = ()
) -> DataFrame:
    """Text to numbers and timestamps; what does not parse becomes NULL."""
    changes = {c: F.col(c).try_cast("double") for c in numbers}
    changes |= {c: F.col(c).try_cast("timestamp_ntz") for c in timestamps}
    return df.withColumns(changes)


def drop_null_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def sort_by_time(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(column)


def kpi_format(value: str | Column, digits: int = 0) -> Column:
    """Number with thousands separators and fixed digits; a dash if there is none."""
    value = F.col(value) if isinstance(value, str) else value
    number = value.try_cast("double")
    shown = F.when(~F.isnan(number), F.format_number(number, digits))
    return F.coalesce(shown, F.lit(MISSING))


def normalise_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Upper-case column names, then apply ``renames``."""
    upper = df.toDF(*[c.upper() for c in df.columns])
    return upper.withColumnsRenamed(renames or {})
