"""Parsing of landed price and locked-value documents.

Days are computed from epoch numbers by integer arithmetic, so the session time
zone cannot move a point to another day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.functions.scalars import epoch_millis_to_date, epoch_seconds_to_date
from tallychain.sources.schemas import MARKET_PAYLOAD, TVL_PAYLOAD
from tallychain.sources.split_json import LISTS, OBJECTS, array_items

MARKET_SERIES = ("prices", "market_caps", "total_volumes")


def _parse(payloads: DataFrame, schema: str) -> DataFrame:
    # A document that does not parse is an error, not a silent gap in the series.
    return payloads.select(F.from_json("payload", schema, {"mode": "FAILFAST"}).alias("doc"))


def market_series(payloads: DataFrame) -> DataFrame:
    """All points in long form: ``series, date, value``."""
    doc = _parse(payloads, MARKET_PAYLOAD)
    tagged = F.array(
        *[
            F.struct(F.lit(name).alias("series"), F.col(f"doc.data.{name}").alias("points"))
            for name in MARKET_SERIES
        ]
    )
    return (
        doc.select(F.inline(tagged))
        .select("series", F.explode("points").alias("point"))
        .select(
            "series",
            epoch_millis_to_date(F.get("point", 0)).alias("date"),
            F.get("point", 1).alias("value"),
        )
    )


def split_market_series(spark: SparkSession, path: str) -> DataFrame:
    """`market_series` of the files below ``path``, each read by as many tasks as it has splits."""
    items = array_items(spark, path, LISTS).where(F.col("name").isin(*MARKET_SERIES))
    point = F.from_json("item", "array<double>", {"mode": "FAILFAST"})
    return items.select(F.col("name").alias("series"), point.alias("point")).select(
        "series",
        epoch_millis_to_date(F.get("point", 0)).alias("date"),
        F.get("point", 1).alias("value"),
    )


def market_daily(payloads: DataFrame) -> DataFrame:
    """`daily_points` of whole documents."""
    return daily_points(market_series(payloads))


def daily_points(series: DataFrame) -> DataFrame:
    """One row per day that has a point in all three series.

    Columns ``date, price, market_cap, volume`` (the highest point of the day) and
    ``total_supply``, the highest ``market_cap / price`` over every pairing of the
    day's points.  Overlapping documents repeat days many times, so the pairs are
    never formed: a quotient is highest at the ends of its numerator's range and at
    the ends of the positive or of the negative denominators, and those ends are
    plain aggregates.
    """
    value = F.col("value")
    price = F.when(F.col("series") == "prices", value)
    cap = F.when(F.col("series") == "market_caps", value)
    volume = F.when(F.col("series") == "total_volumes", value)
    per_day = (
        series.groupBy("date")
        .agg(
            F.max(price).alias("price"),
            F.max(cap).alias("market_cap"),
            F.max(volume).alias("volume"),
            F.min(cap).alias("cap_min"),
            F.min(F.when(price > 0, price)).alias("pos_min"),
            F.max(F.when(price > 0, price)).alias("pos_max"),
            F.min(F.when(price < 0, price)).alias("neg_min"),
            F.max(F.when(price < 0, price)).alias("neg_max"),
            *[F.bool_or(F.col("series") == name).alias(f"has_{name}") for name in MARKET_SERIES],
        )
        .where(F.col("has_prices") & F.col("has_market_caps") & F.col("has_total_volumes"))
    )
    candidates = [
        F.col("market_cap") / F.col("pos_min"),
        F.col("market_cap") / F.col("pos_max"),
        F.col("cap_min") / F.col("neg_min"),
        F.col("cap_min") / F.col("neg_max"),
    ]
    return per_day.select(
        "date", "price", "market_cap", "volume", F.greatest(*candidates).alias("total_supply")
    )


def market_points(payloads: DataFrame) -> DataFrame:
    """``date, price, market_cap, volume`` of the days present in all three series."""
    return market_daily(payloads).select("date", "price", "market_cap", "volume")


def tvl_points(payloads: DataFrame) -> DataFrame:
    """``date, protocol_locked``; a day reported more than once keeps its highest value."""
    return highest_locked(tvl_values(payloads))


def tvl_values(payloads: DataFrame) -> DataFrame:
    """``date`` (epoch seconds) and ``tvl`` of all points."""
    return _parse(payloads, TVL_PAYLOAD).select(F.inline("doc.data"))


def split_tvl_values(spark: SparkSession, path: str) -> DataFrame:
    """`tvl_values` of the files below ``path``, each read by as many tasks as it has splits."""
    items = array_items(spark, path, OBJECTS).where(F.col("name") == "data")
    point = F.from_json("item", "date bigint, tvl double", {"mode": "FAILFAST"})
    return items.select(point.alias("point")).select("point.*")


def highest_locked(values: DataFrame) -> DataFrame:
    return (
        values.groupBy(epoch_seconds_to_date(F.col("date")).alias("date"))
        .agg(F.max("tvl").alias("protocol_locked"))
    )
