"""Amounts in any spelling, and the counter of those that cannot be read."""

from datetime import date
from decimal import Decimal

import pytest
from inline import InlineSources, event, fee_event, native_tx, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallychain.constants import FEE_CONTRACT, FEE_EVENT
from tallychain.functions import scalars as fn
from tallychain.functions.rejects import Rejects
from tallychain.metrics import METRICS, fees
from tallychain.period import Period
from tallychain.sources.schemas import NATIVE_AMOUNT

WEEK = Period("last_week", date(2024, 6, 13))
#: What stands behind "amount": in JSON, and its value; None where it must be refused.
SPELLINGS = {
    "1e-8": "0.00000001", '"1e-3"': "0.001", '"2.5E-2"': "0.025", "2.50E-2": "0.025",
    "1E+3": "1000", "12.50": "12.5", '" 1.5 "': "1.5", "-0.0": "0", '"0e-50"': "0",
    '"0.1000000000000000000000"': "0.1", "1234567890123.123456789012": "1234567890123.123456789012",
    "0.12345678901200000": "0.123456789012", '"123456789e-12"': "0.000123456789",
    '"1e15"': "1000000000000000", "null": None, '"1234567890123456.000000000001"': "1234567890123456.000000000001",
}
REFUSED = [
    '"abc"', "true", '{"a":1}', '"1_0"', '""', '"."', '"1e16"', "12345678901234567", '"1e-13"', "1e400",
    '"1e-400"', '"1e-99999999999"', '"1e99999999999"', "0.1234567890123", '"0.1234567890123"',
    "1.23456789012345678e-3", "123456789012345678901234567890.5", "1e-20",
    "12345.67000000000000001", "0.30000000000000001",
]


def amounts(spark, spelled, variant, **kind):
    df = spark.createDataFrame([(k, f'{{"amount":{x}}}') for k, x in enumerate(spelled)], "k int, c string")
    df = df.withColumn("c", F.parse_json("c")) if variant else df
    out = df.select("k", fn.json_decimal(df, "c", "$.amount", NATIVE_AMOUNT, **kind).alias("x"))
    return [r.x for r in out.orderBy("k").collect()]


@pytest.mark.parametrize("variant", [False, True])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_number_is_read_by_value(spark, settings, ansi, variant):
    settings("spark.sql.ansi.enabled", ansi)
    want = [x and Decimal(x) for x in SPELLINGS.values()]
    assert amounts(spark, SPELLINGS, variant) == want
    assert amounts(spark, REFUSED, variant, strict=False) == [None] * len(REFUSED)


@pytest.mark.parametrize("spelled", REFUSED)
def test_what_cannot_be_read_raises(spark, spelled):
    with pytest.raises(PySparkException, match="not a decimal"):
        amounts(spark, [spelled], False)


def test_a_number_with_a_repeated_key_is_not_guessed(spark):
    df = spark.createDataFrame([('{"amount":1234567890.1234567,"amount":2}',)], "c string")
    with pytest.raises(PySparkException, match="not a decimal"):
        df.select(fn.json_decimal(df, "c", "$.amount", NATIVE_AMOUNT)).collect()


def source(spark, spelled):
    return InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-10")],
        native_events=[
            event("a", "2024-06-10", FEE_CONTRACT, FEE_EVENT, f'{{"amount":{x}}}') for x in spelled
        ],
    )


@pytest.mark.parametrize("metric", ["fees_summary", "fees_series"])
def test_three_bad_amounts_of_ten(spark, metric):
    src = source(spark, ["1"] * 7 + ['"oops"', '"oops"', '"1e-20"'])
    with pytest.raises(PySparkException, match="not a decimal"):
        METRICS[metric](src, WEEK).collect()
    rejects = Rejects()
    result = rows(METRICS[metric](src, WEEK, rejects=rejects))
    assert result[0]["total_fees"] == 7 and result[0]["avg_tx_fee"] == 1
    assert (rejects.read, rejects.rejected) == (10, 3)
    assert rejects.samples == ["oops", "1e-20"]
    assert rows(METRICS[metric](src, WEEK, strict=False)) == result


def test_a_run_without_bad_amounts_rejects_none(spark):
    rejects = Rejects()
    rows(fees.fees_summary(source(spark, ["1", "null", '"2"']), WEEK, rejects=rejects))
    assert (rejects.read, rejects.rejected, rejects.samples) == (2, 0, [])


def test_events_of_other_kinds_are_not_looked_at(spark):
    src = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-10")],
        native_events=[fee_event("a", "2024-06-10", "3"), event("a", "2024-06-10", "A.1", "Other", '{"amount":"x"}')],
    )
    rejects = Rejects()
    assert rows(fees.fees_summary(src, WEEK, rejects=rejects))[0]["total_fees"] == 3
    assert (rejects.read, rejects.rejected) == (1, 0)
