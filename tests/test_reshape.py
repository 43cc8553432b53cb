import pytest
from inline import rows

from tallychain.operators import reshape


@pytest.fixture
def frame(spark):
    data = [(1, "a", 1), (1, "b", 3), (2, "a", 0), (2, "b", 0)]
    return spark.createDataFrame(data, "t int, type string, n int")


def test_share_sums_to_one_and_is_null_for_an_empty_bucket(frame):
    got = {(r["t"], r["type"]): r["share"] for r in rows(reshape.share_of_bucket(frame, "t", "n"))}
    assert got == {(1, "a"): 0.25, (1, "b"): 0.75, (2, "a"): None, (2, "b"): None}


def test_series_order_of_unknown_series(frame):
    got = rows(reshape.series_order(frame, "type", ["b"]))
    assert {(r["type"], r["series_order"]) for r in got} == {("a", 2), ("b", 1)}


def test_latest_bucket(frame):
    assert {r["type"]: r["n"] for r in rows(reshape.latest_bucket_share(frame, "t", "type", "n"))} == {
        "a": 0, "b": 0,
    }


def test_kpi_text(spark):
    df = spark.createDataFrame(
        [("1234567.5",), ("-0.25",), ("x",), (None,), ("NaN",)], "v string"
    )
    texts = [r.t for r in df.select(reshape.kpi_format("v", 2).alias("t")).collect()]
    assert texts == ["1,234,567.50", "-0.25", "—", "—", "—"]


def test_coercion_gives_null(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("?", "?")], "n string, t string")
    got = rows(reshape.coerce_types(df, numbers=("n",), timestamps=("t",)))
    assert got[0]["n"] == 1.5 and got[0]["t"].day == 2
    assert got[1] == {"n": None, "t": None}


def test_sorting_and_null_keys(spark):
    df = spark.createDataFrame([(2, 1.0), (None, 2.0), (1, None)], "t int, v double")
    assert [r["t"] for r in rows(reshape.sort_by_time(reshape.drop_null_keys(df, "t"), "t"))] == [1, 2]
    assert reshape.drop_null_keys(df, "t", "v").count() == 1


def test_names(frame):
    assert reshape.normalise_names(frame, {"N": "TX"}).columns == ["T", "TYPE", "TX"]
