import json
from datetime import date, timedelta
from itertools import product

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from inline import InlineSources
from pyspark.sql import functions as F

from tallychain.sources.payloads import (
    market_daily,
    market_points,
    market_series,
    tvl_points,
    tvl_values,
)
from tallychain.sources.tables import ParquetSources

EPOCH = date(1970, 1, 1)
points = st.lists(
    st.tuples(st.integers(-2, 2), st.sampled_from([-3.0, -0.5, 0.0, 0.25, 2.0, 7.0, None])), max_size=6
)


def _document(prices, caps, volumes) -> dict:
    def series(values):
        return [[d * 86_400_000 + 3_600_000, v] for d, v in values]

    return {
        "data": {
            "prices": series(prices),
            "market_caps": series(caps),
            "total_volumes": series(volumes),
        }
    }


@hypothesis_settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(points, points, points)
def test_supply_of_repeated_points_is_the_highest_pairing(spark, prices, caps, volumes):
    src = InlineSources(spark, market=[_document(prices, caps, volumes)])
    want = {}
    for (d, p), (e, c), (f, _) in product(prices, caps, volumes):
        if d == e == f:
            pair = c / p if c is not None and p else None
            known = want.get(EPOCH + timedelta(days=d))
            want[EPOCH + timedelta(days=d)] = max((x for x in (known, pair) if x is not None), default=None)
    got = {r.date: r.total_supply for r in market_daily(src.market_payload()).collect()}
    assert got == want


def test_documents_may_overlap(spark):
    document = _document([(0, 2.0)], [(0, 10.0)], [(0, 1.0)])
    other = _document([(0, 2.0), (1, 4.0)], [(0, 10.0), (1, 8.0)], [(0, 3.0)])
    src = InlineSources(spark, market=[document, document, other])
    got = [tuple(r) for r in market_points(src.market_payload()).collect()]
    assert got == [(EPOCH, 2.0, 10.0, 3.0)]


def test_locked_value_keeps_the_highest_of_a_day(spark):
    document = {"data": [{"date": 0, "tvl": 1.0}, {"date": 86_399, "tvl": 3.0}, {"date": 86_400, "tvl": 2.0}]}
    src = InlineSources(spark, tvl=[document])
    got = {r.date: r.protocol_locked for r in tvl_points(src.tvl_payload()).collect()}
    assert got == {EPOCH: 3.0, EPOCH + timedelta(days=1): 2.0}


def test_broken_document_is_an_error(spark):
    src = InlineSources(spark, market=["{not json"])
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        market_points(src.market_payload()).collect()


def _spelled(document: dict, style: int) -> str:
    if style == 1:
        return json.dumps(document, indent=2)
    return json.dumps(document, separators=(",", ":") if style else None)


@pytest.mark.parametrize("style", [0, 1, 2])
@pytest.mark.parametrize("split", [40, 333, 10_000])
def test_files_read_in_splits_equal_whole_documents(spark, settings, tmp_path, style, split):
    settings("spark.sql.files.maxPartitionBytes", str(split))
    settings("spark.sql.files.openCostInBytes", "0")
    many = [(d, 0.5 * d) for d in range(40)]
    documents = [
        {"status": 200, **_document(many, [(0, None), (3, 1e-7)], many[:7])},
        _document([], many[5:9], []),
        {**_document(many[:1], [], []), "other": [[1, 2.5], [3, 4]], "note": "done"},
    ]
    locked = [{"data": [{"date": 86_400 * d, "tvl": v} for d, v in many]}, {"data": []}, {"code": 500},
              {"code": 1, "data": [{"date": 5, "tvl": None}], "more": [{"date": 1, "tvl": 9.0}]}]
    for name, given in (("market_payload", documents), ("tvl_payload", locked)):
        (tmp_path / name).mkdir()
        for k, document in enumerate(given):
            (tmp_path / name / f"{k}.json").write_text(_spelled(document, style))
    src = ParquetSources(spark, str(tmp_path))
    for got, want in (
        (src.market_series(), market_series(src.market_payload())),
        (src.tvl_values(), tvl_values(src.tvl_payload())),
    ):
        assert want.count() > 40
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("text", ['{"data":{"prices":[[1,2],[3', '{"data":{"prices":[[1,2],[3,x]]}}'])
def test_a_torn_or_broken_file_is_an_error(spark, tmp_path, text):
    (tmp_path / "market_payload").mkdir()
    (tmp_path / "market_payload" / "a.json").write_text(text)
    with pytest.raises(Exception, match="ends inside|MALFORMED"):
        ParquetSources(spark, str(tmp_path)).market_series().collect()


def test_a_large_document_is_read_by_several_tasks(spark, settings, tmp_path):
    """Three million points in one file: no task reads them all."""
    settings("spark.sql.files.maxPartitionBytes", str(8 << 20))
    (tmp_path / "market_payload").mkdir()
    per_series = 1_000_000
    with (tmp_path / "market_payload" / "a.json").open("w") as f:
        for k, name in enumerate(("prices", "market_caps", "total_volumes")):
            f.write(('{"data":{' if not k else "],") + f'"{name}":[')
            f.write(",".join(f"[{n * 60_000},{n % 97}.5]" for n in range(per_series)))
        f.write("]}}")
    series = ParquetSources(spark, str(tmp_path)).market_series()
    counts = {r.series: (r.n, r.total) for r in series.groupBy("series").agg(
        F.count("value").alias("n"), F.sum("value").alias("total")).collect()}
    total = sum(n % 97 + 0.5 for n in range(per_series))
    assert counts == dict.fromkeys(("prices", "market_caps", "total_volumes"), (per_series, total))
    text = spark.read.option("lineSep", "]").text(str(tmp_path / "market_payload"))
    assert text.rdd.getNumPartitions() > 5
