from datetime import date
from types import SimpleNamespace

import pytest
from inline import InlineSources, native_tx, rows

from tallychain.metrics import METRICS
from tallychain.metrics.transactions import tx_by_type
from tallychain.period import Period
from tallychain.session import shared_folder
from tallychain.sinks.store import MetricStore, write_csv
from tallychain.sources.tables import ParquetSources, land_table

WEEK = Period("last_week", date(2024, 6, 13))


def sources(spark, *days):
    return InlineSources(spark, native_tx=[native_tx(d, f"2024-06-{d}") for d in days])


def test_csv_has_header_and_no_index(spark, tmp_path):
    path = tmp_path / "csv"
    df = spark.createDataFrame([("é", 1)], "name string, n int")
    write_csv(df, str(path))
    lines = [f.read_text("utf-8").splitlines() for f in path.glob("part-*")]
    assert all(file[0] == "name,n" for file in lines)
    assert [line for file in lines for line in file[1:]] == ["é,1"]


def test_store_computes_once_until_refreshed(spark, tmp_path):
    store = MetricStore(str(tmp_path))
    first = sources(spark, "10")
    assert store.get("tx_by_type", first, WEEK).count() == 1
    more = sources(spark, "10", "11")
    assert store.get("tx_by_type", more, WEEK).count() == 1
    assert store.refresh("tx_by_type", more, WEEK).count() == 2
    assert store.get("tx_by_type", first, WEEK).count() == 2


def test_an_empty_result_replaces_the_old_one(spark, tmp_path):
    store = MetricStore(str(tmp_path))
    store.refresh("tx_by_type", sources(spark, "10"), WEEK)
    assert store.refresh("tx_by_type", sources(spark), WEEK).count() == 0
    assert store.get("tx_by_type", sources(spark, "10"), WEEK).count() == 0


def test_results_of_other_periods_and_days_stay(spark, tmp_path):
    store = MetricStore(str(tmp_path))
    src = sources(spark, "10")
    for period in (WEEK, Period("last_month", WEEK.as_of), Period("last_week", date(2024, 6, 14))):
        store.refresh("tx_by_type", src, period)
    history = rows(store.history("tx_by_type", src))
    assert {(r["period_key"], r["as_of_day"].isoformat()) for r in history} == {
        ("last_week", "2024-06-13"), ("last_month", "2024-06-13"), ("last_week", "2024-06-14"),
    }


@pytest.mark.parametrize("metric", METRICS)
def test_every_metric_can_be_stored(spark, tmp_path, metric):
    store = MetricStore(str(tmp_path))
    src = sources(spark, "10")
    stored = store.refresh(metric, src, WEEK)
    assert stored.columns == METRICS[metric](src, WEEK).columns


def test_everything_can_be_refreshed(spark, tmp_path):
    store = MetricStore(str(tmp_path))
    src = sources(spark, "10")
    store.refresh_all(src, [WEEK])
    assert {p.name for p in tmp_path.iterdir()} == set(METRICS)
    assert store.get("tx_kpis", src, WEEK).collect()[0].cadence == 1


def test_store_of_an_unknown_metric(spark, tmp_path):
    with pytest.raises(KeyError):
        MetricStore(str(tmp_path)).get("nothing", sources(spark), WEEK)


class _Session:
    """Stands for a session: the settings tested here are fixed once a real one runs."""

    def __init__(self, master, **settings):
        self.conf = settings
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1")


def test_shared_folder_is_the_one_the_session_names():
    named = _Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://host/shared/"})
    assert shared_folder(named).startswith("hdfs://host/shared/tallychain/app-1/")
    assert shared_folder(named) != shared_folder(named)
    for session in (_Session("spark://host:7077"), _Session("local[2]")):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(_Session("local-cluster[3,2,1000]"), local_fallback=True)
    assert "/tallychain/app-1/" in shared_folder(_Session("local[2]"), local_fallback=True)


def test_the_whole_key_counts(spark, tmp_path):
    """Start of history and options are part of the key."""
    store = MetricStore(str(tmp_path))
    src = sources(spark, "09", "10", "11")
    early = Period("all_time", date(2024, 6, 13), date(2024, 1, 1))
    late = Period("all_time", date(2024, 6, 13), date(2024, 6, 11))
    assert store.get("tx_kpis", src, early).collect()[0].cadence == 3
    assert store.get("tx_kpis", src, late).collect()[0].cadence == 1
    assert store.get("tx_kpis", src, early).collect()[0].cadence == 3
    prefix = store.path("contracts_by_type", early, coa_prefix="0xaa")
    store.get("contracts_by_type", src, early, coa_prefix="0xaa")
    assert prefix != store.path("contracts_by_type", early)
    assert store.history("tx_kpis", src).count() == 2


def test_a_broken_write_is_computed_again(spark, tmp_path):
    store = MetricStore(str(tmp_path))
    src = sources(spark, "10")
    # The folders of a run that broke off: no files at all, or results that no mark names.
    for folder in ("results", "marks"):
        (tmp_path / "tx_by_type" / folder / store._key(WEEK, {}) / "run=x").mkdir(parents=True)
    assert store.get("tx_by_type", src, WEEK).count() == 1
    assert store.get("tx_by_type", sources(spark, "10", "11"), WEEK).count() == 1
    assert store.history("tx_by_type", src).count() == 1


def test_stored_rows_equal_the_metric(spark, tmp_path):
    src = sources(spark, "09", "10", "11")
    stored = MetricStore(str(tmp_path)).refresh("tx_by_type", src, WEEK)
    assert rows(stored.orderBy("period")) == rows(tx_by_type(src, WEEK).orderBy("period"))


def test_marks_are_added_and_never_changed(spark, tmp_path):
    """A reader between two refreshes finds a result, and so does one after a broken refresh."""
    store = MetricStore(str(tmp_path))
    marks = tmp_path / "tx_by_type" / "marks" / store._key(WEEK, {})
    store.refresh("tx_by_type", sources(spark, "10"), WEEK)
    first = {p.name: p.read_bytes() for p in marks.glob("part-*")}
    store.refresh("tx_by_type", sources(spark, "10", "11"), WEEK)
    second = {p.name: p.read_bytes() for p in marks.glob("part-*")}
    assert len(first) == 1 and len(second) == 2 and first.items() <= second.items()
    assert store.get("tx_by_type", sources(spark), WEEK).count() == 2
    # A refresh that broke off: rows without a mark, and a mark that was not completed.
    broken = tmp_path / "tx_by_type" / "results" / store._key(WEEK, {}) / "run=broken"
    sources(spark, "12").native_tx().write.parquet(str(broken))
    (marks / "_temporary" / "0").mkdir(parents=True)
    assert store.get("tx_by_type", sources(spark), WEEK).count() == 2
    # Two refreshes that took the same number: all readers agree.
    spark.createDataFrame([(2, "0", None, "{}")], "number long, run string, version string, given string"
                          ).write.mode("append").parquet(str(marks))
    assert store.get("tx_by_type", sources(spark), WEEK).count() == 2


def test_new_data_is_noticed_and_options_are_refreshed(spark, tmp_path):
    root, store = tmp_path / "chain", MetricStore(str(tmp_path / "store"))
    landed = ParquetSources(spark, str(root))
    for day, n in (("10", 1), ("11", 2)):
        land_table(sources(spark, day).native_tx(), str(root), "native_tx")
        land_table(sources(spark, day).evm_tx().limit(0), str(root), "evm_tx")
        assert store.get("tx_kpis", landed, WEEK).collect()[0].cadence == n
    runs = len(list((tmp_path / "store").rglob("run=*")))
    assert store.get("tx_kpis", landed, WEEK).collect()[0].cadence == 2
    assert len(list((tmp_path / "store").rglob("run=*"))) == runs
    src = sources(spark, "10")
    other = MetricStore(str(tmp_path / "other"))
    other.get("contracts_by_type", src, WEEK, coa_prefix="0xaa")
    other.refresh_all(src, [WEEK])
    marks = spark.read.parquet(str(tmp_path / "other" / "contracts_by_type" / "marks"))
    assert sorted((r.given, r.number) for r in marks.collect()) == [
        ('{"coa_prefix": "0xaa"}', 1), ('{"coa_prefix": "0xaa"}', 2), ("{}", 1),
    ]
