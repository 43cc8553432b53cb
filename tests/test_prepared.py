"""Kept tables: steps, first appearances, buckets that are over, sketches."""

import re
from datetime import date, datetime, timedelta

import pytest
from inline import InlineSources, actors, evm_tx, native_tx, rows
from paths import SMALL
from test_plans import plan

from tallychain.metrics import METRICS
from tallychain.metrics.transactions import tx_kpis
from tallychain.operators.sketches import approx_distinct
from tallychain.period import Period
from tallychain.sinks.prepared import PreparedSources
from tallychain.sources.fixtures import EPOCH_START, OrderSources
from tallychain.sources.tables import FIRST_SEEN_KEYS, ParquetSources, land_table


@pytest.fixture(scope="module")
def orders(spark):
    return OrderSources(spark, SMALL)


@pytest.fixture(scope="module")
def kept(orders, tmp_path_factory):
    """Three steps over the order tables."""
    state = PreparedSources(orders, str(tmp_path_factory.mktemp("kept")))
    states = [state]
    for day in (date(1995, 5, 17), date(1997, 3, 1), date(1997, 3, 20)):
        state = state.advance(day)
        states.append(state)
    return states


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_new_keys_only(spark, tmp_path):
    base = InlineSources(
        spark,
        native_actors=[actors("a", "2024-06-01", "u"), actors("b", "2024-06-05", "u", "v"), actors("c", "2024-06-09", "v", "w")],
        evm_tx=[evm_tx("e", "2024-06-01", "0x1", "0", "0x60806040"), evm_tx("e", "2024-06-05", None, "0", "0x60806040")],
    )
    kept = PreparedSources(base, str(tmp_path))
    for day in (date(2024, 6, 3), date(2024, 6, 6), date(2024, 6, 10)):
        kept = kept.advance(day)
    written = [
        [r.address for r in spark.read.parquet(f"{tmp_path}/{s.name}/first_seen/native_address").collect()]
        for s in kept.steps
    ]
    assert written == [["u"], ["v"], ["w"]]
    for name in ("native_address", "evm_address", "evm_deploy", "account"):
        for upper in (date(2024, 6, 4), date(2024, 6, 20)):
            assert same(kept.first_seen(name, upper), base.first_seen(name, upper))


def test_two_steps_from_one_state_do_not_see_each_other(orders, tmp_path):
    start = PreparedSources(orders, str(tmp_path))
    one = start.advance(date(1996, 1, 1))
    two = start.advance(date(1997, 1, 1))
    for state, upper in ((one, date(1996, 1, 1)), (two, date(1997, 1, 1)), (one, date(1997, 1, 1))):
        for name in FIRST_SEEN_KEYS:
            assert same(state.first_seen(name, upper), orders.first_seen(name, upper))


def test_a_step_that_breaks_off_is_never_seen(orders, tmp_path, monkeypatch):
    state = PreparedSources(orders, str(tmp_path)).advance(date(1996, 1, 1))
    with monkeypatch.context() as m:
        m.setattr(PreparedSources, "_write_deploy_logs", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.advance(date(1996, 6, 1))
    later = state.advance(date(1997, 1, 1))
    for name in FIRST_SEEN_KEYS:
        assert same(later.first_seen(name, date(1998, 1, 1)), orders.first_seen(name, date(1998, 1, 1)))
    with pytest.raises(ValueError, match="no complete step"):
        PreparedSources(orders, str(tmp_path), date(1996, 6, 1))


def test_a_state_is_found_again_by_its_day(orders, kept):
    again = PreparedSources(orders, kept[-1].root, kept[-1].upto)
    assert again.steps == kept[-1].steps
    assert PreparedSources(orders, kept[-1].root, kept[1].upto).steps == kept[1].steps


PERIODS = [
    Period(key, as_of, EPOCH_START)
    for key, as_of in (
        ("all_time", date(1998, 3, 5)), ("all_time", date(1996, 7, 2)), ("last_year", date(1997, 4, 3)),
        ("last_month", date(1997, 3, 10)),
    )
]


@pytest.mark.parametrize("period", PERIODS, ids=lambda p: f"{p.key}-{p.as_of}")
@pytest.mark.parametrize(
    "metric", ["tx_over_time", "active_accounts_series", "accounts_created_series"]
)
def test_series_over_kept_buckets_equal_the_base(orders, kept, metric, period):
    want = rows(METRICS[metric](orders, period))
    for state in (kept[1], kept[3]):
        assert rows(METRICS[metric](state, period)) == want


def test_a_first_appearance_before_the_period_is_not_a_debut(spark, tmp_path):
    """Kept debut counts serve a period only if it covers all history."""
    base = InlineSources(
        spark,
        native_actors=[actors("a", "2019-06-01", "u"), actors("b", "2024-03-05", "u", "v")],
    )
    state = PreparedSources(base, str(tmp_path)).advance(date(2024, 5, 1))
    for start in (date(2020, 1, 1), date(2019, 1, 1)):
        period = Period("all_time", date(2024, 6, 13), start)
        want = rows(METRICS["accounts_created_series"](base, period))
        assert rows(METRICS["accounts_created_series"](state, period)) == want
        assert sum(r["daily_new_accounts"] for r in want) == 2


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    times = [(datetime(2024, 4, 15) + timedelta(days=d)).isoformat() for d in range(45)]
    source = InlineSources(
        spark,
        native_tx=[native_tx(f"n{i}", t, f"u{i % 5}") for i, t in enumerate(times)],
        evm_tx=[evm_tx(f"e{i}", t, f"v{i}") for i, t in enumerate(times)],
        native_actors=[actors(f"n{i}", t, f"u{i % 5}", "w") for i, t in enumerate(times)],
    )
    root = str(tmp_path_factory.mktemp("tables"))
    parents = {"native_actors": source.native_tx(), "native_events": source.native_tx(),
               "evm_logs": source.evm_tx()}
    for name in ("native_tx", "evm_tx", *parents):
        land_table(getattr(source, name)(), root, name, parents.get(name))
    return ParquetSources(spark, root)


def test_a_daily_run_reads_only_days_after_the_bound(stored, tmp_path):
    state = PreparedSources(stored, str(tmp_path)).advance(date(2024, 5, 10)).advance(date(2024, 5, 20))
    period = Period("last_3_months", date(2024, 5, 27), date(2024, 3, 1))
    weeks = plan(METRICS["tx_by_type"](state, period))
    bounds = re.findall(r"PartitionFilters: \[(.*block_date.*)\]", weeks)
    # The partial first week, and the days since the last Monday before the bound.
    assert len(bounds) == 4
    assert all(">= 2024-05-19" in b or ("< 2024-03-05" in b) for b in bounds)
    everything = Period("all_time", date(2024, 6, 2), date(2024, 3, 1))
    new = plan(METRICS["accounts_created_series"](state, everything))
    assert all(">= 2024-05-19" in b for b in re.findall(r"PartitionFilters: \[(.*block_date.*)\]", new))
    assert same(METRICS["accounts_created_series"](state, everything), METRICS["accounts_created_series"](stored, everything))


def test_sketches_count_within_two_percent(spark, orders, kept):
    period = Period("all_time", date(1998, 3, 5), EPOCH_START)
    for state in (orders, kept[2]):
        for metric in ("tx_kpis", "active_accounts_total", "active_accounts_evm"):
            exact = METRICS[metric](orders, period).first().asDict()
            close = METRICS[metric](state, period, approximate=True).first().asDict()
            assert all(abs(close[k] - n) <= 0.02 * n for k, n in exact.items())
        exact = {(r.period, r.type): r.transactions for r in METRICS["tx_by_type"](orders, period).collect()}
        close = METRICS["tx_by_type"](state, period, approximate=True).collect()
        assert {(r.period, r.type) for r in close} == set(exact)
        assert all(abs(r.transactions - exact[r.period, r.type]) <= 0.02 * exact[r.period, r.type] for r in close)
    with pytest.raises(ValueError, match="hour"):
        METRICS["tx_by_type"](orders, Period("last_24h", date(1998, 3, 5)), approximate=True)


def test_sketches_of_many_values(spark):
    daily = InlineSources(spark, native_tx=[native_tx("a", "2024-06-01")])
    assert approx_distinct(daily.daily_sketches("native_tx", date(2024, 7, 1), None), "n").first().n == 0
    assert tx_kpis(daily, Period("all_time", date(2024, 7, 1)), approximate=True).first().cadence == 1
    with pytest.raises(ValueError, match="unknown kind"):
        daily.counted_rows("nothing", None, None)


def test_a_second_day_reads_only_itself_for_sketches(stored, tmp_path):
    state = PreparedSources(stored, str(tmp_path)).advance(date(2024, 5, 10))
    text = plan(state.daily_sketches("native_tx", date(2024, 3, 5), date(2024, 5, 12)))
    bounds = re.findall(r"PartitionFilters: \[(.*block_date.*)\]", text)
    assert len(bounds) == 1 and ">= 2024-05-09" in bounds[0]
