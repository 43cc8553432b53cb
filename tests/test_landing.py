"""Landing day by day, and pruning by day that loses nothing."""

import re
from datetime import date
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from inline import InlineSources, actors, event, evm_tx, fee_event, native_tx, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_plans import plan

from tallychain.constants import DEPLOY_TOPIC
from tallychain.functions import scalars as fn
from tallychain.metrics import METRICS
from tallychain.period import Period
from tallychain.sources.schemas import NATIVE_AMOUNT
from tallychain.sources.tables import ParquetSources, land_table

WEEK = Period("last_week", date(2024, 6, 13))  # from the 6th
PARENTS = {"native_events": "native_tx", "native_actors": "native_tx", "evm_logs": "evm_tx"}


def land(source, root, names=("native_tx", "evm_tx", "native_events", "evm_logs", "native_actors")):
    for name in names:
        parent = PARENTS.get(name)
        land_table(getattr(source, name)(), str(root), name, parent and getattr(source, parent)())
    return ParquetSources(source.spark, str(root))


def around_midnight(spark):
    """Events and logs of transactions whose blocks lie on the other side of a bound."""
    return InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-06 00:00:00", "u"), native_tx("b", "2024-06-12 23:59:59", "v"),
                   native_tx("c", "2024-06-05 23:59:59", "w"), native_tx("d", "2024-06-13 00:00:00", "x")],
        evm_tx=[evm_tx("e", "2024-06-06", "0x1", "1", "0x60806040"), evm_tx("f", "2024-06-12 23:59:59", "0x2", "1")],
        native_events=[
            fee_event("a", "2024-06-05 23:59:59", "2.5"), fee_event("b", "2024-06-13 00:00:00", "4"),
            fee_event("c", "2024-06-06 00:00:00", "8"), fee_event("d", "2024-06-12 23:59:59", "16"),
            event("c", "2024-06-06 00:00:01", "A.1", "AccountContractAdded"),
            event("d", "2024-06-12 23:59:59", "A.2", "AccountContractAdded"),
            event("none", "2024-06-08", "A.3", "AccountContractAdded"),
        ],
        evm_logs=[("e", "0xc1", [DEPLOY_TOPIC]), ("f", "0xc2", [DEPLOY_TOPIC]), ("g", "0xc3", [DEPLOY_TOPIC]),
                  ("f", "0xc4", ["0x00"]), ("f", "0xc5", None)],
        native_actors=[actors("a", "2024-06-06", "u")],
    )


@pytest.mark.parametrize(
    "metric",
    ["fees_summary", "fees_series", "deployers_native_kpi", "deployers_series", "contracts_kpis",
     "contracts_series", "contracts_by_type", "contracts_by_chain", "weekly_contracts_by_type"],
)
def test_split_tables_give_the_rows_of_whole_ones(spark, tmp_path, metric):
    whole = around_midnight(spark)
    landed = land(whole, tmp_path)
    want = rows(METRICS[metric](whole, WEEK))
    assert want and rows(METRICS[metric](landed, WEEK)) == want


def test_a_fee_event_older_than_its_transaction_counts(spark, tmp_path):
    source = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-06 00:00:00")],
        evm_tx=[evm_tx("e", "2024-06-06", "0x1", "1")],
        native_events=[fee_event("a", "2024-06-05 23:59:59", "2.5")],
    )
    for src in (source, land(source, tmp_path)):
        assert rows(METRICS["fees_summary"](src, WEEK))[0]["total_fees"] == Decimal("3.5")


def test_days_are_landed_one_by_one_and_again(spark, tmp_path):
    def day(n, *ids):
        return InlineSources(
            spark,
            evm_tx=[evm_tx(i, f"2024-06-{n}", "0x1") for i in ids],
            evm_logs=[(i, "0xc", [DEPLOY_TOPIC]) for i in ids],
        )

    for source in (day(10, "a", "b"), day(11, "c"), day(10, "a", "z", "y")):
        src = land(source, tmp_path, ("evm_tx", "evm_logs"))
    assert {r.tx_hash for r in src.evm_tx().collect()} == {"a", "c", "y", "z"}
    assert {r.tx_hash for r in src.deploy_logs().collect()} == {"a", "c", "y", "z"}


def test_landing_refuses_rows_without_a_day_or_far_from_it(spark, tmp_path):
    source = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-06")],
        native_events=[fee_event("a", "2024-06-08", "1")],
        evm_logs=[("e", "0xc", [])],
    )
    with pytest.raises(ValueError, match="transactions"):
        land_table(source.evm_logs(), str(tmp_path), "evm_logs")
    with pytest.raises(PySparkException, match="more than a day"):
        land_table(source.native_events(), str(tmp_path), "native_events", source.native_tx())


def test_every_log_scan_is_pruned_without_a_given_day(spark, tmp_path):
    landed = land(around_midnight(spark), tmp_path)
    for metric in ("contracts_kpis", "contracts_series", "contracts_by_type", "contracts_by_chain", "deployers_series"):
        text = plan(METRICS[metric](landed, WEEK))
        assert len(re.findall(r"PartitionFilters: \[.+\]", text)) == text.count("ReadSchema")


def test_logs_landed_without_the_flag_are_still_found(spark, tmp_path):
    logs = around_midnight(spark).evm_logs().withColumn("block_date", F.lit(date(2024, 6, 6)))
    logs.write.partitionBy("block_date").parquet(f"{tmp_path}/evm_logs")
    found = ParquetSources(spark, str(tmp_path)).deploy_logs().collect()
    assert {r.contract_address for r in found} == {"0xc1", "0xc2", "0xc3"}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("amount", ["oops", "0.0000000000001", "12345678901234567", "1e-20"])
def test_amounts_that_cannot_be_kept_raise(spark, settings, ansi, amount):
    settings("spark.sql.ansi.enabled", ansi)
    source = InlineSources(
        spark, native_tx=[native_tx("a", "2024-06-10")], native_events=[fee_event("a", "2024-06-10", amount)]
    )
    for metric in ("fees_series", "fees_summary"):
        with pytest.raises(PySparkException, match="not a decimal"):
            METRICS[metric](source, WEEK).collect()
    events = source.native_events().withColumn("parsed", F.parse_json("event_data"))
    with pytest.raises(PySparkException, match="not a decimal"):
        events.select(fn.json_decimal(events, "parsed", "$.amount", NATIVE_AMOUNT)).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_long_amounts_are_summed_exactly(spark, settings, ansi):
    settings("spark.sql.ansi.enabled", ansi)
    amounts = ["1234567890123.0000000001", "0.0000000001", "7.1000000000000000"]
    source = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-10"), native_tx("a", "2024-06-10")],
        native_events=[fee_event("a", "2024-06-10", x) for x in amounts],
    )
    total = rows(METRICS["fees_summary"](source, WEEK))[0]["total_fees"]
    assert total == 2 * sum(map(Decimal, amounts))


def test_a_null_hash_is_not_excluded_by_chance(spark):
    from tallychain.constants import INIT_SIGNATURES
    from tallychain.registry.operator_checks import join_anti_not_in

    source = InlineSources(
        spark,
        evm_tx=[evm_tx(None, "2024-06-10", "0x1", "0", INIT_SIGNATURES[0]), evm_tx("b", "2024-06-10", "0x2", "0", INIT_SIGNATURES[0])],
    )
    assert [r.tx_hash for r in join_anti_not_in(source).collect()] == ["b"]


def test_landed_logs_share_few_row_groups_with_the_flag(spark, tmp_path):
    """A row in a hundred has the topic: most row groups of a landed day are known to have none."""
    logs = spark.range(200_000).select(
        F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("tx_hash"),
        F.concat(F.lit("0xc"), F.col("id")).alias("contract_address"),
        F.array(F.when(F.col("id") % 100 == 0, DEPLOY_TOPIC).otherwise("0xddf252ad")).alias("topics"),
        F.lit(date(2024, 6, 6)).alias("block_date"),
    )
    land_table(logs, str(tmp_path), "evm_logs", row_group=1 << 20)
    flags = []
    for file in (tmp_path / "evm_logs").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("is_deploy")
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(at).statistics
            flags.append((stats.min, stats.max, meta.row_group(k).num_rows))
    without = sum(n for low, high, n in flags if not high)
    assert len(flags) > 5 and without > 150_000
    landed = ParquetSources(spark, str(tmp_path))
    found = landed.deploy_logs()
    assert found.count() == 2_000
    assert scanned_rows(found) < 60_000
    assert scanned_rows(landed.evm_logs()) == 200_000


def scanned_rows(df):
    """Rows that the scan hands on, before any filter."""
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution().executedPlan()
    list(df.collect())
    nodes = [query]
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            return node.metrics().get("numOutputRows").get().value()
        nodes += [node.children().apply(k) for k in range(node.children().length())]
    raise AssertionError("no scan")


def test_landings_are_noted(spark, tmp_path):
    source = around_midnight(spark)
    assert ParquetSources(spark, str(tmp_path)).version() is None
    versions = {land(source, tmp_path, (n,)).version() for n in ("native_tx", "evm_tx", "native_tx")}
    assert len(versions) == 3
    assert ParquetSources(spark, str(tmp_path)).version() in versions
