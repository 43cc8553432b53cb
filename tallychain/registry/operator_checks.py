"""Sources and operators one by one, each over whole tables."""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.constants import (
    BOTH_LABEL,
    COMMIT_ACTIONS,
    EVM_LABEL,
    FEE_CONTRACT,
    FEE_EVENT,
    INIT_SIGNATURES,
    NATIVE_LABEL,
    WEEK_TABLE_WEEKS,
    WITHDRAW_ACTIONS,
)
from tallychain.functions import scalars as fn
from tallychain.metrics import accounts, contracts, fees, transactions
from tallychain.metrics.supply import latest_before
from tallychain.operators import aggregates as agg
from tallychain.operators import deploys, joins, sketches, weeks, windows
from tallychain.operators.accounts import explode_actors, senders
from tallychain.operators.filters import (
    PARTITION_DATE,
    between,
    completed,
    has_topic,
    in_complete_buckets,
    in_period,
    is_coa,
)
from tallychain.period import PERIOD_KEYS, Period, monday_of
from tallychain.registry.base import check
from tallychain.registry.metric_checks import ROLL, SIGNATURES, TOPIC_MATCH, _day
from tallychain.registry.metric_checks import accounts_created_series as accounts_created_series_sql
from tallychain.registry.metric_checks import active_accounts_series as active_accounts_series_sql
from tallychain.registry.metric_checks import contracts_by_chain as contracts_by_chain_sql
from tallychain.registry.metric_checks import fees_series as fees_series_sql
from tallychain.registry.metric_checks import tx_by_type as tx_by_type_sql
from tallychain.session import shared_folder
from tallychain.sinks.prepared import PreparedSources
from tallychain.sinks.store import MetricStore, write_csv
from tallychain.sources import fixtures as fx
from tallychain.sources.buckets import BucketedSources, land_buckets
from tallychain.sources.fixtures import EventSources, OrderSources
from tallychain.sources.payloads import market_points, tvl_points
from tallychain.sources.schemas import NATIVE_AMOUNT

TS = "block_timestamp"
ALL = Period("all_time", fx.AS_OF, fx.EPOCH_START)
YEAR = Period("last_year", fx.AS_OF, fx.EPOCH_START)
MONTH = Period("last_month", fx.AS_OF, fx.EPOCH_START)
HOURS = Period("last_24h", fx.EVENTS_AS_OF, fx.EVENTS_EPOCH)
PERIODS = tuple(Period(key, fx.AS_OF, fx.EPOCH_START) for key in PERIOD_KEYS)
FEE_TEST = f"event_contract = '{FEE_CONTRACT}' AND event_type = '{FEE_EVENT}'"


def _weekly_tx(src: OrderSources) -> DataFrame:
    """Native transactions per week, all history: ``b, n``."""
    return agg.distinct_per_bucket(src.native_tx(), TS, "tx_id", YEAR, "n", "b")


WEEKLY_TX = f"""
    WITH t AS (SELECT date_trunc('week', block_timestamp) AS b, count(DISTINCT tx_id) AS n
               FROM native_tx GROUP BY 1)"""

DAILY_STAKE = """
    SELECT CAST(block_timestamp AS DATE) AS date, CAST(sum(amount) AS DOUBLE) AS v
    FROM staking_actions WHERE action IN {} GROUP BY 1"""


def _daily_stake(src: OrderSources, actions: tuple[str, ...], alias: str) -> DataFrame:
    return (
        src.staking_actions()
        .where(F.col("action").isin(*actions))
        .groupBy(fn.trunc_date(TS, "day").alias("date"))
        .agg(F.sum("amount").alias(alias))
    )


# ---- sources -------------------------------------------------------------------------


@check(
    "scan_native_tx",
    "SELECT tx_id, block_timestamp, array_to_string(authorizers, ',') AS authorizers FROM native_tx",
)
def scan_native_tx(src: OrderSources) -> DataFrame:
    return src.native_tx().select("tx_id", TS, F.array_join("authorizers", ",").alias("authorizers"))


@check(
    "scan_evm_tx",
    """SELECT tx_hash, block_timestamp, from_address, CAST(tx_fee AS DOUBLE) AS tx_fee,
              origin_function_signature FROM evm_tx""",
)
def scan_evm_tx(src: OrderSources) -> DataFrame:
    return src.evm_tx().drop(PARTITION_DATE)


@check("scan_native_events", "SELECT * FROM native_events")
def scan_native_events(src: OrderSources) -> DataFrame:
    return src.native_events().drop(PARTITION_DATE)


@check(
    "scan_evm_logs",
    "SELECT tx_hash, contract_address, array_to_string(topics, ',') AS topics FROM evm_logs",
)
def scan_evm_logs(src: OrderSources) -> DataFrame:
    return src.evm_logs().withColumn("topics", F.array_join("topics", ","))


@check(
    "scan_native_actors",
    "SELECT tx_id, block_timestamp, array_to_string(actors, ',') AS actors FROM native_actors",
)
def scan_native_actors(src: OrderSources) -> DataFrame:
    return src.native_actors().select("tx_id", TS, F.array_join("actors", ",").alias("actors"))


@check(
    "scan_staking",
    "SELECT block_timestamp, action, CAST(amount AS DOUBLE) AS amount FROM staking_actions",
)
def scan_staking(src: OrderSources) -> DataFrame:
    return src.staking_actions()


@check("market_points", "SELECT date, price, market_cap, volume FROM market")
def market(src: OrderSources) -> DataFrame:
    return market_points(src.market_payload())


@check("tvl_points", "SELECT date, protocol_locked FROM tvl")
def tvl(src: OrderSources) -> DataFrame:
    return tvl_points(src.tvl_payload())


@check(
    "week_calendar",
    f"""
    WITH w AS (
      SELECT CAST(range AS INT) AS weeks_ago,
             CAST(date_trunc('week', {_day(fx.AS_OF)}) AS DATE) AS monday
      FROM range({WEEK_TABLE_WEEKS})),
    d AS (SELECT weeks_ago, monday - 7 * (weeks_ago + 1) AS start_date,
                 monday - 7 * weeks_ago AS end_date FROM w)
    SELECT d.weeks_ago, d.start_date, d.end_date,
           strftime(d.start_date, '%Y-%m-%d') || ' to ' || strftime(d.end_date - 1, '%Y-%m-%d')
             AS date_range,
           count(t.tx_id) AS transactions
    FROM d LEFT JOIN native_tx t
      ON t.block_timestamp >= d.start_date AND t.block_timestamp < d.end_date
    GROUP BY ALL""",
)
def week_calendar(src: OrderSources) -> DataFrame:
    """The calendar with the transactions of each week; only its weeks are read."""
    last = monday_of(fx.AS_OF)
    rows = between(src.native_tx(), TS, last - timedelta(weeks=WEEK_TABLE_WEEKS), last)
    per_week = rows.groupBy(fn.trunc_date(TS, "week").alias("start_date")).agg(
        F.count("tx_id").alias("transactions")
    )
    calendar = weeks.week_calendar(src.spark, fx.AS_OF)
    return calendar.join(per_week, "start_date", "left").fillna(0, subset=["transactions"])


def _period_row_sql(p: Period) -> str:
    return f"""
    SELECT '{p.key}' AS period_key, '{p.grain}' AS grain, {_day(p.start)} AS start_date,
           {_day(p.cutoff)} AS cutoff_date, count(*) AS transactions
    FROM native_tx
    WHERE block_timestamp >= {_day(p.start)} AND block_timestamp < {_day(p.cutoff)}"""


@check("period_bounds", " UNION ALL ".join(_period_row_sql(p) for p in PERIODS))
def period_bounds(src: OrderSources) -> DataFrame:
    """Bounds of each period and the transactions inside, from one scan."""

    def inside(p: Period) -> Column:
        return (F.col(TS) >= F.lit(p.start)) & (F.col(TS) < F.lit(p.cutoff))

    counts = src.native_tx().agg(*[F.count_if(inside(p)).alias(p.key) for p in PERIODS])
    bounds = [
        F.struct(
            F.lit(p.key).alias("period_key"),
            F.lit(p.grain).alias("grain"),
            F.lit(p.start).alias("start_date"),
            F.lit(p.cutoff).alias("cutoff_date"),
            F.col(p.key).alias("transactions"),
        )
        for p in PERIODS
    ]
    return counts.select(F.inline(F.array(*bounds)))


@check("csv_sink", tx_by_type_sql(ALL))
def csv_sink(src: OrderSources) -> DataFrame:
    """A metric written as CSV and read back."""
    path = f"{shared_folder(src.spark, local_fallback=True)}/csv/tx_by_type"
    rows = transactions.tx_by_type(src, ALL)
    write_csv(rows, path)
    return src.spark.read.schema(rows.schema).option("header", True).csv(path)


@check("metric_store", tx_by_type_sql(ALL))
def metric_store(src: OrderSources) -> DataFrame:
    """A metric computed into the store and read back."""
    name = src.folder.rsplit("/", 1)[-1]
    store = MetricStore(f"{shared_folder(src.spark, local_fallback=True)}/store/{name}")
    return store.refresh("tx_by_type", src, ALL)


# ---- filters and projections ---------------------------------------------------------


@check(
    "filter_period",
    f"SELECT tx_id, block_timestamp FROM native_tx WHERE block_timestamp >= {_day(YEAR.start)}",
)
def filter_period(src: OrderSources) -> DataFrame:
    return in_period(src.native_tx(), TS, YEAR).select("tx_id", TS)


@check(
    "filter_completed",
    f"""SELECT tx_hash, date_trunc('week', block_timestamp) AS week FROM evm_tx
        WHERE block_timestamp >= {_day(YEAR.start)}
          AND date_trunc('week', block_timestamp) < {_day(YEAR.cutoff)}""",
)
def filter_completed(src: OrderSources) -> DataFrame:
    rows = in_complete_buckets(src.evm_tx(), TS, YEAR)
    return rows.select("tx_hash", YEAR.bucket(TS).alias("week"))


@check(
    "filter_until_today",
    f"""SELECT tx_id, block_timestamp, block_timestamp < {_day(fx.AS_OF)} AS is_before
        FROM native_actors WHERE block_timestamp <= {_day(fx.AS_OF)}""",
)
def filter_until_today(src: OrderSources) -> DataFrame:
    rows = between(src.native_actors(), TS, upper=fx.AS_OF, include_upper=True)
    return rows.select("tx_id", TS, (F.col(TS) < F.lit(fx.AS_OF)).alias("is_before"))


@check(
    "filter_week_cutoff",
    f"""SELECT date_trunc('month', block_timestamp) AS day, count(*) AS n FROM native_events
        GROUP BY 1 HAVING day < date_trunc('week', {_day(fx.AS_OF)})""",
)
def filter_week_cutoff(src: OrderSources) -> DataFrame:
    rows = between(src.native_events(), TS, upper=ALL.ceiling(ALL.this_week))
    return rows.groupBy(ALL.bucket(TS).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@check("filter_event", f"SELECT tx_id, block_timestamp FROM native_events WHERE {FEE_TEST}")
def filter_event(src: OrderSources) -> DataFrame:
    return (
        src.native_events()
        .where((F.col("event_contract") == FEE_CONTRACT) & (F.col("event_type") == FEE_EVENT))
        .select("tx_id", TS)
    )


@check(
    "filter_in_list",
    f"""SELECT block_timestamp, action, CAST(amount AS DOUBLE) AS amount FROM staking_actions
        WHERE action IN {COMMIT_ACTIONS}""",
)
def filter_in_list(src: OrderSources) -> DataFrame:
    return src.staking_actions().where(F.col("action").isin(*COMMIT_ACTIONS))


@check(
    "filter_topic_ilike",
    f"SELECT tx_hash, contract_address FROM evm_logs y WHERE {TOPIC_MATCH.format('y')}",
)
def filter_topic_ilike(src: OrderSources) -> DataFrame:
    return src.evm_logs().where(has_topic("topics")).select("tx_hash", "contract_address")


@check(
    "classify_coa_eoa",
    """SELECT CASE WHEN from_address LIKE '0x0000000000000000000000020000000000000000%' THEN 'COA'
                   WHEN from_address NOT LIKE '0x0000000000000000000000020000000000000000%'
                   THEN 'EOA' END AS kind,
              count(*) AS n, count(DISTINCT from_address) AS addresses
       FROM evm_tx GROUP BY 1""",
)
def classify_coa_eoa(src: OrderSources) -> DataFrame:
    owned = is_coa("from_address")
    kind = F.when(owned, "COA").when(~owned, "EOA").alias("kind")
    return src.evm_tx().groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("from_address").alias("addresses")
    )


@check(
    "case_when",
    f"""SELECT CASE WHEN action IN {COMMIT_ACTIONS} THEN 'commit'
                    WHEN action IN {WITHDRAW_ACTIONS} THEN 'withdraw' ELSE 'other' END AS direction,
               count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
        FROM staking_actions GROUP BY 1""",
)
def case_when(src: OrderSources) -> DataFrame:
    direction = (
        F.when(F.col("action").isin(*COMMIT_ACTIONS), "commit")
        .when(F.col("action").isin(*WITHDRAW_ACTIONS), "withdraw")
        .otherwise("other")
    )
    return src.staking_actions().groupBy(direction.alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )


@check(
    "bucket_then_filter",
    f"""WITH t AS (SELECT tx_id, date_trunc('month', block_timestamp) AS time_stamp FROM native_tx)
        SELECT tx_id, time_stamp FROM t WHERE time_stamp < {_day(ALL.cutoff)}""",
)
def bucket_then_filter(src: OrderSources) -> DataFrame:
    bucketed = src.native_tx().select("tx_id", ALL.bucket(TS).alias("time_stamp"))
    return completed(bucketed, "time_stamp", ALL)


# ---- joins ---------------------------------------------------------------------------


@check(
    "join_tx_events",
    """SELECT t.tx_id, t.block_timestamp AS tx_time, e.event_type, e.block_timestamp AS event_time
       FROM native_tx t JOIN native_events e ON t.tx_id = e.tx_id""",
)
def join_tx_events(src: OrderSources) -> DataFrame:
    tx = src.native_tx().select("tx_id", F.col(TS).alias("tx_time"))
    events = src.native_events().select("tx_id", "event_type", F.col(TS).alias("event_time"))
    return tx.join(events, "tx_id")


@check(
    "join_tx_logs",
    f"""SELECT t.tx_hash, t.block_timestamp, t.from_address, y.contract_address
        FROM evm_tx t JOIN evm_logs y ON t.tx_hash = y.tx_hash
        WHERE {TOPIC_MATCH.format("y")}""",
)
def join_tx_logs(src: OrderSources) -> DataFrame:
    tx = src.evm_tx().select("tx_hash", TS, "from_address")
    return tx.join(deploys.topic_logs(src), "tx_hash")


@check(
    "join_series_inner",
    """WITH n AS (SELECT CAST(block_timestamp AS DATE) AS date, count(*) AS native FROM native_tx
                  GROUP BY 1),
            e AS (SELECT CAST(block_timestamp AS DATE) AS date, count(*) AS evm FROM evm_tx
                  GROUP BY 1)
       SELECT n.date, native, evm, price FROM n JOIN e ON n.date = e.date
       JOIN market m ON m.date = n.date""",
)
def join_series_inner(src: OrderSources) -> DataFrame:
    def daily(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy(fn.trunc_date(TS, "day").alias("date")).agg(
            F.count(F.lit(1)).alias(alias)
        )

    prices = market_points(src.market_payload()).select("date", "price")
    return joins.join_aligned(daily(src.native_tx(), "native"), daily(src.evm_tx(), "evm"), prices)


@check(
    "join_left",
    f"""WITH s AS ({DAILY_STAKE.format(COMMIT_ACTIONS)}),
             u AS ({DAILY_STAKE.format(WITHDRAW_ACTIONS)})
        SELECT s.date, s.v AS staked, u.v AS unstaked FROM s LEFT JOIN u ON s.date = u.date""",
)
def join_left(src: OrderSources) -> DataFrame:
    staked = _daily_stake(src, COMMIT_ACTIONS, "staked")
    return staked.join(_daily_stake(src, WITHDRAW_ACTIONS, "unstaked"), "date", "left")


@check(
    "join_full_fill",
    f"""WITH s AS (SELECT CAST(block_timestamp AS DATE) AS date, count(*) AS n FROM staking_actions
                   WHERE action IN {COMMIT_ACTIONS} GROUP BY 1),
             u AS (SELECT CAST(block_timestamp AS DATE) AS date, count(*) AS n FROM staking_actions
                   WHERE action IN {WITHDRAW_ACTIONS} GROUP BY 1)
        SELECT coalesce(s.date, u.date) AS date, coalesce(s.n, 0) AS commits,
               coalesce(u.n, 0) AS withdraws
        FROM s FULL JOIN u ON s.date = u.date""",
)
def join_full_fill(src: OrderSources) -> DataFrame:
    def daily(actions: tuple[str, ...], alias: str) -> DataFrame:
        rows = src.staking_actions().where(F.col("action").isin(*actions))
        return rows.groupBy(fn.trunc_date(TS, "day").alias("date")).agg(
            F.count(F.lit(1)).alias(alias)
        )

    return joins.full_outer_fill(
        daily(COMMIT_ACTIONS, "commits"), daily(WITHDRAW_ACTIONS, "withdraws"), "date"
    )


def _range_weeks_sql(as_of: date) -> str:
    return f"""
    WITH w AS (
      SELECT CAST(range AS INT) AS weeks_ago,
             CAST(date_trunc('week', {_day(as_of)}) AS DATE) - 7 * CAST(range AS INT) AS hi
      FROM range({WEEK_TABLE_WEEKS})),
    f AS (SELECT actor, min(block_timestamp) AS t
          FROM (SELECT block_timestamp, unnest(actors) AS actor FROM native_actors) GROUP BY actor)
    SELECT w.weeks_ago, w.hi - 7 AS start_date, count(DISTINCT f.actor) AS new_accounts
    FROM w LEFT JOIN f ON f.t >= w.hi - 7 AND f.t < w.hi
    GROUP BY ALL"""


def _range_weeks(src: OrderSources, as_of: date) -> DataFrame:
    firsts = src.first_seen("native_address", monday_of(as_of))
    counts = weeks.weekly_debuts(firsts, "address", as_of, WEEK_TABLE_WEEKS, "new_accounts")
    calendar = weeks.week_calendar(src.spark, as_of).select("weeks_ago", "start_date")
    return calendar.join(counts, "start_date", "left").fillna(0, subset=["new_accounts"])


@check("join_range_weeks", _range_weeks_sql(fx.EARLY_AS_OF))
def join_range_weeks(src: OrderSources) -> DataFrame:
    return _range_weeks(src, fx.EARLY_AS_OF)


@check("join_range_weeks__late", _range_weeks_sql(fx.AS_OF))
def join_range_weeks_late(src: OrderSources) -> DataFrame:
    return _range_weeks(src, fx.AS_OF)


@check(
    "join_cross_kpi",
    """SELECT * FROM (SELECT count(DISTINCT tx_id) AS transactions FROM native_tx)
       CROSS JOIN (SELECT count(DISTINCT from_address) AS evm_senders FROM evm_tx)
       CROSS JOIN (SELECT CAST(sum(amount) AS DOUBLE) AS moved FROM staking_actions)""",
)
def join_cross_kpi(src: OrderSources) -> DataFrame:
    return joins.combine_one_row(
        agg.count_distinct(src.native_tx(), "tx_id", "transactions"),
        agg.count_distinct(src.evm_tx(), "from_address", "evm_senders"),
        src.staking_actions().agg(F.sum("amount").alias("moved")),
    )


@check(
    "join_anti_not_in",
    f"""SELECT x.tx_hash, x.from_address FROM evm_tx x
        WHERE x.origin_function_signature IN {SIGNATURES} AND x.tx_hash NOT IN (
          SELECT i.tx_hash FROM evm_tx i JOIN evm_logs y ON i.tx_hash = y.tx_hash
          WHERE {TOPIC_MATCH.format("y")})""",
)
def join_anti_not_in(src: OrderSources) -> DataFrame:
    signed = F.col("origin_function_signature").isin(*INIT_SIGNATURES)
    by_signature = src.evm_tx().where(signed & F.col("tx_hash").isNotNull())
    return by_signature.join(deploys.topic_transactions(src), "tx_hash", "left_anti").select(
        "tx_hash", "from_address"
    )


@check(
    "scalar_subquery",
    """SELECT tx_hash, CAST(tx_fee AS DOUBLE) AS tx_fee,
              (SELECT count(*) FROM native_tx) AS native_rows
       FROM evm_tx WHERE block_timestamp >= (
         SELECT min(block_timestamp) FROM native_events WHERE event_type = 'AccountContractAdded')""",
)
def scalar_subquery(src: OrderSources) -> DataFrame:
    added = src.native_events().where(F.col("event_type") == "AccountContractAdded")
    bound = added.agg(F.min(TS)).scalar()
    native_rows = src.native_tx().agg(F.count(F.lit(1))).scalar()
    rows = src.evm_tx().where(F.col(TS) >= bound)
    return rows.select("tx_hash", "tx_fee", native_rows.alias("native_rows"))


@check(
    "explode_actors",
    "SELECT block_timestamp, unnest(actors) AS address FROM native_actors",
)
def exploded(src: OrderSources) -> DataFrame:
    return explode_actors(src.native_actors())


# ---- aggregates ----------------------------------------------------------------------


@check("agg_distinct_global", "SELECT count(DISTINCT from_address) AS senders FROM evm_tx")
def agg_distinct_global(src: OrderSources) -> DataFrame:
    return agg.count_distinct(src.evm_tx(), "from_address", "senders")


@check(
    "agg_distinct_bucket",
    f"""SELECT date_trunc('week', block_timestamp) AS time_stamp, origin_function_signature,
               count(DISTINCT from_address) AS senders
        FROM evm_tx GROUP BY 1, 2""",
)
def agg_distinct_bucket(src: OrderSources) -> DataFrame:
    return agg.distinct_per_bucket(
        src.evm_tx(), TS, "from_address", YEAR, "senders",
        by=("origin_function_signature",),
    )


@check(
    "agg_distinct_conditional",
    """SELECT date_trunc('month', block_timestamp) AS time_stamp,
              count(DISTINCT CASE WHEN event_type = 'AccountContractAdded' THEN event_contract
                                  ELSE tx_id END) AS ids,
              count(DISTINCT CASE WHEN event_type = 'AccountContractAdded' THEN tx_id END) AS adding,
              count(DISTINCT CASE WHEN event_type <> 'AccountContractAdded' THEN tx_id END) AS other
       FROM native_events GROUP BY 1""",
)
def agg_distinct_conditional(src: OrderSources) -> DataFrame:
    """Conditional distinct counts from rows made distinct once, without expanding them."""
    added = F.col("event_type") == "AccountContractAdded"
    ids = src.native_events().select(
        ALL.bucket(TS).alias("time_stamp"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("id").alias("role"),
                    F.when(added, F.col("event_contract")).otherwise(F.col("tx_id")).alias("id"),
                ),
                F.struct(
                    F.when(added, "adding").otherwise("other").alias("role"),
                    F.col("tx_id").alias("id"),
                ),
            )
        ),
    )
    return ids.distinct().groupBy("time_stamp").agg(
        *[
            F.count(F.when(F.col("role") == role, F.col("id"))).alias(name)
            for role, name in (("id", "ids"), ("adding", "adding"), ("other", "other"))
        ]
    )


@check(
    "agg_sum_avg",
    """SELECT date_trunc('month', block_timestamp) AS month, CAST(sum(tx_fee) AS DOUBLE) AS fees,
              avg(tx_fee) AS avg_fee FROM evm_tx GROUP BY 1""",
)
def agg_sum_avg(src: OrderSources) -> DataFrame:
    total = F.sum("tx_fee")
    return src.evm_tx().groupBy(ALL.bucket(TS).alias("month")).agg(
        total.alias("fees"), (total.cast("double") / F.count("tx_fee")).alias("avg_fee")
    )


@check(
    "agg_count_if",
    """SELECT date_trunc('week', block_timestamp) AS week,
              CAST(sum(CASE WHEN event_type = 'FeesDeducted' THEN 1 ELSE 0 END) AS BIGINT) AS fee_events,
              CAST(sum(CASE WHEN event_type = 'FeesDeducted' THEN 0 ELSE 1 END) AS BIGINT) AS others
       FROM native_events GROUP BY 1""",
)
def agg_count_if(src: OrderSources) -> DataFrame:
    fee = F.col("event_type") == FEE_EVENT
    return src.native_events().groupBy(YEAR.bucket(TS).alias("week")).agg(
        F.count_if(fee).alias("fee_events"), F.count_if(~fee).alias("others")
    )


@check("agg_count_rows", "SELECT event_type, count(*) AS n FROM native_events GROUP BY 1")
def agg_count_rows(src: OrderSources) -> DataFrame:
    return src.native_events().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "agg_first_seen",
    """SELECT event_contract, min(block_timestamp) AS first_seen FROM native_events GROUP BY 1""",
)
def agg_first_seen(src: OrderSources) -> DataFrame:
    return agg.first_seen(src.native_events(), "event_contract", TS)


@check(
    "agg_any_flag",
    f"""SELECT contract_address, max(CASE WHEN {TOPIC_MATCH.format("y")} THEN 1 ELSE 0 END) = 1
                 AS ever_deployed
        FROM evm_logs y GROUP BY 1""",
)
def agg_any_flag(src: OrderSources) -> DataFrame:
    deployed = F.coalesce(has_topic("topics"), F.lit(False))
    return src.evm_logs().groupBy("contract_address").agg(F.bool_or(deployed).alias("ever_deployed"))


@check(
    "agg_max_per_date",
    """SELECT CAST(block_timestamp AS DATE) AS date, CAST(max(tx_fee) AS DOUBLE) AS tx_fee
       FROM evm_tx GROUP BY 1""",
)
def agg_max_per_date(src: OrderSources) -> DataFrame:
    dated = src.evm_tx().select(fn.trunc_date(TS, "day").alias("date"), "tx_fee")
    return agg.max_per_date(dated, "date", "tx_fee")


def _pivot_sql() -> str:
    names = ["last_full_week", *[f"week_ago_{n}" for n in range(1, WEEK_TABLE_WEEKS)]]
    measures = {"n": "transactions", "c": "senders"}
    parts = [
        f"SELECT '{label}' AS measure, "
        + ", ".join(
            f"max(CASE WHEN weeks_ago = {i} THEN CAST({col} AS VARCHAR) END) AS {name}"
            for i, name in enumerate(names)
        )
        + " FROM per_week"
        for col, label in measures.items()
    ]
    monday = f"CAST(date_trunc('week', {_day(fx.AS_OF)}) AS DATE)"
    return f"""
    WITH per_week AS (
      SELECT CAST(floor(({monday} - CAST(block_timestamp AS DATE) - 1) / 7) AS INT) AS weeks_ago,
             count(*) AS n, count(DISTINCT from_address) AS c
      FROM evm_tx WHERE block_timestamp < {monday} GROUP BY 1)
    {" UNION ALL ".join(parts)}"""


@check("agg_pivot_weeks", _pivot_sql())
def agg_pivot_weeks(src: OrderSources) -> DataFrame:
    this_monday = ALL.this_week
    days_back = F.datediff(F.lit(this_monday), F.to_date(TS)) - 1
    per_week = (
        between(src.evm_tx(), TS, this_monday - timedelta(weeks=WEEK_TABLE_WEEKS), this_monday)
        .groupBy(F.floor(days_back / 7).cast("int").alias("weeks_ago"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.countDistinct("from_address").alias("senders"),
        )
    )
    labels = {"transactions": "transactions", "senders": "senders"}
    return agg.week_pivot(per_week, labels, row_name="measure")


@check(
    "agg_two_level",
    """WITH per_chain AS (
         SELECT date_trunc('month', block_timestamp) AS m, count(DISTINCT authorizers[1]) AS n,
                CAST(count(*) AS DOUBLE) AS c FROM native_tx GROUP BY 1
         UNION ALL
         SELECT date_trunc('month', block_timestamp), count(DISTINCT from_address), count(*)
         FROM evm_tx GROUP BY 1)
       SELECT m AS month, CAST(sum(n) AS BIGINT) AS accounts, avg(c) AS mean_rows
       FROM per_chain GROUP BY m""",
)
def agg_two_level(src: OrderSources) -> DataFrame:
    def per_chain(df: DataFrame, account: Column) -> DataFrame:
        return df.groupBy(ALL.bucket(TS).alias("month")).agg(
            F.countDistinct(account).alias("n"), F.count(F.lit(1)).alias("c")
        )

    native = per_chain(src.native_tx(), fn.first_element("authorizers"))
    evm = per_chain(src.evm_tx(), F.col("from_address"))
    return native.unionByName(evm).groupBy("month").agg(
        F.sum("n").alias("accounts"), F.avg("c").alias("mean_rows")
    )


@check(
    "agg_distinct_rows",
    """SELECT DISTINCT event_contract, date_trunc('month', block_timestamp) AS month
       FROM native_events""",
)
def agg_distinct_rows(src: OrderSources) -> DataFrame:
    return src.native_events().select("event_contract", ALL.bucket(TS).alias("month")).distinct()


@check(
    "agg_type_total",
    f"""WITH t AS (
          SELECT date_trunc('month', block_timestamp) AS day, '{NATIVE_LABEL}' AS type,
                 count(*) AS n FROM native_tx GROUP BY 1
          UNION ALL
          SELECT date_trunc('month', block_timestamp), '{EVM_LABEL}', count(*) FROM evm_tx GROUP BY 1)
        SELECT day, type, n FROM t
        UNION ALL
        SELECT day, '{BOTH_LABEL}', CAST(sum(n) AS BIGINT) FROM t GROUP BY day""",
)
def agg_type_total(src: OrderSources) -> DataFrame:
    return agg.with_total(_monthly_by_type(src), "day", "type", "n")


def _monthly_by_type(src: OrderSources) -> DataFrame:
    def monthly(df: DataFrame, label: str) -> DataFrame:
        counts = df.groupBy(ALL.bucket(TS).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("day", F.lit(label).alias("type"), "n")

    return monthly(src.native_tx(), NATIVE_LABEL).unionByName(monthly(src.evm_tx(), EVM_LABEL))


@check(
    "agg_then_window",
    f"""SELECT CAST(block_timestamp AS DATE) AS date, CAST(sum(tx_fee) AS DOUBLE) AS fees,
               CAST(sum(sum(tx_fee)) OVER (ORDER BY CAST(block_timestamp AS DATE)) AS DOUBLE) AS total_fees,
               CAST(sum(sum(tx_fee)) OVER (ORDER BY CAST(block_timestamp AS DATE) {ROLL}) AS DOUBLE)
                 / count(sum(tx_fee)) OVER (ORDER BY CAST(block_timestamp AS DATE) {ROLL})
                 AS rolling_avg
        FROM evm_tx GROUP BY 1""",
)
def agg_then_window(src: OrderSources) -> DataFrame:
    daily = src.evm_tx().groupBy(fn.trunc_date(TS, "day").alias("date")).agg(
        F.sum("tx_fee").alias("fees")
    )
    return daily.select(
        "date",
        "fees",
        windows.cumulative("fees", "date").alias("total_fees"),
        windows.rolling_mean("fees", "date").alias("rolling_avg"),
    )


# ---- windows -------------------------------------------------------------------------


@check("win_lag", f"{WEEKLY_TX} SELECT b, n, lag(n) OVER (ORDER BY b) AS prev FROM t")
def win_lag(src: OrderSources) -> DataFrame:
    return _weekly_tx(src).withColumn("prev", windows.prev("n", "b"))


@check(
    "win_cumulative",
    f"""WITH t AS (
          SELECT date_trunc('month', block_timestamp) AS day, '{NATIVE_LABEL}' AS type,
                 count(*) AS n FROM native_tx GROUP BY 1
          UNION ALL
          SELECT date_trunc('month', block_timestamp), '{EVM_LABEL}', count(*) FROM evm_tx GROUP BY 1)
        SELECT day, type, CAST(sum(n) OVER (PARTITION BY type ORDER BY day) AS BIGINT) AS per_type,
               CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS both_types FROM t""",
)
def win_cumulative(src: OrderSources) -> DataFrame:
    """Per type, and over all rows: the two types of a month share one total."""
    return _monthly_by_type(src).select(
        "day",
        "type",
        windows.cumulative("n", "day", by=("type",)).alias("per_type"),
        windows.cumulative("n", "day").alias("both_types"),
    )


@check(
    "win_rolling4",
    f"{WEEKLY_TX} SELECT b, n, avg(n) OVER (ORDER BY b {ROLL}) AS rolling_avg FROM t",
)
def win_rolling4(src: OrderSources) -> DataFrame:
    return _weekly_tx(src).withColumn("rolling_avg", windows.rolling_mean("n", "b"))


@check(
    "win_row_number_first",
    """WITH numbered AS (
         SELECT from_address AS address, date_trunc('month', block_timestamp) AS first_month,
                row_number() OVER (PARTITION BY from_address
                                   ORDER BY date_trunc('month', block_timestamp)) AS rn
         FROM evm_tx)
       SELECT address, first_month FROM numbered WHERE rn = 1""",
)
def win_row_number_first(src: OrderSources) -> DataFrame:
    return agg.first_bucket(senders(src.evm_tx()), "address", TS, ALL, "first_month")


@check(
    "win_pct_change",
    f"""{WEEKLY_TX}
    SELECT b, (n - lag(n) OVER (ORDER BY b)) / nullif(lag(n) OVER (ORDER BY b), 0) * 100 AS pct,
           coalesce((n - lag(n) OVER (ORDER BY b)) / nullif(lag(n) OVER (ORDER BY b), 0) * 100, 0)
             AS pct_or_zero,
           CAST(round((n - lag(n) OVER (ORDER BY b)) / nullif(lag(n) OVER (ORDER BY b), 0) * 100, 2)
                AS DECIMAL(18, 2))::VARCHAR AS pct_text
    FROM t""",
)
def win_pct_change(src: OrderSources) -> DataFrame:
    pct = windows.pct_change(F.col("n"), windows.prev("n", "b"))
    return _weekly_tx(src).select(
        "b",
        pct.alias("pct"),
        F.coalesce(pct, F.lit(0.0)).alias("pct_or_zero"),
        F.round(pct, 2).cast("decimal(18,2)").cast("string").alias("pct_text"),
    )


@check(
    "win_ma_pct_change",
    """WITH t AS (SELECT CAST(block_timestamp AS DATE) AS d, count(*) AS n FROM native_tx GROUP BY 1),
            m AS (SELECT d, avg(n) OVER (ORDER BY d ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS ma
                  FROM t),
            l AS (SELECT d, ma, lag(ma, 14) OVER (ORDER BY d) AS ma_lag FROM m)
       SELECT d AS date, ma, ma_lag, (ma - ma_lag) / ma_lag * 100 AS pct FROM l""",
)
def win_ma_pct_change(src: OrderSources) -> DataFrame:
    daily = src.native_tx().groupBy(fn.trunc_date(TS, "day").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    mean, lagged, pct = windows.ma_pct_change("n", "date")
    return daily.select("date", mean.alias("ma"), lagged.alias("ma_lag"), pct.alias("pct"))


# ---- sorts and sets ------------------------------------------------------------------


@check("sort_desc", f"{WEEKLY_TX} SELECT b, n FROM t ORDER BY b DESC")
def sort_desc(src: OrderSources) -> DataFrame:
    return _weekly_tx(src).orderBy(F.desc("b"))


MONTHLY_BY_TYPE = f"""
    SELECT date_trunc('month', block_timestamp) AS day, '{NATIVE_LABEL}' AS type, count(*) AS n
    FROM native_tx GROUP BY 1
    UNION ALL
    SELECT date_trunc('month', block_timestamp), '{EVM_LABEL}', count(*) FROM evm_tx GROUP BY 1"""


@check("sort_multi", f"SELECT * FROM ({MONTHLY_BY_TYPE}) ORDER BY day DESC, type")
def sort_multi(src: OrderSources) -> DataFrame:
    return _monthly_by_type(src).orderBy(F.desc("day"), "type")


@check("sort_asc", f"{WEEKLY_TX} SELECT b, n FROM t ORDER BY b")
def sort_asc(src: OrderSources) -> DataFrame:
    return _weekly_tx(src).orderBy("b")


@check(
    "top1_latest",
    f"{WEEKLY_TX} SELECT b, n FROM t WHERE b < {_day(YEAR.this_week)} ORDER BY b DESC LIMIT 1",
)
def top1_latest(src: OrderSources) -> DataFrame:
    return latest_before(_weekly_tx(src), "b", YEAR.this_week)


@check(
    "union_all",
    """SELECT tx_id AS id, block_timestamp FROM native_tx
       UNION ALL SELECT tx_hash, block_timestamp FROM evm_tx""",
)
def union_all(src: OrderSources) -> DataFrame:
    parts = [
        src.native_tx().select(F.col("tx_id").alias("id"), TS),
        src.evm_tx().select(F.col("tx_hash").alias("id"), TS),
    ]
    return reduce(DataFrame.unionByName, parts)


@check(
    "union_distinct",
    """SELECT from_address AS address, date_trunc('month', block_timestamp) AS month FROM evm_tx
       UNION
       SELECT authorizers[1], date_trunc('month', block_timestamp) FROM native_tx
       WHERE len(authorizers) > 0""",
)
def union_distinct(src: OrderSources) -> DataFrame:
    evm = senders(src.evm_tx())
    native = src.native_tx().select(TS, F.explode("authorizers").alias("address"))
    both = evm.unionByName(native)
    return both.select("address", ALL.bucket(TS).alias("month")).distinct()


# ---- scalar functions ----------------------------------------------------------------


@check(
    "fn_date_trunc",
    """SELECT tx_id, date_trunc('month', block_timestamp) AS month,
              date_trunc('week', block_timestamp) AS week, date_trunc('day', block_timestamp) AS day,
              date_trunc('hour', block_timestamp) AS hour FROM native_tx""",
    EventSources,
)
def fn_date_trunc(src: OrderSources) -> DataFrame:
    return src.native_tx().select(
        "tx_id",
        ALL.bucket(TS).alias("month"),
        YEAR.bucket(TS).alias("week"),
        MONTH.bucket(TS).alias("day"),
        HOURS.bucket(TS).alias("hour"),
    )


@check(
    "fn_trunc_date",
    """SELECT tx_hash, CAST(date_trunc('week', block_timestamp) AS DATE) AS week,
              CAST(block_timestamp AS DATE) AS day FROM evm_tx""",
)
def fn_trunc_date(src: OrderSources) -> DataFrame:
    return src.evm_tx().select(
        "tx_hash", fn.trunc_date(TS, "week").alias("week"), fn.trunc_date(TS, "day").alias("day")
    )


@check(
    "fn_epoch_to_date",
    """SELECT tx_id, CAST(block_timestamp AS DATE) AS from_millis,
              CAST(block_timestamp AS DATE) AS from_seconds FROM native_tx""",
    EventSources,
)
def fn_epoch_to_date(src: OrderSources) -> DataFrame:
    """Epoch numbers of each transaction, turned back into its day."""
    second = F.unix_date(F.to_date(TS)).cast("bigint") * fn.DAY_SECONDS + (
        F.hour(TS) * 3600 + F.minute(TS) * 60 + F.floor(F.second(TS))
    )
    return src.native_tx().select(
        "tx_id",
        fn.epoch_millis_to_date(second.cast("double") * 1000).alias("from_millis"),
        fn.epoch_seconds_to_date(second).alias("from_seconds"),
    )


@check(
    "fn_week_label",
    """SELECT tx_id, strftime(date_trunc('week', block_timestamp), '%Y-%m-%d') || ' to ' ||
              strftime(date_trunc('week', block_timestamp) + INTERVAL 6 DAY, '%Y-%m-%d') AS label
       FROM native_tx""",
)
def fn_week_label(src: OrderSources) -> DataFrame:
    start = fn.monday(F.to_date(TS))
    label = fn.date_range_label(start, F.date_add(start, 6))
    return src.native_tx().select("tx_id", label.alias("label"))


@check(
    "fn_concat_diff",
    f"""{WEEKLY_TX}
    SELECT b, n || ' (' || coalesce(n - lag(n) OVER (ORDER BY b), 0) || ')' AS label FROM t""",
)
def fn_concat_diff(src: OrderSources) -> DataFrame:
    return _weekly_tx(src).select(
        "b", fn.diff_label(F.col("n"), windows.prev("n", "b")).alias("label")
    )


@check(
    "fn_coalesce",
    """SELECT tx_id, coalesce(authorizers[1], 'none') AS deployer FROM native_tx""",
)
def fn_coalesce(src: OrderSources) -> DataFrame:
    deployer = F.coalesce(fn.first_element("authorizers"), F.lit("none"))
    return src.native_tx().select("tx_id", deployer.alias("deployer"))


@check(
    "fn_safe_divide",
    """SELECT event_id, CAST(value AS DOUBLE) / nullif(user_id % 2, 0) AS ratio FROM events""",
)
def fn_safe_divide(src: OrderSources) -> DataFrame:
    ratio = fn.safe_divide(F.col("value"), F.col("user_id") % 2)
    return src.table("events").select("event_id", ratio.alias("ratio"))


@check(
    "fn_greatest_null",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size <> 10 THEN p_retailprice - 100.0 * p_size END
                    AS v FROM part)
       SELECT p_partkey, CASE WHEN v IS NOT NULL THEN greatest(v, 0) END AS floored FROM t""",
)
def fn_greatest_null(src: OrderSources) -> DataFrame:
    value = F.when(
        F.col("p_size") != 10, F.col("p_retailprice") - F.lit(100.0) * F.col("p_size")
    )
    return src.table("part").select("p_partkey", fn.floor_at_zero(value).alias("floored"))


@check(
    "fn_casts",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text,
              CAST(o_orderdate AS DATE) AS day, CAST(o_custkey AS DOUBLE) AS number,
              CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price_text,
              CAST(strftime(o_orderdate, '%d') AS INT) AS day_number
       FROM orders""",
)
def fn_casts(src: OrderSources) -> DataFrame:
    return src.table("orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_custkey").cast("double").alias("number"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "dd").cast("int").alias("day_number"),
    )


@check(
    "fn_arith",
    """SELECT l_returnflag, count(*) + count(DISTINCT l_suppkey) AS added,
              count(*) - count(DISTINCT l_suppkey) AS gap,
              count(*) / count(DISTINCT l_suppkey) AS ratio, count(*) * 2 AS doubled
       FROM lineitem GROUP BY 1""",
)
def fn_arith(src: OrderSources) -> DataFrame:
    counts = src.table("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s")
    )
    n, s = F.col("n"), F.col("s")
    return counts.select(
        "l_returnflag",
        (n + s).alias("added"),
        (n - s).alias("gap"),
        (n / s).alias("ratio"),
        (n * 2).alias("doubled"),
    )


@check(
    "fn_array_get",
    """SELECT tx_id, actors[1] AS first_actor, actors[3] AS third_actor FROM native_actors""",
)
def fn_array_get(src: OrderSources) -> DataFrame:
    return src.native_actors().select(
        "tx_id",
        fn.first_element("actors").alias("first_actor"),
        F.get("actors", 2).alias("third_actor"),
    )


@check(
    "fn_json_path",
    """SELECT tx_id, block_timestamp,
              CAST(CAST(json_extract_string(event_data, '$.amount') AS DECIMAL(18, 2)) AS DOUBLE)
                AS from_text,
              CAST(CAST(json_extract_string(event_data, '$.amount') AS DECIMAL(18, 2)) AS DOUBLE)
                AS from_variant
       FROM native_events""",
)
def fn_json_path(src: OrderSources) -> DataFrame:
    """The amount inside the event, read from JSON text and from a parsed variant."""
    events = src.native_events().withColumn("parsed", F.parse_json("event_data"))
    return events.select(
        "tx_id",
        TS,
        fn.json_decimal(events, "event_data", "$.amount", NATIVE_AMOUNT).alias("from_text"),
        fn.json_decimal(events, "parsed", "$.amount", NATIVE_AMOUNT).alias("from_variant"),
    )


@check(
    "agg_distinct_sketch",
    """SELECT date_trunc('month', block_timestamp) AS month, count(DISTINCT from_address) AS senders,
              true AS close
       FROM evm_tx GROUP BY 1""",
)
def agg_distinct_sketch(src: OrderSources) -> DataFrame:
    """Senders per month, exactly, and whether merged daily sketches come within 2 %."""
    exact = src.grain_counts("evm_active", "month", None, None)
    daily = src.daily_sketches("evm_active", None, None)
    close = sketches.approx_distinct_per_bucket(daily, ALL).withColumnRenamed("n", "about")
    far = F.abs(F.col("about") - F.col("n")) > 0.02 * F.col("n")
    return exact.join(close, "bucket").select(
        F.col("bucket").alias("month"), F.col("n").alias("senders"), (~far).alias("close")
    )


@check(
    "kept_series",
    f"""WITH a AS ({tx_by_type_sql(ALL)}), b AS ({active_accounts_series_sql(ALL)}),
             c AS ({accounts_created_series_sql(ALL)})
        SELECT period AS bucket, 'transactions ' || type AS series, transactions AS n FROM a
        UNION ALL SELECT day, 'active ' || type, active_users FROM b
        UNION ALL SELECT day, 'new', daily_new_accounts FROM c""",
)
def kept_series(src: OrderSources) -> DataFrame:
    """Series over kept buckets, after two steps that take in most of the history."""
    root = f"{shared_folder(src.spark, local_fallback=True)}/kept"
    kept = PreparedSources(src, root).advance(date(1997, 2, 11)).advance(date(2001, 6, 20))
    active = accounts.active_accounts_series(kept, ALL)
    new = accounts.accounts_created_series(kept, ALL)
    return reduce(
        DataFrame.unionByName,
        [
            transactions.tx_by_type(kept, ALL).select(
                F.col("period").alias("bucket"), F.concat(F.lit("transactions "), "type").alias("series"),
                F.col("transactions").alias("n"),
            ),
            active.select(
                F.col("day").alias("bucket"), F.concat(F.lit("active "), "type").alias("series"),
                F.col("active_users").alias("n"),
            ),
            new.select(
                F.col("day").alias("bucket"), F.lit("new").alias("series"),
                F.col("daily_new_accounts").alias("n"),
            ),
        ],
    )


def _in_buckets(src: OrderSources) -> BucketedSources:
    """A copy in which transactions of more than four rows in a table count as hot."""
    path = f"{shared_folder(src.spark, local_fallback=True)}/buckets"
    buckets = int(src.spark.conf.get("spark.sql.shuffle.partitions"))
    return land_buckets(src, f"copy_{uuid.uuid4().hex}", path, buckets, hot_rows=4)


@check("join_tx_events_buckets", fees_series_sql(ALL))
def join_tx_events_buckets(src: OrderSources) -> DataFrame:
    """Fees per bucket of time, from transactions and events kept in buckets by transaction."""
    return fees.fees_series(_in_buckets(src), ALL)


@check("join_tx_logs_buckets", contracts_by_chain_sql(ALL))
def join_tx_logs_buckets(src: OrderSources) -> DataFrame:
    """Contracts per chain, from transactions and logs kept in buckets by transaction."""
    return contracts.contracts_by_chain(_in_buckets(src), ALL)


def _spelled_amounts(src: OrderSources) -> DataFrame:
    """Amounts of all lines in the spellings that JSON has; lines 5 to 7 cannot be read."""
    line = F.col("l_linenumber")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    cents = (money * 100).cast("long").cast("string")
    spelled = (
        F.when(line == 1, F.concat(F.lit('"'), money.cast("string"), F.lit('"')))
        .when(line == 2, money.cast("string"))
        .when(line == 3, F.concat(cents, F.lit("e-2")))
        .when(line == 4, F.concat(F.lit('" '), money.cast("string"), F.lit("0000000000000000E+0 \"")))
        .when(line == 5, F.concat(money.cast("string"), F.lit("000000000000001")))
        .when(line == 6, F.concat(F.lit('"'), money.cast("string"), F.lit(' FLOW"')))
        .otherwise(F.concat(cents, F.lit("e-20")))
    )
    amount = F.concat(F.lit('{"amount":'), spelled, F.lit("}"))
    return src.table("lineitem").select("l_returnflag", amount.alias("event_data"))


@check(
    "fn_json_rejects",
    """SELECT l_returnflag, count(*) AS amounts,
              count(*) FILTER (l_linenumber > 4) AS rejected,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FILTER (l_linenumber <= 4) AS DOUBLE)
                AS total
       FROM lineitem GROUP BY 1""",
)
def fn_json_rejects(src: OrderSources) -> DataFrame:
    """Amounts in any spelling: what can be read is summed, what cannot is counted."""
    events = _spelled_amounts(src)
    texts = events.select("l_returnflag", fn.json_text(events, "event_data", "$.amount").alias("text"))
    text = F.col("text")
    return texts.groupBy("l_returnflag").agg(
        F.count("text").alias("amounts"),
        F.count_if(fn.unreadable(text, NATIVE_AMOUNT)).alias("rejected"),
        F.sum(fn.exact_decimal(text, NATIVE_AMOUNT, strict=False)).alias("total"),
    )
