"""Tables kept in buckets by transaction: joins of rows with their transaction need no shuffle.

`land_buckets` copies the tables whose rows belong to transactions, each as two tables of the
session's catalog:

* ``<name>_<table>_buckets`` in buckets by transaction, one file a bucket, sorted by time where the
  rows have one, so the row groups outside a period are still skipped;
* ``<name>_<table>_plain`` without buckets.  It holds the transactions that have more than ``hot_rows``
  rows in some table, and the rows without a transaction.  One task reads a bucket, so no
  transaction that could fill one is kept there.

Both tables of a transaction are of the same kind.  So the copy has two parts that share no
transaction, and whatever is a matter of one transaction is computed part by part
(`Sources.parts`): in buckets without an exchange, on plain rows with the usual one, whose partial
aggregates make hot transactions small first.

A copy is made whole under a name of its own and never changed; days landed later need a new copy.
A table enters the catalog when its files are complete, and a copy that broke off cannot be opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.sources.schemas import SCHEMAS
from tallychain.sources.tables import Sources

#: Tables that are kept together, and the column that names their transaction.
GROUPS = {
    "tx_id": ("native_tx", "native_events"),
    "tx_hash": ("evm_tx", "evm_logs", "deploy_logs"),
}
KINDS = ("buckets", "plain")
#: Rows of one transaction in one table that a bucket may hold.
HOT_ROWS = 1_000_000
TIME = "block_timestamp"


def land_buckets(
    src: Sources, name: str, path: str, buckets: int, hot_rows: int = HOT_ROWS
) -> BucketedSources:
    """Copy the tables of transactions to ``path`` and the catalog, and return them as sources.

    ``buckets`` is the number of tasks that will read a table: rows of the largest table by the
    rows that one task should read.
    """
    root = path.rstrip("/")
    for key, tables in GROUPS.items():
        hot_path = f"{root}/hot_{key}"
        # At most rows / hot_rows keys a table, however many transactions there are.
        _hot_keys([_rows(src, t) for t in tables], key, hot_rows).write.parquet(hot_path)
        hot = src.spark.read.parquet(hot_path)
        for table in tables:
            rows = _rows(src, table)
            _save_buckets(rows, hot, key, buckets, f"{name}_{table}_buckets", f"{root}/{table}_buckets")
            apart = rows.join(hot, key, "left_semi").unionByName(rows.where(F.col(key).isNull()))
            target = apart.hint("rebalance").write.option("path", f"{root}/{table}_plain")
            target.format("parquet").saveAsTable(f"{name}_{table}_plain")
    return BucketedSources(src, name)


def _rows(src: Sources, table: str) -> DataFrame:
    columns = SCHEMAS["evm_logs" if table == "deploy_logs" else table].fieldNames()
    return getattr(src, table)().select(*columns)


def _hot_keys(tables: list[DataFrame], key: str, hot_rows: int) -> DataFrame:
    many = [t.groupBy(key).count().where(F.col("count") > hot_rows) for t in tables]
    keys = reduce(DataFrame.unionByName, [m.select(key) for m in many])
    return keys.where(F.col(key).isNotNull()).distinct()


def _save_buckets(
    rows: DataFrame, hot: DataFrame, key: str, buckets: int, name: str, path: str
) -> None:
    few = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti")
    # Shuffles and buckets hash alike: each task writes one bucket.
    writer = few.repartition(buckets, key).write.bucketBy(buckets, key)
    if TIME in rows.columns:
        writer = writer.sortBy(TIME)
    writer.option("path", path).format("parquet").saveAsTable(name)


class BucketedSources(Sources):
    """``base`` with the tables of transactions from a copy that `land_buckets` made."""

    def __init__(self, base: Sources, name: str, kinds: tuple[str, ...] = KINDS) -> None:
        self.spark = base.spark
        self.base = base
        self.name = name
        self.kinds = kinds
        wanted = [f"{name}_{t}_{k}" for tables in GROUPS.values() for t in tables for k in kinds]
        missing = [t for t in wanted if not self.spark.catalog.tableExists(t)]
        if missing:
            raise ValueError(f"no complete copy {name!r}: {missing[0]} is not in the catalog")

    def parts(self) -> list[Sources]:
        return [BucketedSources(self.base, self.name, (kind,)) for kind in self.kinds]

    def version(self) -> str | None:
        """A copy never changes."""
        return self.name

    def _table(self, table: str) -> DataFrame:
        tables = [self.spark.table(f"{self.name}_{table}_{kind}") for kind in self.kinds]
        return reduce(DataFrame.unionByName, tables)

    def native_tx(self) -> DataFrame:
        return self._table("native_tx")

    def evm_tx(self) -> DataFrame:
        return self._table("evm_tx")

    def native_events(self) -> DataFrame:
        return self._table("native_events")

    def evm_logs(self) -> DataFrame:
        return self._table("evm_logs")

    def deploy_logs(self) -> DataFrame:
        return self._table("deploy_logs")

    def native_actors(self) -> DataFrame:
        return self.base.native_actors()

    def staking_actions(self) -> DataFrame:
        return self.base.staking_actions()

    def market_payload(self) -> DataFrame:
        return self.base.market_payload()

    def tvl_payload(self) -> DataFrame:
        return self.base.tvl_payload()

    def market_series(self) -> DataFrame:
        return self.base.market_series()

    def tvl_values(self) -> DataFrame:
        return self.base.tvl_values()
