"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0 to n - 1 in the order of their key (then of their text's checksums).  A
permutation of these numbers gives every row a place; place p lies in shard p mod k at slot
p div k, so the counts of shards are at most one apart (law ``rows``), slots have no gaps, and
both can be computed from a row number alone, as can the row number from shard and slot.

The permutation is a Feistel network over a x b >= n numbers, a = ceil(sqrt(n)) and b = ceil(n / a):
x is split into x mod a and x div a, and each round adds a hash of one half to the other, modulo
that half's size.  Fewer than a numbers lie beyond n; a row that lands there is sent through the
network again until it lands inside (cycle walking).  How many such steps can be needed is not
guessed: the numbers beyond n are themselves sent through the network, and the few that stay
beyond n (about one; always fewer than a) are chained on the driver.

Row numbers come from a sort by range whose parts are counted; only keys and checksums are
sorted, not texts, and equal rows are spread by where they were read, so that no key is hot.
Everything is DataFrame functions.

Defined results: a NULL text has size 8 and checksum 0, like an empty one.  A NULL key sorts first
and is a key like any other.  Repeated rows each get a place of their own.  An empty table gives
no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import table, written

SHARDS = 24
ROUNDS = 6
SEED = 1
#: Rows that a file of `write_shards` holds.
FILE_ROWS = 1_000_000
#: Bits of a monotonically increasing id that number the rows of a partition.
ID_BITS = 33


def div(a: Column, b: int) -> Column:
    """Integer division."""
    return F.call_function("div", a, F.lit(b).cast("long"))


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 ... rows - 1, as column expressions."""

    spark: SparkSession
    rows: int
    seed: int = SEED

    @cached_property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.rows, 1) - 1) + 1)

    @cached_property
    def b(self) -> int:
        return max(1, -(-self.rows // self.a))

    def _hash(self, k: int, half: Column) -> Column:
        size = self.a if k % 2 == 0 else self.b
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(k), half), F.lit(size).cast("long"))

    def once(self, x: Column) -> Column:
        """The network over all a * b numbers."""
        left, right = x % F.lit(self.a).cast("long"), div(x, self.a)
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + self._hash(k, right)) % F.lit(self.a).cast("long")
            else:
                right = (right + self._hash(k, left)) % F.lit(self.b).cast("long")
        return right * self.a + left

    def back(self, y: Column) -> Column:
        """The inverse of `once`."""
        left, right = y % F.lit(self.a).cast("long"), div(y, self.a)
        for k in reversed(range(ROUNDS)):
            if k % 2 == 0:
                left = F.pmod(left - self._hash(k, right), F.lit(self.a).cast("long"))
            else:
                right = F.pmod(right - self._hash(k, left), F.lit(self.b).cast("long"))
        return right * self.a + left

    @cached_property
    def walks(self) -> int:
        """The most further steps that a number inside can need to come back inside."""
        beyond = self.spark.range(self.rows, self.a * self.b)
        if self.rows == self.a * self.b:
            return 0
        to = self.once(F.col("id"))
        links = dict(beyond.select("id", to.alias("to")).where(F.col("to") >= self.rows).collect())
        return 1 + max((chain(links, x) for x in links), default=0)

    def _walked(self, step, x: Column) -> Column:
        first = step(x)
        if not self.walks:
            return first
        again = F.array(*[F.lit(0)] * self.walks)
        return F.aggregate(
            again, first, lambda y, _: F.when(y < self.rows, y).otherwise(step(y))
        )

    def place(self, row: Column) -> Column:
        return self._walked(self.once, row)

    def row(self, place: Column) -> Column:
        return self._walked(self.back, place)


def chain(links: dict[int, int], x: int) -> int:
    """Links from ``x`` to the end of its chain; 0 for a ring, which nothing inside leads to."""
    n, start = 0, x
    while x in links:
        x, n = links[x], n + 1
        if x == start or n > len(links):
            return 0
    return n


def numbered(docs: DataFrame, key: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``key, size, text_crc32, row`` (and ``carried``, a struct of ``carry``), and how many rows."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    kept = [F.struct(*carry).alias("carried")] if carry else []
    read = docs.select(
        F.col(key).alias("k"),
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h"),
        # Rows equal so far are told apart by where they were read: no value is hot in the sort.
        F.monotonically_increasing_id().alias("at"),
        *kept,
    )
    read = written(read, "shard-rows")
    ordered = read.orderBy("k", "crc", "size", "h", "at").select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"),
        *[c for c in ("carried",) if carry], F.monotonically_increasing_id().alias("id"),
    )
    ordered = written(ordered, "shard-order")
    part = F.shiftright("id", ID_BITS)
    # One row per task of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.col("id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    rows = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return rows.withColumn("row", F.col("start") + inside).drop("part", "start", "id"), total


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, row (and ``carried``)."""
    rows, total = numbered(docs, key, carry)
    place = Permutation(docs.sparkSession, total, seed).place(F.col("row"))
    return rows.withColumn("place", place).select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
        *[c for c in ("carried",) if carry],
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", seed: int = SEED,
    file_rows: int = FILE_ROWS,
) -> None:
    """The rows of ``docs``, shuffled: folder ``shard=<n>``, by slot inside its files.

    A shard is cut into files of ``file_rows`` slots, so no task holds a whole shard.  The columns
    of ``docs`` lie in the struct ``carried``, which no name can clash with.
    """
    rows = assign(docs, shards, key, seed, tuple(docs.columns)).select("shard", "slot", "carried")
    dealt = rows.repartition("shard", div(F.col("slot"), file_rows))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign(table(spark, folder, "documents"))
