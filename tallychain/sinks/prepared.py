"""Sources with kept intermediate tables, for runs that repeat day by day.

Some results look at all history however short their period is, and a series counts every day of
its period.  Small kept tables spare them most of it:

* the logs that carry the deploy topic, a thin slice of all logs;
* the first time each key was seen, up to a day: later runs read only the days since, and each
  advance writes only the keys that are new;
* per kind of key, how many first appeared on each day;
* distinct counts of buckets that are over, per grain;
* one mergeable sketch of distinct values per day.

Each :meth:`PreparedSources.advance` is a step: it writes a folder of its own and then its entry in the
list of steps, which names all steps before it.  A state reads the folders of its own steps only.
So a step that breaks off, or one that is abandoned because another one was made from the same
state, is never seen by anyone else.

The results are those of the base sources as long as no row arrives for a day that was
already taken in.  After such a late arrival, start over with a new root.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.operators.aggregates import first_seen
from tallychain.operators.filters import PARTITION_DATE, between
from tallychain.period import Period, grain_ceiling, grain_floor
from tallychain.sources.tables import BUCKET_KEYS, DISTINCT_KEYS, FIRST_SEEN_KEYS, Sources

#: Grains whose buckets are kept; hours are only ever asked for one day.
KEPT_GRAINS = ("month", "week", "day")
#: Kinds of first appearances that are also counted by day.
COUNTED = ("account",)


@dataclass(frozen=True)
class Step:
    name: str
    upto: date


class PreparedSources(Sources):
    """``base`` with tables under ``root`` that take in all days before ``upto``.

    Without ``upto`` nothing is taken in.  With it, the state is that of a complete step up to that
    day, as :meth:`advance` has left it under ``root``.
    """

    def __init__(self, base: Sources, root: str, upto: date | None = None) -> None:
        self.spark = base.spark
        self.base = base
        self.root = root.rstrip("/")
        self.upto = upto
        self.steps: tuple[Step, ...] = () if upto is None else self._steps_to(upto)

    def _after(self, steps: tuple[Step, ...]) -> PreparedSources:
        state = PreparedSources(self.base, self.root)
        state.steps, state.upto = steps, steps[-1].upto
        return state

    @property
    def _list(self) -> str:
        return f"{self.root}/steps"

    def _steps_to(self, upto: date) -> tuple[Step, ...]:
        ends = self.spark.read.parquet(self._list).where(F.col("upto") == F.lit(upto))
        # Several states up to one day hold the same rows.
        found = ends.orderBy(F.size("steps"), "step").first()
        if found is None:
            raise ValueError(f"no complete step up to {upto} under {self.root}")
        return tuple(Step(s.name, s.upto) for s in found.steps)

    def version(self) -> str | None:
        return self.base.version()

    def native_tx(self) -> DataFrame:
        return self.base.native_tx()

    def evm_tx(self) -> DataFrame:
        return self.base.evm_tx()

    def native_events(self) -> DataFrame:
        return self.base.native_events()

    def evm_logs(self) -> DataFrame:
        return self.base.evm_logs()

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

    # ---- steps ---------------------------------------------------------------------------

    def advance(self, upto: date) -> PreparedSources:
        """Take in the days from the current bound to ``upto``."""
        if self.upto is not None and upto <= self.upto:
            raise ValueError(f"already advanced to {self.upto}")
        step = Step(uuid.uuid4().hex, upto)
        folder = f"{self.root}/{step.name}"
        for name in FIRST_SEEN_KEYS:
            path = f"{folder}/first_seen/{name}"
            self._new_keys(name, upto).write.parquet(path)
            if name in COUNTED:
                new = self.spark.read.parquet(path)
                days = new.groupBy(F.to_date("first_seen").alias("day")).agg(
                    F.count(FIRST_SEEN_KEYS[name]).alias("n")
                )
                days.write.parquet(f"{folder}/debuts/{name}")
        self._write_buckets(folder, upto)
        for name in DISTINCT_KEYS:
            sketches = self.base.daily_sketches(name, self.upto, upto)
            sketches.write.parquet(f"{folder}/sketches/{name}")
        self._write_deploy_logs(step, upto)
        steps = (*self.steps, step)
        entry = self.spark.createDataFrame(
            [(step.name, upto, [(s.name, s.upto) for s in steps])],
            "step string, upto date, steps array<struct<name: string, upto: date>>",
        )
        entry.coalesce(1).write.mode("append").parquet(self._list)
        return self._after(steps)

    def _kept(self, table: str, like: DataFrame, steps: tuple[Step, ...] | None = None) -> DataFrame:
        """Rows of a kept table, from the folders of this state's steps."""
        folders = [f"{self.root}/{s.name}/{table}" for s in (self.steps if steps is None else steps)]
        if not folders:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(*folders)

    # ---- first appearances ---------------------------------------------------------------

    def _known(self, name: str) -> DataFrame:
        """``<key>, first_seen`` of all keys taken in up to the current bound."""
        return self._kept(f"first_seen/{name}", self.base.first_seen(name, self.upto))

    def _new_keys(self, name: str, upper: date | None) -> DataFrame:
        """Keys that appear from the current bound on and did not before."""
        if self.upto is None:
            return self.base.first_seen(name, upper)
        keys = FIRST_SEEN_KEYS[name]
        newer = first_seen(self.base.dated_keys(name, self.upto, upper), keys, "block_timestamp")
        known = self._known(name)
        # A NULL is a key like any other.
        same = [newer[k].eqNullSafe(known[k]) for k in ((keys,) if isinstance(keys, str) else keys)]
        return newer.join(known, reduce(Column.__and__, same), "left_anti")

    def first_seen(self, name: str, upper: date | None) -> DataFrame:
        if self.upto is None:
            return self.base.first_seen(name, upper)
        known = self._known(name)
        if upper is not None and upper <= self.upto:
            return known.where(F.col("first_seen") < F.lit(upper))
        return known.unionByName(self._new_keys(name, upper))

    def _debut_days(self, name: str) -> DataFrame:
        like = self.spark.createDataFrame([], "day date, n bigint")
        return self._kept(f"debuts/{name}", like)

    def debuts(self, name: str, period: Period) -> DataFrame:
        """Kept counts by day, and the keys of the days since.

        Only where the period starts no later than the first appearance of all: otherwise a key
        seen before it may be new *in* it, which kept counts cannot tell.
        """
        cutoff = period.cutoff
        if self.upto is None or name not in COUNTED or period.grain == "hour":
            return self.base.debuts(name, period)
        days = self._debut_days(name)
        first = days.agg(F.min("day")).first()[0]
        if first is None or first < period.start:
            return self.base.debuts(name, period)
        counts = days.where(F.col("day") < F.lit(cutoff))
        if cutoff > self.upto:
            newer = self._new_keys(name, cutoff).groupBy(F.to_date("first_seen").alias("day"))
            counts = counts.unionByName(newer.agg(F.count(FIRST_SEEN_KEYS[name]).alias("n")))
        return counts.groupBy(period.bucket("day").alias("bucket")).agg(F.sum("n").alias("n"))

    # ---- buckets that are over -----------------------------------------------------------

    def _write_buckets(self, folder: str, upto: date) -> None:
        for grain in KEPT_GRAINS:
            lower = self.upto and grain_floor(grain, self.upto)
            upper = grain_floor(grain, upto)
            if lower == upper:
                continue
            for name in BUCKET_KEYS:
                counts = self.base.grain_counts(name, grain, lower, upper)
                counts.write.parquet(f"{folder}/buckets/{grain}/{name}")

    def _bucket_steps(self, grain: str) -> tuple[Step, ...]:
        """The steps in which a bucket of this grain came to its end."""
        ends = [None, *(grain_floor(grain, s.upto) for s in self.steps)]
        return tuple(s for s, a, b in zip(self.steps, ends, ends[1:], strict=False) if a != b)

    def bucket_counts(
        self, name: str, period: Period, lower: date | None, upper: date | None
    ) -> DataFrame:
        """Whole buckets that are over from the kept counts, all others from the rows."""
        grain = period.grain
        if self.upto is None or grain not in KEPT_GRAINS or lower is None or upper is None:
            return self.base.bucket_counts(name, period, lower, upper)
        first = grain_ceiling(grain, lower)
        last = min(grain_floor(grain, self.upto), grain_floor(grain, upper))
        if first >= last:
            return self.base.bucket_counts(name, period, lower, upper)
        like = self.base.bucket_counts(name, period, lower, upper)
        kept = self._kept(f"buckets/{grain}/{name}", like, self._bucket_steps(grain))
        kept = kept.where((F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last)))
        parts = [kept]
        if lower < first:
            parts.append(self.base.bucket_counts(name, period, lower, first))
        if last < upper:
            parts.append(self.base.bucket_counts(name, period, last, upper))
        return reduce(DataFrame.unionByName, parts)

    # ---- sketches ------------------------------------------------------------------------

    def daily_sketches(self, name: str, lower: date | None, upper: date | None) -> DataFrame:
        """One sketch per day: kept for days that are taken in, from the rows for those since."""
        if self.upto is None:
            return self.base.daily_sketches(name, lower, upper)
        like = self.base.daily_sketches(name, lower, upper)
        kept = between(self._kept(f"sketches/{name}", like), "day", lower, upper)
        if upper is not None and upper <= self.upto:
            return kept
        newer = self.base.daily_sketches(name, max(lower or self.upto, self.upto), upper)
        return kept.unionByName(newer)

    # ---- deploy logs ---------------------------------------------------------------------

    @property
    def _deploy_logs(self) -> str:
        return f"{self.root}/deploy_logs"

    def _write_deploy_logs(self, step: Step, upto: date) -> None:
        logs = self.base.deploy_logs()
        if PARTITION_DATE not in logs.columns:
            return
        days = between(logs, PARTITION_DATE, self.upto, upto)
        days.hint("rebalance", F.col(PARTITION_DATE)).write.partitionBy(PARTITION_DATE).parquet(
            f"{self._deploy_logs}/step={step.name}"
        )

    def deploy_logs(self) -> DataFrame:
        """The kept topic logs, and those of the days since.

        Logs without day folders have no days to take in; they are filtered anew.
        """
        logs = self.base.deploy_logs()
        if self.upto is None or PARTITION_DATE not in logs.columns:
            return logs
        folders = [f"{self._deploy_logs}/step={s.name}" for s in self.steps]
        # Day folders below several steps: one table, of which only these steps are read.
        kept = self.spark.read.schema(logs.schema).option("basePath", self._deploy_logs)
        kept = kept.parquet(*folders).select(logs.columns)
        return kept.unionByName(between(logs, PARTITION_DATE, lower=self.upto))
