"""Where results go: CSV files and a store of computed metrics."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.metrics import METRICS
from tallychain.period import Period
from tallychain.sources.tables import Sources

#: What reading a folder raises that is not there or has no complete file yet.
NOT_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of UTF-8 CSV files with a header line and no index column."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_if_there(src: Sources, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if it has no complete file."""
    try:
        return src.spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in NOT_YET:
            raise
        return None


class MetricStore:
    """Computed metrics as Parquet, one folder per whole key and run.

    A result is a function of the metric, the period (key, day, start of history), the
    metric's options and the landed data; the first three are its key.  A refresh writes a folder
    of its own and then adds a mark with the next number; of all complete marks the highest
    counts.  No mark is ever overwritten or removed, so a reader finds the result before a refresh
    until the one after it is there, also when a refresh breaks off.

    A stored result stays until it is refreshed; with sources that tell their version (see
    ``Sources.version``), also only as long as that does not change.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _key(self, period: Period, options: dict) -> str:
        given = json.dumps(options, sort_keys=True, default=str) if options else "none"
        return (
            f"period_key={period.key}/as_of_day={period.as_of.isoformat()}"
            f"/epoch_start={period.epoch_start.isoformat()}/options={quote(given, safe='')}"
        )

    def path(self, metric: str, period: Period, **options) -> str:
        """Folder of all runs of one key."""
        return f"{self.root}/{metric}/results/{self._key(period, options)}"

    def _marks(self, metric: str, period: Period, options: dict) -> str:
        return f"{self.root}/{metric}/marks/{self._key(period, options)}"

    def _current(self, metric: str, src: Sources, period: Period, options: dict):
        """The mark that counts, or None."""
        marks = read_if_there(src, self._marks(metric, period, options))
        # Two refreshes at once may take one number; then the run decides, for all readers alike.
        return marks and marks.orderBy(F.desc("number"), F.desc("run")).first()

    def refresh(self, metric: str, src: Sources, period: Period, **options) -> DataFrame:
        """Compute and store the metric, and return the stored rows."""
        version = src.version()
        run = uuid.uuid4().hex
        path = f"{self.path(metric, period, **options)}/run={run}"
        METRICS[metric](src, period, **options).write.parquet(path)
        last = self._current(metric, src, period, options)
        mark = src.spark.range(1).select(
            F.lit(last.number + 1 if last else 1).cast("long").alias("number"),
            F.lit(run).alias("run"),
            F.lit(version).cast("string").alias("version"),
            F.lit(json.dumps(options, sort_keys=True, default=str)).alias("given"),
        )
        mark.coalesce(1).write.mode("append").parquet(self._marks(metric, period, options))
        return src.spark.read.parquet(path)

    def refresh_all(self, src: Sources, periods: list[Period]) -> None:
        """Compute and store every metric at every period, and every stored key of these periods
        once more with its options."""
        for period in periods:
            for metric in METRICS:
                for options in self._stored_options(metric, src, period):
                    self.refresh(metric, src, period, **options)

    def _stored_options(self, metric: str, src: Sources, period: Period) -> list[dict]:
        """No options, and all that were stored for this metric and period."""
        marks = read_if_there(src, f"{self.root}/{metric}/marks")
        found = []
        if marks is not None:
            same = (
                (F.col("period_key") == period.key)
                & (F.col("as_of_day").cast("date") == F.lit(period.as_of))
                & (F.col("epoch_start").cast("date") == F.lit(period.epoch_start))
            )
            found = [json.loads(r.given) for r in marks.where(same).select("given").distinct().collect()]
        return [{}, *[options for options in found if options]]

    def get(self, metric: str, src: Sources, period: Period, **options) -> DataFrame:
        """The stored rows; computed first if there are none or data has been landed since."""
        if metric not in METRICS:
            raise KeyError(metric)
        mark = self._current(metric, src, period, options)
        version = src.version()
        if mark is None or (version is not None and mark.version != version):
            return self.refresh(metric, src, period, **options)
        return src.spark.read.parquet(f"{self.path(metric, period, **options)}/run={mark.run}")

    def history(self, metric: str, src: Sources) -> DataFrame:
        """Every current result of a metric, with the columns of its key."""
        root = f"{self.root}/{metric}"
        key = ("period_key", "as_of_day", "epoch_start", "options")
        current = (
            src.spark.read.parquet(f"{root}/marks")
            .groupBy(*key)
            .agg(F.max(F.struct("number", "run"))["run"].alias("run"))
        )
        return src.spark.read.parquet(f"{root}/results").join(current.select("run"), "run", "left_semi")
