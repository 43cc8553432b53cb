"""Values that a lenient run could not read, counted while it runs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Rejects:
    """How many values of a table were read and rejected, with the most frequent rejected ones.

    Hand one to a metric; it fills with the first action on the metric's frame, in the same pass.
    Until then the properties wait.  One object serves one frame.
    """

    SAMPLES = 5

    def __init__(self, table: str = "native_events") -> None:
        self.table = table
        # One for each part of the table.
        self._observed: list[Observation] = []

    def watch(self, df: DataFrame, text: Column, bad: Column) -> DataFrame:
        """``df``, counting the rows that have a ``text`` and those whose text is ``bad``."""
        self._observed.append(Observation())
        return df.observe(
            self._observed[-1],
            F.count(text).alias("read"),
            F.count_if(bad).alias("rejected"),
            F.call_function(
                "approx_top_k", F.when(bad, text), F.lit(self.SAMPLES + 1)
            ).alias("samples"),
        )

    @property
    def read(self) -> int:
        return sum(o.get["read"] for o in self._observed)

    @property
    def rejected(self) -> int:
        return sum(o.get["rejected"] for o in self._observed)

    @property
    def samples(self) -> list[str]:
        """Up to `SAMPLES` rejected values, frequent ones first."""
        found = Counter()
        for o in self._observed:
            for x in o.get["samples"] or []:
                if x["item"] is not None:
                    found[x["item"]] += x["count"]
        return [item for item, _ in found.most_common(self.SAMPLES)]
