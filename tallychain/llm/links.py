"""Connected components of a link table, by contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b).

    Each round sends every node to its smallest neighbour, follows these pointers to their ends,
    and keeps only the links between different ends.  All steps are joins and partial minima, so
    a node with very many links is no single task's work.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.min("b").alias("m"))
        up = written(up.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
        while True:
            jump = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = up.join(jump, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")
            )
            jumped = written(jumped, "parents")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = up if labels is None else written(_moved(labels, up), "labels")
        ends = up.select(F.col("node").alias("n"), F.col("root").alias("r"))
        edges = (
            edges.join(ends, F.col("a") == F.col("n")).select(F.col("r").alias("a"), "b")
            .join(ends, F.col("b") == F.col("n")).select("a", F.col("r").alias("b"))
        )
        edges = written(edges.where("a <> b").distinct(), "links")
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels.select("node", F.col("root").alias("component"))


def _moved(labels: DataFrame, up: DataFrame) -> DataFrame:
    new = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(new, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
