"""How five filters interact, in every order: a walk over filter subsets in Gray-code order.

Each document fails some subset of the filters; documents with one subset form a cell of their
part, so a part has at most 32 cells.  The walk visits all 32 sets of active filters and toggles
one filter at a time.  Each cell has a counter of the active filters that it fails: a cell whose
counter leaves 0 leaves the running survivors, one whose counter comes back to 0 joins them again.
The survivors of the 32 states are stored, and every figure of every order is a difference of
two states.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals (A-Z) > 5 * code
points; D a character of ``#$%&*|``; E text identical to that of a smaller key, in the whole table.

Texts are read once and travel as digests (SHA-256 with the length).  Copies are counted per
(text, part, labels) by partial aggregates before they meet the smallest key of their text, so a
large group of copies is a few rows by then.

Defined results: a NULL text reads as empty (it fails A only, and E if a smaller key has an empty
text too), a NULL source as ''.  Rows that share a key are each counted; none makes the other fail E.  A
row without key has no label and never fails E, nor makes another row fail it.  A key labelled more
than once is good if any of its labels says so, and toxic likewise.  An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import arrow_schema, map_rows, table, written

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
ORDERS = tuple(permutations(range(len(FILTERS))))
MEASURES = ("n", "good", "toxic")
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: str) -> int:
    """The filters that a text fails by itself, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    failed = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(data) - len(data.translate(None, CAPITALS))) > 5 * len(text),
        len(data) != len(data.translate(None, MARKS)),
    )
    return sum(1 << k for k, fails in enumerate(failed) if fails)


def digest(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return sha256(data).digest() + len(data).to_bytes(8, "big")


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters in mask."""
    judged = map_rows(
        docs.select(
            F.col(key), F.coalesce("source", F.lit("")).alias("part"),
            F.coalesce("text", F.lit("")).alias("text"),
        ),
        f"k {docs.schema[key].dataType.simpleString()}, part string, text binary, mask int",
        lambda k, part, text: (k, part, digest(text), own_failures(text)),
    )
    # Repeated rows are one row from here on, and different texts of one key are spread.
    rows = judged.groupBy("k", "text", "part", "mask").agg(F.count(F.lit(1)).alias("copies"))
    # Read several times below: as a table, or the texts would be read and judged as often.
    rows = written(rows, "filter-rows")
    marks = labels.groupBy(F.col(key).alias("k")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    known = rows.where("k IS NOT NULL").join(marks, "k", "left").fillna(False, ["good", "toxic"])
    groups = known.groupBy("text", "part", "mask", "good", "toxic").agg(
        F.sum("copies").alias("n"), F.min("k").alias("lowest"), F.min_by("copies", "k").alias("least")
    )
    first = groups.groupBy("text").agg(F.min("lowest").alias("first"))
    originals = F.when(F.col("lowest") == F.col("first"), F.col("least")).otherwise(0)
    split = groups.join(first, "text").select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), originals.alias("n")),
            F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - originals).alias("n")),
        )),
    )
    unknown = rows.where("k IS NULL").select(
        "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask",
        F.col("copies").alias("n"),
    )
    return (
        split.unionByName(unknown)
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every set of active filters, from ``counts`` (parts, cells, measures)."""
    masks = np.arange(STATES)
    failing = np.zeros(STATES, np.int64)
    survivors = counts.sum(axis=1)
    states = np.empty_like(counts)
    active = 0
    states[:, active] = survivors
    for step in range(1, STATES):
        bit = step & -step
        touched = (masks & bit) != 0
        if active & bit:
            failing[touched] -= 1
            survivors = survivors + counts[:, touched & (failing == 0)].sum(axis=1)
        else:
            survivors = survivors - counts[:, touched & (failing == 0)].sum(axis=1)
            failing[touched] += 1
        active ^= bit
        states[:, active] = survivors
    return states


def order_figures(states: np.ndarray) -> dict[str, np.ndarray]:
    """Per part, order and step (flattened): the report's figures, all from stored states."""
    filters = np.array(ORDERS).ravel()
    after = np.cumsum(1 << np.array(ORDERS), axis=1).ravel()
    bits = 1 << filters
    before = after - bits
    lost = states[:, before] - states[:, after]
    removed = lost[:, :, 0]
    alone = states[:, :1, 0] - states[:, bits, 0]
    shapley = np.stack([removed[:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": states[:, after, 0],
        "removed": removed,
        "redundant": alone - removed,
        "unique_fails": states[:, STATES - 1 - bits, 0] - states[:, STATES - 1 :, 0],
        "good_lost": lost[:, :, 1],
        "toxic_lost": lost[:, :, 2],
        "shapley": shapley[:, filters],
    }


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step."""
    per_part = cells(docs, labels, key).groupBy("part").agg(
        F.collect_list(F.struct("mask", *MEASURES)).alias("cells")
    )
    target = arrow_schema(REPORT)
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS for _ in order]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, listed in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                counts = np.zeros((1, STATES, len(MEASURES)), np.int64)
                for cell in listed:
                    counts[0, cell["mask"]] = [cell[m] for m in MEASURES]
                figures = order_figures(walk(counts))
                columns = [pa.array([part] * len(names)), pa.array(names), pa.array(steps)]
                columns += [pa.array(v[0]) for v in figures.values()]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return per_part.mapInArrow(run, REPORT)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM l a, l b, l c, l e, l f
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, o, step
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, o[step] AS f, n, good, toxic,
    fails[o[step]] AS failed, len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) AS n_failed
  FROM cells, steps),
summed AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
