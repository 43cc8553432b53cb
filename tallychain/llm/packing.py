"""Best-fit packing of documents into sequences, after dominance reduction.

A document's ids (with the end id) are one piece, or pieces of exactly `CAPACITY` ids and a rest
if it is longer.  Packing only sees lengths, and there are at most `CAPACITY` of them: the
instance is a histogram, whatever the number of documents.

`plan` works on that histogram.  First the reduction of Martello and Toth: a set of pieces F
with a piece j dominates all other sets with j if each of them can be split into parts that fit
under pieces of F one by one; then a sequence that holds exactly F is part of some best packing
and is fixed for good.  Sets of up to three pieces are tried, for as many sequences at
once as the counts allow, until nothing changes.  The rest is packed by best-fit decreasing, again
for whole runs of equal sequences at once.

The plan is a list of segments "pieces number a to b of length l go to sequences s, s+1, ... at
offset o".  Pieces get their number within their length from counts per task, so a length that
holds a third of all pieces is numbered in parallel.

Defined results: NULL and empty texts are a single end id; repeated rows and ties are pieces of
their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import arrow_schema, batch_of, table, tidied, values, written
from tallychain.llm.tokens import documents_ids, encoder, little_endian, public_path

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"


# --- the plan, over a histogram of lengths -------------------------------------------------


class Stock:
    """Counts by length, with the lookups that the reduction needs."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64).copy()

    def largest(self, limit: int) -> int:
        """Largest length in stock that is at most ``limit``; 0 if there is none."""
        if limit <= 0:
            return 0
        there = np.flatnonzero(self.counts[: limit + 1])
        return int(there[-1]) if len(there) else 0

    def smallest_sum(self, k: int) -> int:
        """Sum of the ``k`` smallest pieces; beyond all bounds if there are fewer."""
        total = 0
        for length in np.flatnonzero(self.counts):
            take = min(k, int(self.counts[length]))
            total, k = total + take * int(length), k - take
            if not k:
                return total
        return 1 << 40

    def pairs(self, limit: int) -> list[tuple[int, int]]:
        """(x, y), x >= y: for each x, the largest y in stock that fits beside it."""
        there = np.flatnonzero(self.counts[: max(limit, 0) + 1])
        if not len(there):
            return []
        at = np.searchsorted(there, np.minimum(limit - there, there), side="right") - 1
        out = []
        for x, k in zip(there.tolist(), at.tolist(), strict=True):
            # One piece cannot be taken twice.
            while k >= 0 and there[k] == x and self.counts[x] < 2:
                k -= 1
            if k >= 0:
                out.append((x, int(there[k])))
        return out


def dominating(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with piece ``j`` that dominates all sets with it; this ``j`` is out of stock."""
    room = capacity - j
    k = stock.largest(room)
    if not k:
        return (j,)
    # Whatever stands beside j sums to at most `room`: one piece of that size covers it.
    if k == room:
        return (j, k)
    # Only one piece fits beside j, and k is the largest.
    if stock.smallest_sum(2) > room:
        return (j, k)
    if stock.smallest_sum(3) <= room:
        return None  # four pieces and more are not examined
    # At most two pieces fit beside j.
    pairs = stock.pairs(room)
    if k >= max(x + y for x, y in pairs):
        return (j, k)
    y = dict(pairs).get(k)
    if y is None:
        return None
    # Singles lie under k; a pair lies under (k, y) piece by piece or under k as a whole.
    if all(b <= y or a + b <= k for a, b in pairs):
        return (j, k, y)
    return None


def reduce(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fixed sets with their multiplicities, and the counts that are left."""
    stock, fixed, changed = Stock(counts), [], True
    while changed:
        changed = False
        for j in np.flatnonzero(stock.counts)[::-1].tolist():
            while stock.counts[j]:
                stock.counts[j] -= 1
                found = dominating(stock, j, capacity)
                stock.counts[j] += 1
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                # The same set stays dominating while its pieces last: the stock only shrinks.
                times = min(int(stock.counts[x]) // n for x, n in need.items())
                for x, n in need.items():
                    stock.counts[x] -= times * n
                fixed.append((found, times))
                changed = True
    return fixed, stock.counts


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Segments (length, first, number, sequence, offset) for a histogram of lengths.

    A segment sends pieces ``first`` .. ``first + number - 1`` of its length to as many
    consecutive sequences, at one offset.
    """
    fixed, left = reduce(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    segments, next_sequence = [], 0

    def place(length: int, number: int, sequence: int, offset: int) -> None:
        segments.append((length, int(used[length]), number, sequence, offset))
        used[length] += number

    for pieces, times in fixed:
        offset = 0
        for length in pieces:
            place(length, times, next_sequence, offset)
            offset += length
        next_sequence += times
    # Best fit, longest pieces first; open sequences in runs of equal room.
    runs: dict[int, list[tuple[int, int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        number = int(left[length])
        while number:
            room = min((r for r in runs if r >= length), default=None)
            if room is None:
                # New sequences take as many of these pieces as fit, one sequence the rest.
                per = capacity // length
                for size, each in ((number // per, per), (1, number % per)):
                    if size and each:
                        for k in range(each):
                            place(length, size, next_sequence, k * length)
                        if capacity - each * length:
                            runs.setdefault(capacity - each * length, []).append(
                                (next_sequence, size)
                            )
                        next_sequence += size
                break
            first, size = runs[room].pop()
            take = min(size, number)
            place(length, take, first, capacity - room)
            if room > length:
                runs.setdefault(room - length, []).append((first, take))
            if take < size:
                runs[room].append((first + take, size - take))
            if not runs[room]:
                del runs[room]
            number -= take
    columns = np.array(segments, np.int64).reshape(-1, 5)
    order = np.lexsort((columns[:, 1], columns[:, 0]))
    names = ("length", "first", "number", "sequence", "offset")
    return {n: columns[order, k] for k, n in enumerate(names)}


def placed(segments: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple:
    """Sequence and offset of pieces given by length and number within the length."""
    span = int(max(rank.max(initial=0), segments["first"].max(initial=0))) + 1
    at = np.searchsorted(
        segments["length"] * span + segments["first"], length * span + rank, side="right"
    )
    at -= 1
    return segments["sequence"][at] + rank - segments["first"][at], segments["offset"][at]


# --- Spark ---------------------------------------------------------------------------------


def pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    keep_ids: bool = False,
    keep_words: bool = True,
) -> DataFrame:
    """Pieces of every row of ``docs``: key, piece, start, length, ids_crc32, with ids on request.

    ``task`` and ``rank`` number the pieces of a length within each task.  With ``keep_words`` a
    Python worker remembers words for its next task, without it the memory is free again.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, "
    schema += "piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema += ", ids binary" if keep_ids else ""
    target = arrow_schema(schema)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        try:
            for batch in batches:
                rows = []
                texts = zip(*map(values, batch.columns), strict=True)
                for doc_id, ids in documents_ids(texts, vocabulary, keeps_spaces=False):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        data = little_endian(ids[start : start + capacity])
                        n = len(data) // 4
                        row = (doc_id, piece, start, n, zlib.crc32(data), task, int(counts[n]))
                        rows.append((*row, data) if keep_ids else row)
                        counts[n] += 1
                yield batch_of(rows, target)
        finally:
            if not keep_words:
                encoder(vocabulary, False).forget()

    return docs.select(key, "text").mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (written pieces) with sequence_id and offset instead of task and rank.

    What reaches the driver is at most ``capacity`` counts; the segments that return to the
    tasks depend on the lengths alone.
    """
    by_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per length and task: a length in all texts has as many rows as there are tasks.
    first = by_task.select(
        F.col("length").alias("l"),
        F.col("task").alias("t"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    segments = plan(counts, capacity)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = placed(segments, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    rest = [c for c in found.columns if c not in ("task", "rank")]
    same = (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))
    at = place(F.col("length"), F.col("rank") + F.col("before"))
    return (
        found.join(first, same, "left")
        .select(*rest, at.alias("place"))
        .select(*rest, "place.sequence_id", "place.offset")
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    keep_ids: bool = False,
    keep_words: bool = True,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    vocabulary = vocabulary or public_path(VOCABULARY)
    found = written(pieces(docs, vocabulary, capacity, key, keep_ids, keep_words), "pieces")
    return pack(found, capacity)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
