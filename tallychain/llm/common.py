"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares for checkpoints.

    Only a local session may lack that setting; it then gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, lost executors lose nothing."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame) -> int:
    """The session's shuffle partitions, for exchanges that must not be coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``text``; a NULL text reads as an empty one."""
    return docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))


def values(column: pa.Array) -> Iterator:
    """Python values one at a time: never more than one long text decoded at once."""
    for i in range(len(column)):
        yield column[i].as_py()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which at its end gives freed memory back to the system.

    Python workers live on for later tasks and stages, and allocators keep what was freed.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # The heap of the C library, which numpy uses; only glibc has this call.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def map_rows(df: DataFrame, schema: str, per_row: Callable[..., tuple]) -> DataFrame:
    """One output row per input row, computed in Python over Arrow batches, without a shuffle."""
    target = arrow_schema(schema)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [per_row(*row) for row in zip(*map(values, batch.columns), strict=True)]
            yield batch_of(rows, target)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _byte_values() -> np.ndarray:
    from hashlib import blake2b

    digests = [blake2b(bytes([b]), digest_size=8).digest() for b in range(256)]
    out = np.array([int.from_bytes(d, "little") for d in digests], np.uint64)
    out[list(b" \t\n\r\x0b\x0c")] = 0
    return out


class WordCodes:
    """64-bit codes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z in lower case.

    A word's code is a polynomial over random values of its bytes, equal wherever it stands; all
    words of a text are computed at once from running sums.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.value = _byte_values()
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(2 * len(self.powers), n + 1)
        step = np.full(size, self.BASE, np.uint64)
        back = np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        self.powers, self.inverse = np.cumprod(step), np.cumprod(back)

    def of(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        n = len(data)
        if n >= len(self.powers):
            self._grow(n)
        value = self.value[data]
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = value != 0
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.powers[:n], out=total[1:])
        return mixed((total[stop] - total[start]) * self.inverse[start])


#: Odd multipliers of the mixing steps below (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit code per window of ``width`` consecutive codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed(codes[:n])
    for k in range(1, width):
        out = mixed(out ^ codes[k : k + n])
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer in use."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
