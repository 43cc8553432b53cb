"""Token ids as files: bit- or byte-plane shuffled blocks, zstandard per plane, a chunk index.

Layout of a folder:

``chunks``  one row per chunk, in Parquet as the container, so that Spark's commit protocol
            covers the files and any file system works.  A chunk holds whole documents: their keys
            and lengths, and ``payload``, the blocks of its ids one after the other.
``index``   one row per chunk: shard, chunk, first_id (ids before it), n_ids, n_documents, bytes.

A block has at most `BLOCK_IDS` ids: a header of little-endian unsigned 32-bit numbers (count of
ids, count of planes, stored size of each plane), then the planes.  Byte planes are the four bytes of
the ids, lowest first; bit planes are their 32 bits, lowest first, eight ids to a byte.  Ids that
agree in their high parts leave planes of one value, which cost a few bytes.

Documents are in ascending key order, NULL keys first, equal keys by text; shards are ranges of
keys.  A NULL or empty text is the end id alone; an empty table gives a folder without chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import arrow_schema, batch_of, fresh_folder, table, texts, tidied, values
from tallychain.llm.tokens import documents_ids, little_endian, public_path

VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 32_768
CHUNK_IDS = 131_072
LEVEL = 3


def encode_block(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> bytes:
    """Header and compressed planes of at most `BLOCK_IDS` ids."""
    data = np.frombuffer(little_endian(ids), np.uint8).reshape(len(ids), 4)
    if bits:
        # (ids, 32 bits, lowest first) -> one packed plane per bit
        each = np.unpackbits(data, axis=1, bitorder="little")
        planes = [np.packbits(each[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(data[:, k]) for k in range(4)]
    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True)
    stored = [squeeze.compress(p.tobytes()) for p in planes]
    header = struct.pack(f"<{2 + len(stored)}I", len(ids), len(stored), *map(len, stored))
    return header + b"".join(stored)


def decode_blocks(payload: bytes) -> Iterator[np.ndarray]:
    """The ids of each block of a payload."""
    at, expand = 0, zstandard.ZstdDecompressor()
    while at < len(payload):
        n, count = struct.unpack_from("<2I", payload, at)
        sizes = struct.unpack_from(f"<{count}I", payload, at + 8)
        at += 8 + 4 * count
        planes = []
        for size in sizes:
            raw = expand.decompress(payload[at : at + size], max_output_size=4 * BLOCK_IDS)
            planes.append(np.frombuffer(raw, np.uint8))
            at += size
        if count == 32:
            each = [np.unpackbits(p, count=n, bitorder="little") for p in planes]
            data = np.packbits(np.stack(each, axis=1), axis=1, bitorder="little")
        else:
            data = np.stack(planes, axis=1)
        yield np.ascontiguousarray(data).view("<u4").reshape(n)


CHUNK = (
    "shard int, chunk int, shard_first long, n_ids long, lengths array<long>, payload binary"
)


def _chunks(vocabulary: str, bits: bool, target: pa.Schema):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        keys, ids, size = [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal chunk, first, keys, ids, size
            whole = np.concatenate(ids)
            payload = b"".join(
                encode_block(whole[k : k + BLOCK_IDS], bits) for k in range(0, size, BLOCK_IDS)
            )
            row = (shard, chunk, first, size, [len(x) for x in ids], payload, keys)
            chunk, first = chunk + 1, first + size
            keys, ids, size = [], [], 0
            return batch_of([row], target)

        for batch in batches:
            rows = zip(*map(values, batch.columns), strict=True)
            for key, x in documents_ids(rows, vocabulary, keeps_spaces=True):
                if size and size + len(x) > CHUNK_IDS:
                    yield full()
                keys.append(key)
                ids.append(x)
                size += len(x)
        if size:
            yield full()

    return run


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, key: str = "doc_id", bits: bool = False
) -> None:
    """Encode every document and write ``path/chunks`` and ``path/index``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{CHUNK}, keys array<{kind}>"
    run = _chunks(vocabulary or public_path(VOCABULARY), bits, arrow_schema(schema))
    ordered = texts(docs, key).repartitionByRange(key).sortWithinPartitions(key, "text")
    # Payloads are compressed already.
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(
        f"{path}/chunks"
    )
    spark = docs.sparkSession
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks")
    rows = chunks.select(
        "shard", "chunk", "shard_first", "n_ids", F.size("lengths").alias("n_documents"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    (
        rows.join(F.broadcast(_shard_starts(rows)), "shard")
        .select("shard", "chunk", (F.col("before") + F.col("shard_first")).alias("first_id"),
                "n_ids", "n_documents", "bytes")
        .write.parquet(f"{path}/index")
    )


def _shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard: one row per task of the writing job, whatever the documents."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sums.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document: key, start, n_tokens, ids (little-endian unsigned 32-bit), end id included."""
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    starts = _shard_starts(spark.read.parquet(f"{path}/index").select("shard", "n_ids"))
    rows = chunks.join(F.broadcast(starts), "shard").select(
        "keys", "lengths", (F.col("before") + F.col("shard_first")).alias("first"), "payload"
    )
    schema = f"{key} {kind}, start long, n_tokens long, ids binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, lengths, first, payload in zip(*map(values, batch.columns), strict=True):
                ids, out, at = np.concatenate(list(decode_blocks(payload))), [], 0
                for k, n in zip(keys, lengths, strict=True):
                    out.append((k, first + at, n, little_endian(ids[at : at + n])))
                    at += n
                yield batch_of(out, target)

    return rows.mapInArrow(run, schema)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path)
    found = read_token_files(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
