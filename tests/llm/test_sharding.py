"""Sharding: a permutation, near-equal counts, and the same places whatever the partitions."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallychain.llm import sharding
from tallychain.llm.sharding import Permutation, assign, chain, write_shards

SMALL = "/root/testdata/sf0.001"


def columns(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 101, 1000, 4099])
@pytest.mark.parametrize("seed", [1, 2])
def test_it_is_a_permutation_with_an_inverse(spark, n, seed):
    p = Permutation(spark, n, seed)
    places = spark.range(n).select("id", p.place(F.col("id")).alias("place"))
    rows = places.withColumn("back", p.row(F.col("place"))).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_it_shuffles(spark):
    p = Permutation(spark, 10_000)
    places = [r[0] for r in spark.range(10_000).select(p.place(F.col("id"))).collect()]
    fixed = sum(k == x for k, x in enumerate(places))
    neighbours = sum(abs(x - y) == 1 for x, y in zip(places, places[1:], strict=False))
    assert fixed < 12 and neighbours < 20
    other = Permutation(spark, 10_000, 2)
    assert places != [r[0] for r in spark.range(10_000).select(other.place(F.col("id"))).collect()]


def test_walks_are_the_longest_chain(spark):
    """Checked against stepping every number until it is inside."""
    for n in (5, 17, 37, 101):
        p = Permutation(spark, n)
        once = dict(spark.range(p.a * p.b).select("id", p.once(F.col("id"))).collect())
        needed = 0
        for x in range(n):
            steps, y = 0, once[x]
            while y >= n:
                steps, y = steps + 1, once[y]
            needed = max(needed, steps)
        assert needed <= p.walks
    assert chain({5: 6, 6: 7}, 5) == 2 and chain({5: 6, 6: 5}, 5) == chain({4: 4}, 4) == 0


def test_query_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op13_sharding(spark, SMALL).collect()}
    given = docs.select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in given}
    for d in given:
        data = (d.text or "").encode()
        assert got[d.doc_id].size == len(data) + 8
        assert got[d.doc_id].text_crc32 == zlib.crc32(data)
        assert got[d.doc_id].law == "rows" and got[d.doc_id].grown_shard is None
    order = sorted(got)
    assert [got[k].row for k in order] == list(range(len(order)))
    _check_slots(got.values())


def _check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1


def test_edge_rows_and_any_partitioning(spark, edges, nothing, settings):
    want = columns(assign(edges))
    assert len(want) == edges.count()
    _check_slots(assign(edges).collect())
    assert columns(assign(edges.repartition(7, "text"))) == want
    settings("spark.sql.shuffle.partitions", "11")
    assert columns(assign(edges.repartition(1))) == want
    assert assign(nothing).collect() == []
    null = [r for r in assign(edges).collect() if r.doc_id == 1]
    assert null[0].size == 8 and null[0].text_crc32 == 0


def test_shards_are_written_whole_and_in_order(spark, edges, tmp_path):
    write_shards(edges, str(tmp_path / "out"), shards=5, file_rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.select("carried.*").collect()
    assert Counter(map(str, rows)) == Counter(map(str, edges.collect()))
    want = {(r.shard, r.slot) for r in assign(edges, shards=5).collect()}
    assert {(r.shard, r.slot) for r in back.collect()} == want
    for file in {r[0] for r in back.select(F.input_file_name()).distinct().collect()}:
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == sorted(slots)
