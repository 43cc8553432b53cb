"""Registered queries of the training-data operators against DuckDB, and the registry."""

import corpus_pipeline
import pytest
from compare import differences, duck

import __spark_entry__ as contract
from tallychain import llm

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", llm.ORACLES)
def test_query_equals_its_sql(spark, key):
    assert differences(llm.QUERIES[key](spark, SMALL), duck(SMALL), llm.ORACLES[key]) == []


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in llm.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(llm.QUERIES) | {"pipeline"} <= set(contract.queries())
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
