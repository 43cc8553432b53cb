"""Filter interactions: every figure again by applying the filters in order, one document at a time."""

from itertools import permutations

import numpy as np
import pytest

from tallychain.llm import filter_audit
from tallychain.llm.filter_audit import audit, walk

LABELS = "doc_id long, quality int, toxic int, n string, text int"


def plain(docs, labels):
    """The report from (doc_id, text, source) and (doc_id, quality, toxic) rows."""
    low = {}
    for k, text, _ in docs:
        if k is not None:
            low[text or ""] = min(low.get(text or "", k), k)
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    judged = []
    for k, text, source in docs:
        text = text or ""
        words = [w for w in text.encode().split()]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": k is not None and text in low and low[text] < k,
        }
        judged.append((source or "", {f for f in fails if fails[f]}, k in good, k in toxic))
    out = []
    for part in {j[0] for j in judged}:
        rows = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        told = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                failing = sum(f in j[1] for j in rows)
                told.append((
                    part, "".join(order), step, len(left), len(gone), failing - len(gone),
                    sum(j[1] == {f} for j in rows), sum(j[2] for j in gone), sum(j[3] for j in gone), f,
                ))
        out += [(*t[:-1], shapley[t[-1]]) for t in told]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0, "x", 1), (5, 1, 1, "x", 1), (6, 0, 1, "x", 1), (6, 1, 0, "x", 1),
            (10, None, 1, "x", 1), (None, 1, 1, "x", 1), (99, 1, 1, "x", 1)]
    return spark.createDataFrame(rows, LABELS)


def test_edge_rows_against_a_plain_version(spark, edges, labels):
    # Several parts, a NULL one among them.
    docs = edges.selectExpr("*", "CASE WHEN n % 4 < 3 THEN concat('s', n % 4) END AS source")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert told(audit(docs, labels)) == plain(rows, marks)


def test_copies_in_several_parts_and_without_key(spark, labels):
    rows = [(3, "same", "a"), (5, "same", "b"), (5, "same", "b"), (5, "other " * 60, "b"),
            (4, "same", None), (None, "same", "a"), (None, "alone", ""), (9, None, "a"), (10, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert told(audit(docs, labels)) == plain(rows, marks)


def test_empty_tables(spark, edges, nothing, labels):
    docs = nothing.selectExpr("*", "'a' AS source")
    assert audit(docs, labels).collect() == []
    some = edges.selectExpr("*", "'a' AS source")
    assert audit(some, labels.limit(0)).count() == 600


def test_the_walk_equals_counting_each_subset():
    counts = np.random.default_rng(3).integers(0, 50, (2, filter_audit.STATES, 3))
    states = walk(counts)
    for active in range(filter_audit.STATES):
        left = [m for m in range(filter_audit.STATES) if not m & active]
        assert (states[:, active] == counts[:, left].sum(axis=1)).all()
