import numpy as np
import pytest

from tallychain.llm import quality_model as m

SMALL = "/root/testdata/sf0.01"


def test_rules_find_a_conjunction_and_weights_are_sparse():
    r = np.random.default_rng(2)
    x = r.random((3000, len(m.FEATURES)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = m.learn(x, y)
    fresh = r.random((2000, len(m.FEATURES)))
    truth = (fresh[:, 0] > 0.6) & (fresh[:, 3] <= 0.5)
    assert ((model.predict(fresh) >= 0.5) == truth).mean() > 0.97
    assert 0 < len(model.rules) < len(m.tree_rules(x, y))


def test_column_equals_numpy(spark, edges):
    r = np.random.default_rng(3)
    x = r.random((400, len(m.FEATURES)))
    model = m.learn(x, (x[:, 1] > 0.4).astype(float))
    measured = m.statistics(edges, "doc_id")
    rows = m.score(measured, model).collect()
    data = np.array([[row[f] for f in m.FEATURES] for row in rows])
    assert np.isfinite(data).all()
    assert [row.score for row in rows] == pytest.approx(model.predict(data).tolist(), abs=1e-8)
    assert len(rows) == edges.count()


def test_no_python_when_scoring(edges):
    model = m.RuleModel(0.5, ((frozenset([("digits", True, 0.1)]), 1.0),))
    plan = m.score(m.statistics(edges, "doc_id"), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_class_and_no_labels(spark, edges, nothing):
    measured = m.statistics(edges, "doc_id")
    ones = spark.createDataFrame([(5, 1), (7, 1), (9, None), (1000, 0)], "doc_id long, label int")
    assert m.fit(measured, ones).rules == ()
    none = ones.limit(0)
    assert m.score(measured, m.fit(measured, none)).where("score = 0.5").count() == edges.count()
    assert m.score(m.statistics(nothing, "doc_id"), m.fit(measured, ones)).count() == 0


def test_held_out_accuracy(spark):
    scored = m.op7_quality_model(spark, SMALL)
    assert scored.count() == 1000 and scored.where("score is null or score < 0 or score > 1").count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", m.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
