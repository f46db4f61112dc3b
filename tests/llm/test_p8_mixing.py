import numpy as np
from pyspark.sql import functions as F

from lattica.llm import mixing


def frames(spark):
    docs = [(i, "abc"[i % 3], "word " * (5 + i % 7)) for i in range(900)] + [(5000, "tiny", "a few words of text"), (5001, None, "no source"), (5002, "a", None), (5003, "a", ""), (5004, "other", "not a target")]
    t = [("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.2, 3), ("tiny", 0.05, 2), ("missing", 0.05, 4), (None, 0.0, 1)]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, source string, text string").selectExpr("*", "1 AS block", "2 AS give")
    return d, spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_mix(spark):
    d, t = frames(spark)
    drawn, plan = mixing.mix(d, t)
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    limit = {"a": 2, "b": 1, "c": 3, "tiny": 2}
    assert all(0 < r.copies <= limit[r.source] for r in rows)
    rep = {r.source: r for r in mixing.report(drawn, plan).collect()}
    assert rep["missing"].tokens == 0 and rep["missing"].status == "no documents"
    assert rep["tiny"].status == "limited by repeats"
    # the sources that have enough keep the ratio of their targets
    assert abs(rep["a"].tokens / rep["c"].tokens - 2.5) < 0.03 and abs(rep["b"].tokens / rep["c"].tokens - 1) < 0.03
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-4
    again = {(r.doc_id, r.copies) for r in mixing.mix(d.repartition(7), t)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_budget_is_met_to_a_document(spark):
    d, t = frames(spark)
    drawn, plan = mixing.mix(d, t, budget=2000)
    assert abs(drawn.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] - 2000) < 40


def test_empty(spark):
    d, t = frames(spark)
    drawn, plan = mixing.mix(d.filter("false"), t)
    assert drawn.count() == 0 and mixing.report(drawn, plan).filter("tokens > 0").count() == 0
    assert mixing.mix(d, t.filter("false"))[0].count() == 0


def test_exponents():
    q = np.array([0.7, 0.2, 0.1])
    a = mixing.exponent_for_entropy(q, 0.95)
    assert abs(mixing.entropy(mixing.tempered(q, a)) - 0.95) < 1e-6
    b = mixing.exponent_for_repeats(q, 1000, q * 1000, np.array([1.0, 2.0, 2.0]))
    w = mixing.tempered(q, b) * 1000
    assert (w <= q * 1000 * np.array([1, 2, 2]) + 1e-3).all() and b < 1
    assert mixing.tempered(q, 0).tolist() == [1 / 3] * 3


def test_weights_keep_the_targets_where_the_limits_allow():
    size, one = np.array([500.0, 300.0, 200.0]), np.ones(3)
    give, a = mixing.planned_tokens(np.array([0.5, 0.3, 0.2]), size, one, 1000)
    assert (a == 1).all() and np.allclose(give, size)
    # the first and then the second reach their limits on the way to the targets; the third takes the rest
    give, a = mixing.planned_tokens(np.array([0.6, 0.3, 0.1]), np.array([100.0, 320.0, 580.0]), np.array([2.0, 1.0, 2.0]), 1000)
    assert np.allclose(give, [200, 320, 480]) and 0 < a[0] < 1 and 0 < a[1] < 1
    # one source with too little does not move the others off the proportions of their targets
    give, a = mixing.planned_tokens(np.array([0.1, 0.6, 0.3]), np.array([10.0, 500.0, 490.0]), np.array([3.0, 3.0, 3.0]), 1000)
    assert np.allclose(give, [30, 970 * 2 / 3, 970 / 3]) and a[0] < 1 and (a[1:] == 1).all()
    # a budget near all limits
    give, a = mixing.planned_tokens(np.array([0.5, 0.5]), np.array([100.0, 900.0]), np.array([2.0, 2.0]), 1990)
    assert np.allclose(give, [200, 1790])
    assert np.allclose(mixing.towards(np.array([0.2, 0.8]), np.array([0.5, 0.5]), 0), [0.5, 0.5])


def test_report_says_below_and_above(spark):
    plan = spark.createDataFrame([("a", 0.5, 2, 100, 50.0, 0.5, 1, 1.0), ("b", 0.3, 2, 100, 30.0, 0.5, 1, 1.0), ("c", 0.2, 9, 100, 20.0, 0.5, 1, 1.0)], mixing.PLAN)
    drawn = spark.createDataFrame([(1, "a", 60, 1), (2, "b", 20, 1), (3, "c", 20, 1)], "doc_id long, source string, n_tokens long, copies int")
    assert {r.source: r.status for r in mixing.report(drawn, plan).collect()} == {"a": "above", "b": "below", "c": "met"}
