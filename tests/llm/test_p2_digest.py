import numpy as np

from lattica.llm import digest


def test_percentiles_are_certified_and_ignore_bad_values(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.lognormal(6, 1, 4000)] + [("b", 5.0)] * 900 + [(None, 1.0), ("a", None), ("a", float("nan")), ("a", -1.0), ("a", float("inf"))]
    v = spark.createDataFrame(rows, "g string, x double").selectExpr("*", "1 AS q", "2 AS n")
    got = digest.percentiles(v.select("g", "x"), ["g"], "x").collect()
    assert all(r.certified for r in got)
    a = np.sort([x for g, x in rows if g == "a" and x is not None and np.isfinite(x) and x >= 0])
    for r in got:
        if r.g == "a":
            assert r.n == len(a) and r.below == (a < r.estimate).sum() and r.upto == (a <= r.estimate).sum()
            assert abs(np.searchsorted(a, r.estimate) / len(a) - r.q) <= digest.RANK_ERROR + 1 / len(a)
        if r.g == "b":
            assert abs(r.estimate - 5.0) < 1e-9
    assert {r.n for r in got if r.g is None} == {1}


def test_days_combine_to_the_whole(spark):
    v = spark.range(6000).selectExpr("id % 5 AS day", "cast((id * 7919) % 6007 AS double) AS x").selectExpr("'s' AS g", "day", "x")
    whole = digest.estimates(digest.combine(digest.digests(v, ["g", "day"], "x"), ["g"]), ["g"])
    xs = np.sort([r.x for r in v.collect()])
    for r in whole.collect():
        assert abs((xs <= r.estimate).mean() - r.q) <= digest.RANK_ERROR * 2


def test_one_group_in_many_tasks_and_empty(spark):
    v = spark.range(3000).selectExpr("'hot' AS g", "cast(id AS double) AS x").repartition(40)
    got = digest.percentiles(v, ["g"], "x").collect()
    assert all(r.certified for r in got) and got[0].n == 3000
    assert digest.percentiles(v.filter("false"), ["g"], "x").count() == 0
