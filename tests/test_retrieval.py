import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics as M
from lattica.operators import ranks as K
from lattica.operators import retrieval as R


def test_bm25_does_not_reward_padding(spark):
    docs = spark.createDataFrame([(1, "olive pomace dried"), (2, "olive pomace dried " + "filler " * 60), (3, "nothing"), (4, None), (5, "")], "id long, t string")
    q = spark.createDataFrame([(9, "olive olive pomace")], "q long, t string")
    s = {r.key: r.score for r in R.bm25_scores(docs, "id", "t", q, "q", "t").collect()}
    assert set(s) == {1, 2} and s[1] > s[2]
    avgdl = (3 + 63 + 1) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert abs(s[1] - round(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 6)) < 1e-6


def test_bm25_top_k_equals_the_scores_and_writes_no_pairs(spark, monkeypatch):
    from lattica import common

    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocab[int(i)] for i in rng.zipf(1.3, n) % 60)
    texts = [text(int(rng.integers(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:60])] + [(900, None), (901, ""), (902, "...")], "id long, t string").repartition(3)
    asked = spark.createDataFrame([(f"q{i:03d}", text(12)) for i in range(200)] + [("none", "zzz"), ("empty", ""), ("null", None)], "q string, t string")
    want = sorted(tuple(r) for r in R.top_k(R.bm25_scores(docs, "id", "t", asked, "q", "t"), 5).select("query", "key", "score", "rank").collect())
    assert len(want) == 1000
    held = len(common._written)
    ask = lambda: sorted(tuple(r) for r in R.bm25_top_k(docs, "id", "t", asked, "q", "t", 5).select("query", "key", "score", "rank").collect())
    assert ask() == want
    assert sum(spark.read.parquet(p).count() for p in common._written[held:]) < 200 * 20
    for name, value in (("VOCABULARY", 0), ("BM25_BLOCK", 16), ("COMMON", 2.0), ("BM25_POSTINGS", 90), ("HELD_BYTES", 0)):
        monkeypatch.setattr(R, name, value)
        assert ask() == want


@pytest.mark.parametrize("name", ["M01_M06_ranking_metrics", "R22_multi_query"])
def test_queries_of_all_items_score_no_pairs_in_rows(spark, data, monkeypatch, name):
    from lattica.plans import registry

    monkeypatch.setattr(R, "bm25_scores", lambda *a: pytest.fail("a row for each pair of item and document"))
    assert registry.queries()[name](spark, data).count() > 0


def test_mmr_drops_a_near_duplicate(spark):
    pool = spark.createDataFrame([(1, 1, 1.0, ["a", "b", "c"]), (1, 2, 0.99, ["a", "b", "c"]), (1, 3, 0.5, ["x", "y"])], "query long, key long, score double, tokens array<string>")
    got = sorted((r["rank"], r.key) for r in R.mmr(pool, 2, 0.5).collect())
    assert got == [(1, 1), (2, 3)]


def test_vector_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None), (100, [0.0] * 8)], "id long, v array<double>")
    u = R.unit(df, "id", "v")
    got = {(r.query, r["rank"]): r.key for r in R.vector_top_k(u, u.filter("key < 3"), 5).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        s = np.round(n @ n[q], 6)
        want = np.lexsort((np.arange(60), -s))[:5]
        assert [got[(q, k + 1)] for k in range(5)] == want.tolist()


def test_similar_pairs_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = base + rng.normal(size=base.shape) * 0.25
    m = np.vstack([base, near])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n @ n.T
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if s[i, j] >= 0.8}
    got = {(r.a, r.b) for r in R.similar_pairs(R.unit(df, "id", "v"), 0.8).collect()}
    assert not {p for p in got if s[p] < 0.7999}
    assert len(got & want) >= 0.9 * len(want)


def test_cap_demotes_but_keeps(spark):
    r = spark.createDataFrame([(1, "d1", 1), (1, "d1", 2), (1, "d1", 3), (1, "d2", 4)], "query long, doc string, rank int")
    got = {x["rank"]: x.new_rank for x in R.capped(r, "query", "doc", 2).collect()}
    assert got == {1: 1, 2: 2, 4: 3, 3: 4}


def test_merge_never_exceeds_limit(spark):
    a = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "query long, key long, rank int")
    b = spark.createDataFrame([(1, k, k) for k in range(3, 9)], "query long, key long, rank int")
    got = sorted((r["rank"], r.key) for r in R.merged([a, b], 6).collect())
    assert [k for _, k in got] == [1, 2, 3, 4, 5, 6]


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query long, key long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (1, 13)], "query long, key long")
    r = {x["query"]: x for x in M.ranking_metrics(ranked, rel, 2).collect()}
    assert (r[1].precision, r[1].recall, r[1].hit, r[1].rr) == (0.5, 0.333333, 1, 0.5)
    assert r[1].ap == round((1 / 2 + 2 / 3) / 3, 6)
    assert r[1].ndcg == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)
    assert (r[2].precision, r[2].recall, r[2].ndcg, r[2].ap) == (0.0, 0.0, 0.0, 0.0)


def test_lcs_and_overlap(spark):
    assert M.lcs("a b c b d a b".split(), "b d c a b a".split()) == 4
    assert M.lcs([], ["a"]) == 0
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], [])], "k long, a array<string>, b array<string>")
    got = {r.k: r.f1 for r in M.token_overlap(df, "a", "b").collect()}
    assert abs(got[1] - 0.4) < 1e-9 and got[2] == 0.0


def test_bootstrap_is_reproducible(spark):
    v = spark.createDataFrame([("g", i, float(i % 7)) for i in range(200)], "g string, k long, v double")
    a, b = M.hashed_bootstrap(v, "g", "k", "v").first(), M.hashed_bootstrap(v.repartition(3), "g", "k", "v").first()
    assert abs(a["mean"] - 2.97) < 0.05 and a.lo < a["mean"] < a.hi
    assert all(abs(a[c] - b[c]) < 1e-9 for c in ("lo", "hi"))


def test_tie_ranks(spark):
    v = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0)], "g string, v double")
    assert sorted(r.r for r in K.tie_ranks(v, "v", "r", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert spark.range(1).select(*[c.isNull().alias(n) for c, n in zip(M.wilson(F.lit(0), F.lit(0)), "ab")]).first() == (True, True)


def test_ranking_metrics_take_every_item_and_all_documents(spark, tmp_path):
    from lattica.plans import registry

    items = [(11, "where is whey dried", "Whey is dried in Lodi. It costs 3.5 euros."), (12, "who sells husks", "Nobody knows."), (13, "zzz", "Husks are sold by Anna."), (14, None, None)]
    docs = [(1, "Whey whey whey, dried where? Whey is where it is."), (2, "A report. Whey is dried in Lodi! The end."), (3, "Husks are sold by Anna."), (4, None)]
    spark.createDataFrame(items, "item_id long, question string, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["query"]: r for r in registry.queries()["M01_M06_ranking_metrics"](spark, str(tmp_path)).collect()}
    assert set(got) == {11, 12, 13, 14}
    assert (got[11].hit, got[11].precision, got[11].recall, got[11].rr, got[11].ap) == (1, 0.5, 1.0, 0.5, 0.5)
    assert all(got[k].hit == 0 and got[k].recall == 0 for k in (12, 13, 14))


def test_running_totals_and_quantiles(spark):
    import statistics

    rows = [("a", float(i % 13)) for i in range(200)] + [(None, float(i)) for i in range(5)] + [("b", None), ("c", 3.0)]
    v = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.lo, r.med) for r in K.quantiles(v, ["g"], "v", {"lo": 0.25, "med": 0.5}).collect()}
    a = sorted(x for g, x in rows if g == "a")
    assert got == {"a": (statistics.quantiles(a, n=4, method="inclusive")[0], statistics.median(a)), None: (1.0, 2.0), "c": (3.0, 3.0)}
    n = {(r.g, r.v, r.k): r.k for r in K.numbered(v.filter("g IS NULL"), ["g"], ["v"], "k").collect()}
    assert n == {(None, float(i), i + 1): i + 1 for i in range(5)}
    assert K.quantiles(v.filter("false"), ["g"], "v", {"med": 0.5}).count() == 0
