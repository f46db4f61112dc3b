import random

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import evidence as E
from lattica.operators import extract
from lattica.operators import metrics as M
from lattica.operators import retrieve as P


def test_first_of_similar_sets_stay(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    sets = [(k, sorted(rnd.sample(words, rnd.randint(1, 6)))) for k in range(80)] + [(99, [])]
    df = spark.createDataFrame(sets, "id long, words array<string>")
    like = lambda x, y: len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and like(x, y)}
    pairs = E.similar_sets(df, 0.5)
    assert {tuple(r) for r in pairs.collect()} == want
    kept = []
    for k, x in sets:
        if not any((j, k) in want for j in kept):
            kept.append(k)
    assert {r.id for r in E.kept_first(df, pairs).collect()} == set(kept)
    assert E.kept_first(df.filter("false"), pairs.filter("false")).count() == 0


def test_quotes_are_verified_word_for_word(spark):
    a = spark.createDataFrame([(1, 'He said "the peel of ten lemons is dried in Lodi" and left'), (2, "«the peel of ten lemons, is dried in Lodi»"), (3, 'x "short one"'), (4, None), (5, '"the peel of ten lemons is dried in Turin"')], "k long, t string")
    q = E.quotes(a, "k", "t")
    assert {r.k for r in q.collect()} == {1, 2, 5}
    texts = spark.createDataFrame([("So: The peel of ten lemons is dried\nin Lodi.",), (None,), ("",)], "t string")
    assert {r.quote for r in E.verbatim(texts, "t", q.select("quote")).collect()} == {"the peel of ten lemons is dried in lodi"}


def test_definitional_terms(spark):
    qs = ["What is olive pomace?", "Che cos'è la crusca", "what is this", "How many plants are there?", "What are one two three four five six seven", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q string").orderBy("i").select(E.definitional_term(F.col("q"))).collect()]
    assert got[:5] == ["olive pomace", "crusca", None, None, None] and not got[5] and not got[6]


def test_names_of_any_length(spark):
    name = "a b c d e f g h i"
    t = spark.createDataFrame([(1, f"x {name.upper()} y a b"), (2, "a b c"), (3, None), (4, "")], "k long, t string")
    names = spark.createDataFrame([(name,), ("a b",), ("",), (None,)], "phrase string")
    assert sorted((r.k, r.at, r.phrase) for r in extract.gazetteer_mentions(t, "k", "t", names).collect()) == [(1, 2, "a b"), (1, 2, name), (1, 12, "a b"), (2, 1, "a b")]


def test_anchors_share_the_limit(spark):
    edges = spark.createDataFrame([("a", "T", f"x{i}", i) for i in range(10)] + [("b", "T", "x0", 100), ("x0", "T", "y", 50)], "src string, type string, dst string, edge_id long")
    anchors = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "zz", 1)], "query long, node_id string, rank int")
    got = P.expansion(edges, anchors, 1, 6).collect()
    assert {(r["query"], r.key) for r in got} == {(1, "0"), (1, "1"), (1, "2"), (1, "100")}
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_modes_choose_channels(spark):
    r = spark.createDataFrame([(1, c, "k", 1.0, 1) for c in ("text", "nodes", "triples", "neighbors", "expansion")], "query long, channel string, key string, score double, rank int")
    got = {}
    for x in P.by_mode(r).collect():
        got.setdefault(x["mode"], set()).add(x.channel)
    assert got == {m: set(cs) for m, cs in P.MODES.items()}


def test_contrasts_equal_least_squares(spark):
    rnd = random.Random(8)
    rows = [(f"u{rnd.randint(0, 14)}", rnd.choice("abc"), rnd.random()) for _ in range(300)] + [(None, "a", 1.0), ("u1", None, 1.0), ("u1", "a", None)]
    df = spark.createDataFrame(rows, "u string, arm string, y double")
    got = {r.arm: r for r in M.contrasts(df, "u", "arm", "y", "a", 20).collect()}
    full = [r for r in rows if None not in r]
    x = np.zeros((len(full), 17))
    for k, (u, a, _) in enumerate(full):
        x[k, int(u[1:])] = 1
        if a != "a":
            x[k, 15 + "bc".index(a)] = 1
    beta = np.linalg.lstsq(x, np.array([r[2] for r in full]), rcond=None)[0]
    assert abs(got["b"].effect - beta[15]) < 1e-9 and abs(got["c"].effect - beta[16]) < 1e-9
    assert got["b"].lo < got["b"].hi and 0 <= got["b"].p <= 1
