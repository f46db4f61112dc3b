import random

import pytest

from lattica.llm import groups


def brute(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, left = {}, set(near)
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += near[x] - seen
        left -= seen
        out |= {x: min(seen) for x in seen}
    return out


def shapes():
    rnd = random.Random(11)
    yield "chain", [(i, i + 1) for i in range(70)]
    yield "ring", [(i, (i + 1) % 33) for i in range(33)] + [(100, 101), (101, 102), (102, 100)]
    yield "star", [(500, i) for i in range(60)] + [(500, 700), (700, 701)]
    yield "lollipop", [(0, 1), (1, 2), (2, 0)] + [(2, 9), (9, 10), (10, 11), (11, 12)]
    yield "clique and trees", [(a, b) for a in range(8) for b in range(a)] + [(7, 20), (20, 21), (20, 22), (22, 23)] + [(50, 51)]
    yield "random", [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(130)]
    yield "dirt", [(3, 3), (None, 4), (4, None), (5, 6), (6, 5), (5, 6)]


@pytest.mark.parametrize("name, pairs", list(shapes()), ids=[n for n, _ in shapes()])
def test_components(spark, name, pairs):
    df = spark.createDataFrame(pairs, "a long, b long").selectExpr("*", "1 AS u", "2 AS label")
    got = {r.id: r.label for r in groups.components(groups.undirected(df, "a", "b")).collect()}
    assert got == brute(pairs)


def test_only_confirmed_pairs_of_known_records(spark):
    p = spark.createDataFrame([(1, 2, True), (2, 3, None), (3, 4, False), (2, 1, True), (5, 99, True), (7, 7, True), (8, 6, True)], "left_group long, right_group long, same_entity boolean")
    r = spark.createDataFrame([(i, "n") for i in (1, 1, 2, 3, 4, 5, 6, 7, 8)], "entity_id long, canonical_name string")
    assert sorted(tuple(x) for x in groups.entity_groups(p, r).collect()) == [(1, 1), (2, 1), (6, 6), (8, 6)]
    assert groups.entity_groups(p.filter("false"), r).count() == 0


def test_cores_of_any_diameter_settle(spark):
    rnd = random.Random(5)
    ids = list(range(1, 2801))
    rnd.shuffle(ids)
    # a band (each with the next two) and a ladder, with ids in no order
    band = [(ids[i], ids[j]) for i in range(1600) for j in (i + 1, i + 2) if j < 1600]
    ladder = [(ids[i], ids[i + 2]) for i in range(1600, 2798)] + [(ids[i], ids[i + 1]) for i in range(1600, 2800, 2)]
    df = groups.undirected(spark.createDataFrame(band + ladder, "a long, b long"), "a", "b")
    low = groups.both_ways(df).selectExpr("x AS id", "x AS low").distinct()
    got = {r.id: r.label for r in groups.solve_core(df, low).collect()}
    assert got == brute(band + ladder)
