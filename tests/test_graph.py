import random

from lattica.operators import graph as G
from lattica.plans import registry


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, "T", b, i, 1) for i, (a, b) in enumerate(pairs)], "src string, type string, dst string, edge_id int, n long")


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_and_distances(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randint(0, 40):02d}", f"n{rnd.randint(0, 40):02d}") for _ in range(30)] + [("n00", "n00")]
    e = edges_of(spark, pairs)
    assert {r.node: r.component for r in G.components(e).collect()} == brute_components(pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front = {"n00": 0}, {"n00"}
    for k in (1, 2):
        front = {y for x in front for y in near.get(x, ())} - set(want)
        want |= {y: k for y in front}
    got = G.distances(e, spark.createDataFrame([("n00",)], "node_id string"), 2)
    assert {r.node: r.dist for r in got.collect()} == want


def test_shortest_lengths_keep_to_the_pairs(spark):
    from lattica import common

    rnd = random.Random(9)
    hub = [("h", f"m{i}") for i in range(120)] + [(f"m{i}", "h") for i in range(0, 120, 7)]
    chain = [("c0", "c1"), ("c2", "c1"), ("c2", "c3"), ("c3", "c4"), ("c4", "c4"), ("m0", "c0")]
    some = [(f"r{rnd.randint(0, 40):02d}", f"r{rnd.randint(0, 40):02d}") for _ in range(35)]
    arcs = hub + chain + some
    names = sorted({x for e in arcs for x in e})
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def length(a, b, depth):
        front, seen = {a}, {a}
        for k in range(depth + 1):
            if b in front:
                return k
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front

    asked = [*arcs, *[(rnd.choice(names), rnd.choice(names)) for _ in range(150)], ("c0", "c3"), ("c4", "c0"), ("m5", "c1"), ("none", "none"), ("none", "h"), ("h", "none")]
    pairs = spark.createDataFrame(asked, "a string, b string")
    for depth in (0, 1, 2, 3, 5):
        got = [tuple(r) for r in G.shortest_lengths(edges_of(spark, arcs), pairs, depth).collect()]
        assert sorted(got) == sorted((a, b, k) for a, b in set(asked) if (k := length(a, b, depth)) is not None)
    # every pair has an edge, so nothing of the hub's square is written
    held = len(common._written)
    assert G.shortest_lengths(edges_of(spark, hub), spark.createDataFrame(hub, "a string, b string"), 3).count() == len(hub)
    assert sum(spark.read.parquet(p).count() for p in common._written[held:]) < 10 * len(hub)


def test_subgraph_filters_only_returned_edges(spark):
    e = spark.createDataFrame([("a", "X", "b", 1, 1), ("b", "Y", "c", 2, 1), ("c", "X", "d", 3, 1)], "src string, type string, dst string, edge_id int, n long")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert {r.edge_id for r in G.subgraph(e, seeds, 2).collect()} == {1, 2}
    assert {r.edge_id for r in G.subgraph(e, seeds, 2, ["Y"]).collect()} == {2}


def test_rewrite_swaps_and_merges(spark):
    e = spark.createDataFrame([("a", "USED_BY", "b", 1, 1), ("b", "USES", "a", 2, 3)], "src string, type string, dst string, edge_id int, n long")
    got = G.rewrite_types(e, [("USED_BY", "USES", True)])
    assert [tuple(r) for r in got.collect()] == [("b", "USES", "a", 1, 4)]


def test_bridges_count_created_edges_only(spark):
    groups = spark.createDataFrame([("k", f"n{i}", "L", 9 - i, i + 1) for i in range(6)], "key string, node_id string, label string, degree int, rank int")
    e = edges_of(spark, [("n0", "n1"), ("n3", "n0")])
    got = {r.other for r in G.bridged_duplicates(groups, e, 3).collect()}
    assert got == {"n2", "n4", "n5"}


def test_duplicate_group_ties_go_to_the_smallest_id(spark):
    nodes = spark.createDataFrame([("b", "The Whey", "M"), ("a", "whey", "M"), ("c", "other", "M")], "node_id string, name string, label string")
    deg = spark.createDataFrame([("a", 2), ("b", 2)], "node string, degree long")
    got = {r.node_id: r["rank"] for r in G.duplicate_groups(nodes, deg).collect()}
    assert got == {"a": 1, "b": 2}


def test_empty_graph(spark):
    e = edges_of(spark, [("a", "b")]).filter("false")
    assert G.components(e).count() == 0
    assert G.degrees(e).count() == 0


def test_components_of_long_chains_settle(spark):
    rnd = random.Random(7)
    ids = [f"m{i:04d}" for i in range(900)]
    rnd.shuffle(ids)
    # a chain, a ladder and a band (each with the next two), with ids in no order
    pairs = [(ids[i], ids[i + 1]) for i in range(299)]
    pairs += [(ids[i], ids[i + 2]) for i in range(300, 598)] + [(ids[i], ids[i + 1]) for i in range(300, 600, 2)]
    pairs += [(ids[i], ids[j]) for i in range(600, 900) for j in (i + 1, i + 2) if j < 900] + [("solo", "solo")]
    assert {r.node: r.component for r in G.components(edges_of(spark, pairs)).collect()} == brute_components(pairs)


def tables_of(spark, path):
    t = [(1, "A", "PARTNER_OF", "B"), (2, "B", "PRODUCES", "C"), (3, "D", "USES", "E")]
    spark.createDataFrame(t, "triple_id long, subject string, predicate string, object string").write.parquet(f"{path}/triples.parquet")
    m = [(1, 1, 2, True, 0.99), (2, 2, 3, True, 0.5), (3, 3, 4, True, None), (4, 4, 5, False, 0.99), (5, 6, 7, None, 0.99)]
    spark.createDataFrame(m, "pair_id long, left_group long, right_group long, same_entity boolean, similarity double").write.parquet(f"{path}/match_pairs.parquet")
    r = [(i, ["x"] * (9 if i == 3 else 1)) for i in range(1, 8)]
    spark.createDataFrame(r, "entity_id long, aliases array<string>").write.parquet(f"{path}/registry.parquet")


def test_components_of_all_relations_and_confirmed_pairs(spark, tmp_path):
    q = registry.queries()
    tables_of(spark, tmp_path)
    got = {tuple(r) for r in q["G07_components"](spark, str(tmp_path)).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    got = {tuple(r) for r in q["G09_same_as_contracted"](spark, str(tmp_path)).collect()}
    assert got == {(i, 3) for i in (1, 2, 3, 4)}


def test_edge_context_of_both_ends_of_every_edge(spark, tmp_path):
    t = [(i, "Hub", "USES", f"N{i}") for i in range(1, 7)] + [(7, "N1", "PRODUCES", "M"), (8, "M", "USES", "M")]
    spark.createDataFrame(t, "triple_id long, subject string, predicate string, object string").write.parquet(f"{tmp_path}/triples.parquet")
    got = {tuple(r) for r in registry.queries()["J19_edge_context"](spark, str(tmp_path)).collect()}
    want = {(i, "hub", o) for i in range(1, 7) for o in [x for x in range(1, 7) if x != i][:3]}
    assert got == want | {(1, "n1", 7), (7, "n1", 1), (7, "m", 8), (8, "m", 7)}
