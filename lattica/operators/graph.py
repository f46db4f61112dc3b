"""Property graph operators over node and edge frames.

nodes: node_id, labels, name, props; edges: edge_id, src, type, dst (ids), props. Traversals are loops of joins on
the frontier; the loops cut their lineage by writing to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize
from lattica.functions import text as T


def node_table(triples: DataFrame) -> DataFrame:
    """Nodes of triples: one for each name key, with its smallest spelling, its labels and its mentions."""
    ends = triples.select(F.col("subject").alias("name"), F.col("subject_labels").alias("labels")).unionByName(triples.select(F.col("object").alias("name"), F.col("object_labels").alias("labels")))
    ends = ends.filter(F.col("name").isNotNull()).withColumn("node_id", T.triple_key(F.col("name"))).filter("node_id <> ''")
    return ends.groupBy("node_id").agg(F.min("name").alias("name"), F.min(F.element_at(F.concat("labels", F.array(F.lit("~"))), 1)).alias("label"), F.count(F.lit(1)).alias("mentions"))


def edge_table(triples: DataFrame) -> DataFrame:
    """Edges of triples between name keys: one for each (src, type, dst), with the smallest triple id and a count."""
    t = triples.filter(F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("predicate").isNotNull())
    t = t.select("triple_id", T.triple_key(F.col("subject")).alias("src"), T.relation_type(F.col("predicate")).alias("type"), T.triple_key(F.col("object")).alias("dst"))
    return t.groupBy("src", "type", "dst").agg(F.min("triple_id").alias("edge_id"), F.count(F.lit(1)).alias("n"))


def incident(edges: DataFrame) -> DataFrame:
    """Edges from both ends: (node, other, edge_id, type)."""
    a = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_id", "type")
    b = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_id", "type")
    return a.unionByName(b)


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, neighbour, n_edges): distinct nodes one step from each seed, in either direction."""
    return seeds.select(F.col("node_id").alias("node")).join(incident(edges), "node").groupBy(F.col("node").alias("seed"), F.col("other").alias("neighbour")).agg(F.count(F.lit(1)).alias("n_edges"))


def distances(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, dist): nodes within `hops` undirected steps of each seed, with their distance."""
    step = materialize(incident(edges).select("node", "other").distinct(), "steps")
    seen = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node"), F.lit(0).alias("dist")).distinct()
    front = seen
    for k in range(1, hops + 1):
        new = front.select("seed", "node").join(step, "node").select("seed", F.col("other").alias("node")).distinct()
        front = materialize(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("dist", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """(seed, edge_id): edges on any path of up to `hops` steps from a seed.

    These are the edges with an end within hops - 1 steps. A filter of types holds for the edges returned, not for
    the way.
    """
    near = distances(edges, seeds, hops - 1)
    own = incident(edges)
    if types:
        own = own.filter(F.col("type").isin(*types))
    return near.select("seed", "node").join(own, "node").select("seed", "edge_id").distinct()


def _wider(front: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """The fronts (a, b, of_a, node) of pairs, one step further at the end of each pair from which fewer arcs leave."""
    cost = lambda end: F.coalesce(F.sum(F.when(end, F.col("degree"))), F.lit(0))
    side = front.join(degree, "node", "left").groupBy("a", "b").agg((cost(F.col("of_a")) <= cost(~F.col("of_a"))).alias("grow"))
    both = front.join(side, ["a", "b"])
    grown = both.filter("of_a = grow").join(step, "node").select("a", "b", "of_a", F.col("other").alias("node")).distinct()
    return grown.unionByName(both.filter("of_a <> grow").select("a", "b", "of_a", "node"))


def shortest_lengths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(a, b, length) for the pairs connected within `depth` steps.

    Pairs joined by an edge are settled by it. Only the others are searched for, each from both its ends: a round makes
    the length one longer, at the end from which fewer arcs leave, and pairs whose fronts have met are left out.
    """
    # both directions of one row, so that the edges are not read and grouped twice
    arcs = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    step = materialize(edges.select(F.explode(arcs).alias("e")).select("e.*").distinct(), "steps")
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    met = pairs.filter("a = b").withColumn("length", F.lit(0))
    if depth < 1:
        return met
    # inner joins with the pairs, so that a small set of them is sent to the arcs and none of these is moved
    arc = step.select(F.col("node").alias("a"), F.col("other").alias("b"))
    apart = pairs.filter("a <> b")
    hit = materialize(arc.join(apart, ["a", "b"]), "met")
    met = met.unionByName(hit.withColumn("length", F.lit(1)))
    apart = materialize(apart.join(hit, ["a", "b"], "left_anti"), "apart")
    if depth < 2 or apart.isEmpty():
        return met
    degree = materialize(step.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ends = F.array(F.struct(F.lit(True).alias("of_a"), F.col("a").alias("node")), F.struct(F.lit(False).alias("of_a"), F.col("b").alias("node")))
    front = materialize(_wider(apart.select("a", "b", F.explode(ends).alias("e")).select("a", "b", "e.*"), step, degree), "front")
    for length in range(2, depth + 1):
        front = materialize(_wider(front, step, degree), "front")
        # the pair is not nearer than `length`, so a common node of its fronts lies on a shortest way
        hit = front.groupBy("a", "b", "node").agg(F.min("of_a").alias("l"), F.max("of_a").alias("u")).filter("l <> u").select("a", "b").distinct()
        hit = materialize(hit, "met")
        met = met.unionByName(hit.withColumn("length", F.lit(length)))
        front = front.join(hit, ["a", "b"], "left_anti")
    return met


def bridges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id): edges that connect the pair directly or through one node."""
    inc = incident(edges)
    direct = pairs.join(inc, (pairs.a == inc.node) & (pairs.b == inc.other)).select("a", "b", "edge_id")
    left = pairs.join(inc.select(F.col("node").alias("a"), F.col("other").alias("x"), F.col("edge_id").alias("e1")), "a")
    both = left.join(inc.select(F.col("node").alias("b"), F.col("other").alias("x"), F.col("edge_id").alias("e2")), ["b", "x"]).filter("x <> a AND x <> b")
    two = both.select("a", "b", F.explode(F.array("e1", "e2")).alias("edge_id"))
    return direct.unionByName(two).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each node; a loop counts twice."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def smallest_labels(pairs: DataFrame) -> DataFrame:
    """(v, m) of every vertex v of the undirected pairs (u, v) that is not the smallest, m, of its component.

    Alternating large and small stars: each round hooks neighbours to the smallest one they know, which keeps the
    components and about halves every path, so the rounds are logarithmic; it ends only when stars are left.
    """
    e = pairs.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).filter("v <> m").distinct()
    e = materialize(e, "stars")
    while True:
        arcs = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = arcs.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = materialize(arcs.filter("w > u").join(low, "u").select(F.col("w").alias("v"), "m").distinct(), "large")
        own = e.groupBy("v").agg(F.min("m").alias("low"))
        down = e.join(own, "v").filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        e = materialize(down.unionByName(own.select("v", F.col("low").alias("m"))).distinct(), "stars")
        # stars: no centre hangs on another vertex, and no vertex on two
        hangs = e.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if not hangs.filter("n > 1").limit(1).count() and not e.join(hangs.select(F.col("v").alias("m")), "m", "left_semi").limit(1).count():
            return e


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each undirected component."""
    pairs = materialize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    low = smallest_labels(pairs).select(F.col("v").alias("node"), "m")
    return nodes.join(low, "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def contract(edges: DataFrame, into: DataFrame, drop_loops: bool = True) -> DataFrame:
    """Edges after nodes were merged: `into` maps node to keep; parallel edges become one with their counts added."""
    m = into.select(F.col("node").alias("src"), F.col("keep").alias("src2"))
    k = into.select(F.col("node").alias("dst"), F.col("keep").alias("dst2"))
    e = edges.join(m, "src", "left").join(k, "dst", "left")
    e = e.select(F.coalesce("src2", "src").alias("src"), "type", F.coalesce("dst2", "dst").alias("dst"), "edge_id", "n")
    if drop_loops:
        e = e.filter("src <> dst")
    return e.groupBy("src", "type", "dst").agg(F.min("edge_id").alias("edge_id"), F.sum("n").alias("n"))


def rewrite_types(edges: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Edges with types renamed by (from, to, reverse) rules; reversed ones swap their ends; equal edges become one."""
    spark = edges.sparkSession
    r = spark.createDataFrame(rules, "type string, new string, reverse boolean")
    e = edges.join(F.broadcast(r), "type", "left")  # a fixed list of rules
    flip = F.coalesce("reverse", F.lit(False))
    e = e.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.coalesce("new", "type").alias("type"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge_id", "n")
    return e.groupBy("src", "type", "dst").agg(F.min("edge_id").alias("edge_id"), F.sum("n").alias("n"))


def duplicate_groups(nodes: DataFrame, deg: DataFrame) -> DataFrame:
    """(key, node_id, label, degree, rank): nodes whose name keys coincide; rank 1 has most edges, then the smallest id."""
    n = nodes.withColumn("key", T.name_key(F.col("name"))).filter("key <> ''").join(deg.withColumnRenamed("node", "node_id"), "node_id", "left").fillna(0, ["degree"])
    dup = n.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    w = Window.partitionBy("key").orderBy(F.desc("degree"), "node_id")
    return n.join(dup, "key").withColumn("rank", F.row_number().over(w)).select("key", "node_id", "label", "degree", "rank")


def bridged_duplicates(groups: DataFrame, edges: DataFrame, cap: int = 3) -> DataFrame:
    """(anchor, other): new RELATED_TO edges inside duplicate groups: unconnected pairs only, at most `cap` for a group."""
    a = groups.filter("rank = 1").select("key", F.col("node_id").alias("anchor"))
    pairs = groups.filter("rank > 1").select("key", F.col("node_id").alias("other"), "rank").join(a, "key")
    have = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    open_ = pairs.withColumn("x", F.least("anchor", "other")).withColumn("y", F.greatest("anchor", "other")).join(have, ["x", "y"], "left_anti")
    w = Window.partitionBy("key").orderBy("rank")
    return open_.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= cap).select("key", "anchor", "other")


def compacted_types(edges: DataFrame, canonical: list[str], rare: int = 5) -> DataFrame:
    """(type, new): types that are not canonical and have at most `rare` edges, mapped to the canonical type with the
    largest share of words in common, else RELATED_TO."""
    spark = edges.sparkSession
    c = spark.createDataFrame([(x,) for x in canonical], "canon string").withColumn("cw", F.split("canon", "_"))
    t = edges.groupBy("type").agg(F.sum("n").alias("m")).join(F.broadcast(c.select(F.col("canon").alias("type"))), "type", "left_anti").filter(F.col("m") <= rare)
    t = t.withColumn("tw", F.split("type", "_"))
    # meet on shared words, so only types with a word in common are compared
    hits = t.select("type", "tw", F.explode(F.array_distinct("tw")).alias("w")).join(F.broadcast(c.select("canon", "cw", F.explode("cw").alias("w"))), "w")
    share = F.size(F.array_intersect("tw", "cw")) / F.size(F.array_union("tw", "cw"))
    best = hits.groupBy("type").agg(F.max(F.struct(F.round(share, 9).alias("s"), F.translate("canon", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "ZYXWVUTSRQPONMLKJIHGFEDCBA~").alias("o"), "canon")).alias("b"))
    return t.select("type").join(best, "type", "left").select("type", F.coalesce(F.when(F.col("b.s") >= 0.3, F.col("b.canon")), F.lit("RELATED_TO")).alias("new"))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))
