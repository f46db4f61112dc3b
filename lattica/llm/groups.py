"""Problem 4: one group identifier for all records linked directly or through others.

Method: vertices of degree one are stripped and chains of degree-two vertices are compressed by list ranking
(pointer jumping over arcs), again and again; the reduced core is solved by large and small stars, without a round
limit; then labels are restored to the removed vertices, the last removed first.

Every vertex carries `low`, the smallest id among itself and what was folded into it, so the label of a group
is its smallest id. Nothing is collected: the driver only reads counts. Degrees and smallest labels are aggregated
before the shuffle, so a vertex with a third of all edges costs one row a task there; where such a vertex is the
key of a join, one side has it once, and the adaptive skew join splits the other.

Defined results: null ids, self pairs, pairs with an id outside `vertices`, and repeated or reversed pairs add
nothing; an empty input gives an empty result; vertices without a link are absent from `components`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.common import materialize
from lattica.operators.graph import smallest_labels

MAX_ROUNDS = 40


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (u, v), u < v, without self pairs and nulls."""
    u, v = F.least(a, b), F.greatest(a, b)
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))


def fold_low(low: DataFrame, removed: DataFrame) -> DataFrame:
    """Low values after the removed vertices (id, to, low) were folded into the vertices they hang on."""
    into = removed.groupBy(F.col("to").alias("id")).agg(F.min("low").alias("folded"))
    return low.join(removed.select("id"), "id", "left_anti").join(into, "id", "left").select("id", F.least("low", "folded").alias("low"))


def strip_leaves(edges: DataFrame, low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of degree one as (id, to, low), and the edges without them."""
    arcs = both_ways(edges)
    deg = arcs.groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.min("y").alias("to"))
    leaf = deg.filter("d = 1").select(F.col("x").alias("id"), "to")
    # of two leaves that hang on each other the smaller stays
    pair = leaf.join(leaf.select(F.col("id").alias("to"), F.col("to").alias("back")), "to", "left")
    gone = pair.filter(F.col("back").isNull() | (F.col("back") != F.col("id")) | (F.col("id") > F.col("to"))).select("id", "to")
    removed = materialize(gone.join(low, "id").select("id", "to", "low"), "leaves")
    left = edges.join(removed.select(F.col("id").alias("u")), "u", "left_anti").join(removed.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")
    return removed, left


def jump(cur: DataFrame) -> DataFrame:
    """Arcs (x, y) with the last arc they know of their list (lx, ly) moved on to the one that that arc knows."""
    nxt = cur.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("lx").alias("nx"), F.col("ly").alias("ny"), F.col("seen").alias("more"))
    return cur.drop("moved").join(nxt, ["lx", "ly"], "left").select(
        "x",
        "y",
        F.coalesce("nx", "lx").alias("lx"),
        F.coalesce("ny", "ly").alias("ly"),
        F.least("seen", "more").alias("seen"),
        F.col("nx").isNotNull().alias("moved"),
    )


def compress_chains(edges: DataFrame, low: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Vertices of degree two as (id, to, low), and the edges with each chain as one edge.

    The arcs of the chains form lists: arc x->y is followed by y->z where y has the neighbours x and z. Pointer
    jumping gives each arc the end of its list, so a chain of n vertices takes about log2(n) rounds. A ring, in
    which every vertex has degree two, has no end; its arcs have seen all of it when the rounds are over, and
    its vertices hang on the smallest of them.
    """
    arcs = both_ways(edges)
    deg = arcs.groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.min("y").alias("p"), F.max("y").alias("q"))
    two = materialize(deg.filter("d = 2").select(F.col("x").alias("m"), "p", "q"), "twos")
    n = two.count()
    if not n:
        return None
    # arcs into a vertex of degree two, with the next vertex; `far` is the vertex reached, `seen` the smallest on the way
    step = two.select(F.col("p").alias("x"), F.col("m").alias("y"), F.col("q").alias("far")).unionByName(two.select(F.col("q").alias("x"), F.col("m").alias("y"), F.col("p").alias("far")))
    # the arc after (x -> y) is (y -> far): it is in the list while far has degree two as well
    cur = step.select("x", "y", F.col("y").alias("lx"), F.col("far").alias("ly"), F.col("y").alias("seen"))
    cur = materialize(cur, "arcs")
    rounds = max(1, n.bit_length() + 1)
    for _ in range(-(-rounds // 2)):
        # two jumps for each write
        new = materialize(jump(jump(cur)), "arcs")
        cur = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    ends = cur.select(F.col("y").alias("id"), "lx", "ly", "seen")
    # an arc that still points into a vertex of degree two lies on a ring
    ring = ends.join(two.select(F.col("m").alias("ly")), "ly", "left_semi").groupBy("id").agg(F.min("seen").alias("to"))
    ring = materialize(ring, "rings")
    open_ = ends.join(ring.select("id"), "id", "left_anti")
    per = open_.groupBy("id").agg(F.min("ly").alias("to"), F.max("ly").alias("other"))
    per = materialize(per, "chains")
    gone = per.select("id", "to").unionByName(ring.filter("id <> to").select("id", "to"))
    removed = materialize(gone.join(low, "id").select("id", "to", "low"), "removed")
    out = two.select(F.col("m").alias("u"))
    kept = edges.join(out, "u", "left_anti").join(out.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
    short = per.filter("to <> other").select(F.col("to").alias("u"), F.col("other").alias("v"))
    return removed, kept.unionByName(short).distinct()


def solve_core(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Label (id, label) of every vertex of `edges`, by large and small stars, which settle in logarithmic rounds."""
    ids = both_ways(edges).select(F.col("x").alias("id")).distinct()
    hangs = smallest_labels(edges).select(F.col("v").alias("id"), "m")
    lab = materialize(ids.join(hangs, "id", "left").select("id", F.coalesce("m", "id").alias("root")), "labels")
    best = lab.join(low, "id").groupBy("root").agg(F.min("low").alias("label"))
    return lab.join(best, "root").select("id", "label")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of the undirected edges (u, v): label is the smallest id of its group."""
    edges = materialize(edges, "edges")
    low = both_ways(edges).select(F.col("x").alias("id")).distinct().select("id", F.col("id").alias("low"))
    low = materialize(low, "low")
    taken: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        removed, edges = strip_leaves(edges, low)
        edges = materialize(edges, "edges")
        taken.append(removed)
        low = materialize(fold_low(low, removed), "low")
        if not edges.limit(1).count():
            break
        got = compress_chains(edges, low)
        if got is None:
            if not removed.limit(1).count():
                break
            continue
        removed, edges = got
        edges = materialize(edges, "edges")
        low = materialize(fold_low(low, removed), "low")
        taken.append(removed)
        if not edges.limit(1).count():
            break
    if edges.limit(1).count():
        core = materialize(solve_core(edges, low), "solved")
        rest = low.join(core.select("id"), "id", "left_anti").select("id", F.col("low").alias("label"))
        label = core.unionByName(rest)
    else:
        label = low.select("id", F.col("low").alias("label"))
    for removed in reversed(taken):
        back = removed.select(F.col("id").alias("v"), F.col("to").alias("id")).join(label, "id").select(F.col("v").alias("id"), "label")
        label = materialize(label.unionByName(back), "restored")
    return label


def entity_groups(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """p4_found: registry records linked by confirmed pairs of records that both exist."""
    ids = registry.select(F.col("entity_id").alias("id")).distinct()
    yes = undirected(pairs.filter("same_entity"), "left_group", "right_group")
    yes = yes.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    return components(yes).select(F.col("id").alias("entity_id"), F.col("label").alias("group_id"))
