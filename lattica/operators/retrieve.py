"""One retrieval plan: seeds of a question, channels that read graph and text, and their ordered union.

Every channel is a frame (query, channel, key, score, rank), made for all questions at once; the union has a
`channel` column, and a mode or preset only chooses among channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded, materialize
from lattica.functions import text as T
from lattica.operators import graph as G
from lattica.operators import retrieval as R

MODES = {"TEXT": ("text",), "KG": ("nodes", "triples", "neighbors"), "HYBRID": ("text", "nodes", "triples", "neighbors"), "MULTIHOP": ("expansion",)}


def query_terms(questions: DataFrame) -> DataFrame:
    """(query, token): the search words of the questions (query, question)."""
    return questions.select("query", F.explode(T.search_words(F.col("question"))).alias("token")).distinct()


def node_search(nodes: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank): nodes whose names share search words with the query; rare words weigh more."""
    words = materialize(nodes.select(F.col("node_id").alias("key"), F.explode(F.array_distinct(T.words(F.col("name")))).alias("token")), "namewords")
    size = words.agg(F.countDistinct("key").alias("n"))
    df = words.join(bounded(terms.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    boost = F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.log10(F.col("n") / F.col("df"))))
    weights = terms.join(df, "token").join(F.broadcast(size)).select("query", "token", boost.alias("w"))
    scores = words.join(bounded(weights), "token").groupBy("query", "key").agg(F.round(F.sum("w"), 6).alias("score"))
    return R.top_k(scores, k)


def seeds(found: DataFrame, most: int = 5) -> DataFrame:
    """(query, node_id, rank): the anchors of a query, the best nodes found for it; placeholders are none."""
    return found.filter(F.col("rank") <= most).filter(~F.col("key").rlike("^(entity|node|item) [a-z]$")).select("query", F.col("key").alias("node_id"), "rank")


def expansion(edges: DataFrame, anchors: DataFrame, hops: int, limit: int) -> DataFrame:
    """(query, key, score, rank): edges within `hops` steps of each anchor; the anchors of a query share the limit.

    Each anchor may give limit // anchors edges, the smallest ids first; an edge of several anchors comes once.
    """
    sub = G.subgraph(edges, anchors.select("node_id").distinct(), hops)
    share = anchors.groupBy("query").agg(F.floor(F.lit(limit) / F.count(F.lit(1))).alias("budget"))
    w = Window.partitionBy("seed").orderBy("edge_id")
    # no anchor gives more than the whole limit, so the rest is cut before it meets the queries
    first = materialize(sub.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit), "expanded")
    got = anchors.withColumnRenamed("node_id", "seed").join(share, "query").join(first, "seed").filter("k <= budget")
    one = got.groupBy("query", "edge_id").agg(F.min(F.struct("rank", "k")).alias("p"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("p", "edge_id"))
    return one.select("query", F.col("edge_id").cast("string").alias("key"), F.lit(0.0).alias("score"), rank.alias("rank"))


def channel(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("query", F.lit(name).alias("channel"), F.col("key").cast("string").alias("key"), "score", "rank")


def retrieve(triples: DataFrame, documents: DataFrame, questions: DataFrame, n_nodes: int = 10, n_triples: int = 20, n_text: int = 6, limit: int = 60) -> DataFrame:
    """(query, channel, key, score, rank): all channels of all questions (query, question).

    nodes: lexical node search; triples: ranked triples; neighbors and expansion: edges one and two steps from the anchors;
    text: BM25 over the documents. A question without search words has text evidence at most.
    """
    edges = materialize(G.edge_table(triples), "graph")
    terms = materialize(query_terms(questions), "terms")
    found = materialize(node_search(G.node_table(triples), terms, n_nodes), "nodes")
    anchors = seeds(found)
    words = questions.select("query", T.search_words(F.col("question")).alias("words")).filter(F.size("words") > 0).distinct()
    ranked = R.top_k(R.ranked_triples(triples, words).withColumnRenamed("triple_id", "key"), n_triples)
    text = R.top_k(R.bm25_scores(documents, "doc_id", "text", questions, "query", "question"), n_text)
    parts = [
        channel(text, "text"),
        channel(found, "nodes"),
        channel(ranked, "triples"),
        channel(expansion(edges, anchors, 1, limit // 2), "neighbors"),
        channel(expansion(edges, anchors.filter("rank <= 2"), 2, limit), "expansion"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "retrieved")


def by_mode(retrieved: DataFrame, modes: dict[str, tuple[str, ...]] = MODES) -> DataFrame:
    """(mode, query, channel, key, rank): what each mode reads of the channels."""
    wanted = F.create_map(*[x for m, cs in modes.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in cs]))])
    each = retrieved.select("*", F.explode(wanted).alias("mode", "reads")).filter(F.array_contains("reads", F.col("channel")))
    return each.select("mode", "query", "channel", "key", "rank")


def merged_queries(ranked: DataFrame, members: DataFrame, k: int, most: int = 4) -> DataFrame:
    """(group, key, score, rank): the rankings of up to `most` queries of a group as one, each key with its best score.

    members: (group, query).
    """
    w = Window.partitionBy("group").orderBy("query")
    own = members.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")
    best = ranked.join(own, "query").groupBy("group", "key").agg(F.max("score").alias("score"))
    return R.top_k(best, k, group="group")
