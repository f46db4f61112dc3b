"""Queries of the composed retrieval plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.common import table
from lattica.operators import graph as G
from lattica.operators import retrieval as R
from lattica.operators import retrieve as P
from lattica.plans.base import Book
from lattica.plans.q_graph import EDGES, INC, NODES
from lattica.plans.q_retrieval import BM25, SQL as RETRIEVAL_SQL, W
from lattica.plans.q_text import STOP_SQL

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql

TERMS = f"terms AS (SELECT DISTINCT query_id AS query, unnest(list_filter(list_distinct({W.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x))) AS token FROM questions)"
FOUND = f"""nw AS (SELECT node_id AS key, unnest(list_distinct({W.format('name')})) AS token FROM nodes), ndf AS (SELECT token, count(*) AS df FROM nw GROUP BY token), nn AS (SELECT count(DISTINCT key) AS n FROM nw),
nsc AS (SELECT query, key, round(sum(least(3.0, greatest(1.0, log10(n / df)))), 6) AS score FROM nw JOIN terms USING (token) JOIN ndf USING (token), nn GROUP BY query, key),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM nsc) WHERE rank <= 10),
anchors AS (SELECT query, key AS node_id, rank FROM found WHERE rank <= 5 AND NOT regexp_matches(key, '^(entity|node|item) [a-z]$'))"""


def _expansion_sql(name: str, most: int, hops: int, limit: int) -> str:
    near = f"SELECT DISTINCT node_id AS seed, node_id AS node FROM {name}_a"
    if hops == 2:
        near += f" UNION SELECT DISTINCT node_id, other FROM {name}_a JOIN inc ON node = node_id"
    return f"""{name}_a AS (SELECT * FROM anchors WHERE rank <= {most}), {name}_n AS ({near}),
{name}_s AS (SELECT seed, edge_id, row_number() OVER (PARTITION BY seed ORDER BY edge_id) AS k FROM (SELECT DISTINCT seed, edge_id FROM {name}_n JOIN inc USING (node))),
{name}_b AS (SELECT query, {limit} // count(*) AS budget FROM {name}_a GROUP BY query),
{name} AS (SELECT query, edge_id, row_number() OVER (PARTITION BY query ORDER BY p, edge_id) AS rank FROM (SELECT query, edge_id, min((rank, k)) AS p FROM {name}_a JOIN {name}_b USING (query) JOIN {name}_s ON seed = node_id WHERE k <= budget GROUP BY query, edge_id))"""


GRAPH = f"{NODES}, {EDGES}, {INC}, {TERMS}, {FOUND}"
RETRIEVED = f"""WITH {GRAPH}, {_expansion_sql('neigh', 5, 1, 30)}, {_expansion_sql('expan', 2, 2, 60)}, {BM25},
txt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores) WHERE rank <= 6),
tri AS ({RETRIEVAL_SQL['R13_ranked_triples']}),
retrieved AS (SELECT query, 'text' AS channel, key::VARCHAR AS key, score, rank::INT AS rank FROM txt UNION ALL SELECT query, 'nodes', key, score, rank FROM found UNION ALL SELECT query, 'triples', triple_id::VARCHAR, score, rank FROM tri
UNION ALL SELECT query, 'neighbors', edge_id::VARCHAR, 0.0, rank FROM neigh UNION ALL SELECT query, 'expansion', edge_id::VARCHAR, 0.0, rank FROM expan)"""


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "questions").select(F.col("query_id").alias("query"), "question").distinct()


def _retrieved(spark, d) -> DataFrame:
    return P.retrieve(table(spark, d, "triples"), table(spark, d, "documents"), _questions(spark, d))


def _found(spark, d) -> DataFrame:
    return P.node_search(G.node_table(table(spark, d, "triples")), P.query_terms(_questions(spark, d)), 10)


@BOOK.add("R16_retrieved", f"{RETRIEVED} SELECT query, channel, key, score, rank FROM retrieved")
def r16(spark, d) -> DataFrame:
    return _retrieved(spark, d)


@BOOK.add("R23_modes", f"{RETRIEVED} SELECT mode, query, channel, key, rank FROM retrieved JOIN (VALUES " + ", ".join(f"('{m}', '{c}')" for m, cs in P.MODES.items() for c in cs) + ") m(mode, channel) USING (channel)")
def r23(spark, d) -> DataFrame:
    return P.by_mode(_retrieved(spark, d))


@BOOK.add("R12_R26_anchors", f"WITH {NODES}, {TERMS}, {FOUND} SELECT query, node_id, rank::INT AS rank FROM anchors")
def r12(spark, d) -> DataFrame:
    return P.seeds(_found(spark, d))


@BOOK.add("R14_expanded", f"WITH {GRAPH}, {_expansion_sql('expan', 5, 2, 60)} SELECT query, edge_id::VARCHAR AS key, rank::INT AS rank FROM expan")
def r14(spark, d) -> DataFrame:
    return P.expansion(G.edge_table(table(spark, d, "triples")), P.seeds(_found(spark, d)), 2, 60).select("query", "key", "rank")


PRESET_CHANNELS = {k: tuple(c for c, on in (("text", p.text), ("nodes", p.nodes), ("triples", p.triples), ("neighbors", p.neighbors), ("expansion", p.subgraph)) if on) for k, p in R.PRESETS.items()}


@BOOK.add("R18_preset_evidence", f"{RETRIEVED} SELECT preset, channel, count(*) AS rows, count(DISTINCT query) AS queries FROM retrieved JOIN (VALUES " + ", ".join(f"('{m}', '{c}')" for m, cs in PRESET_CHANNELS.items() for c in cs) + ") m(preset, channel) USING (channel) GROUP BY preset, channel")
def r18(spark, d) -> DataFrame:
    """What each preset gets from each of its channels."""
    return P.by_mode(_retrieved(spark, d), PRESET_CHANNELS).groupBy(F.col("mode").alias("preset"), "channel").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("query").alias("queries"))


R11 = """f AS (SELECT query, key, min((c, rank)) AS p FROM (SELECT query, edge_id AS key, 0 AS c, rank FROM neigh WHERE rank <= 10 UNION ALL SELECT query, triple_id, 1, rank FROM tri) GROUP BY query, key)"""


@BOOK.add("R11_triple_collection", f"WITH {GRAPH}, {_expansion_sql('neigh', 5, 1, 30)}, tri AS ({RETRIEVAL_SQL['R13_ranked_triples']}), {R11} SELECT query, key, rank FROM (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY p, key)::INT AS rank FROM f) WHERE rank <= 25")
def r11(spark, d) -> DataFrame:
    """Triples around the anchors first, then the ranked ones, each once, until the limit."""
    near = P.expansion(G.edge_table(table(spark, d, "triples")), P.seeds(_found(spark, d)), 1, 30).filter("rank <= 10").select("query", F.col("key").cast("long").alias("key"), "rank")
    words = _questions(spark, d).select("query", R.T.search_words(F.col("question")).alias("words")).filter(F.size("words") > 0)
    ranked = R.top_k(R.ranked_triples(table(spark, d, "triples"), words).withColumnRenamed("triple_id", "key"), 20)
    return R.merged([near, ranked.select("query", "key", "rank")], 25)


ITEMS_BM25 = BM25.replace("query_id AS query", "item_id AS query").replace("FROM questions", "FROM eval_items")


@BOOK.add("R22_multi_query", f"""WITH {ITEMS_BM25}, mem AS (SELECT * FROM (SELECT grp, item_id AS query, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS n FROM (SELECT DISTINCT md5(passage) AS grp, item_id FROM eval_items WHERE passage IS NOT NULL)) WHERE n <= 4),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores) WHERE rank <= 10), b AS (SELECT grp, key, max(score) AS score FROM top JOIN mem USING (query) GROUP BY grp, key)
SELECT * FROM (SELECT grp AS "group", key, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, key)::INT AS rank FROM b) WHERE rank <= 10""")
def r22(spark, d) -> DataFrame:
    """The questions of one passage as one search: up to four rankings merged by best score."""
    items = table(spark, d, "eval_items")
    ranked = R.bm25_top_k(table(spark, d, "documents"), "doc_id", "text", items.select("item_id", "question").distinct(), "item_id", "question", 10)
    members = items.filter("passage IS NOT NULL").select(F.md5("passage").alias("group"), F.col("item_id").alias("query")).distinct()
    return P.merged_queries(ranked, members, 10)


@BOOK.add("R25_text_agent", f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores)
SELECT query, string_agg(CASE WHEN d.source IS NULL THEN '' ELSE 'Source: ' || d.source || chr(10) END || coalesce(d.text, ''), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r JOIN documents d ON r.key = d.doc_id WHERE rank <= 3 GROUP BY query""")
def r25(spark, d) -> DataFrame:
    """The first three whole texts of each question under their sources, joined by a rule."""
    docs = table(spark, d, "documents")
    top = R.top_k(R.bm25_scores(docs, "doc_id", "text", _questions(spark, d), "query", "question"), 3)
    t = top.join(docs.select(F.col("doc_id").alias("key"), "source", "text"), "key")
    block = F.concat(F.coalesce(F.concat(F.lit("Source: "), "source", F.lit("\n")), F.lit("")), F.coalesce("text", F.lit("")))
    items = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return t.groupBy("query").agg(F.array_join(F.transform(items, lambda x: x["b"]), "\n---\n").alias("context"))
