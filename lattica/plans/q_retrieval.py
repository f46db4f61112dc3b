"""Queries of retrieval (family R, U, O, parts of J and W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import table
from lattica.functions import text as T
from lattica.operators import ranks as K
from lattica.operators import retrieval as R
from lattica.plans.base import Book
from lattica.plans.q_text import STOP_SQL

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql

W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
BM25 = f"""post AS (SELECT token, doc_id AS key, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM (SELECT doc_id, {W.format('text')} AS w FROM documents)) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT key, dl FROM post)),
q AS (SELECT DISTINCT query_id AS query, unnest(list_distinct({W.format('question')})) AS token FROM questions),
scores AS (SELECT query, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN df USING (token) JOIN q USING (token), size GROUP BY query, key)"""


def _scores(spark, d):
    return R.bm25_scores(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "questions").select("query_id", "question").distinct(), "query_id", "question")


@BOOK.add("R01_bm25_idf", f"WITH {BM25} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, size")
def r01(spark, d) -> DataFrame:
    df, size = R.index_stats(R.postings(table(spark, d, "documents"), "doc_id", "text")), R.corpus_size(table(spark, d, "documents"), "text")
    return df.join(F.broadcast(size)).select("token", "df", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@BOOK.add("R02_bm25_topk", f"WITH {BM25} SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM scores) WHERE rank <= 10")
def r02(spark, d) -> DataFrame:
    return R.top_k(_scores(spark, d), 10)


@BOOK.add("R03_lexical_mmr")
def r03(spark, d) -> DataFrame:
    pool = R.top_k(_scores(spark, d), 20)
    toks = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.array_distinct(T.words(F.col("text"))).alias("tokens"))
    return R.mmr(pool.join(toks, "key"), 5)


VEC = """u AS (SELECT vec_id AS key, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"""


@BOOK.add("R04_vector_topk", f"WITH {VEC}, s AS (SELECT a.key AS query, b.key, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.key % 100 = 0) SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM s) WHERE rank <= 10")
def r04(spark, d) -> DataFrame:
    v = R.unit(table(spark, d, "embeddings"), "vec_id", "embedding")
    return R.vector_top_k(v, v.filter("key % 100 = 0"), 10)


@BOOK.add("R05_label_vote", f"""WITH {VEC}, s AS (SELECT a.key AS query, b.label, row_number() OVER (PARTITION BY a.key ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.key) AS r FROM u a, u b WHERE a.key % 100 = 0 AND a.key <> b.key),
c AS (SELECT query, label, count(*) AS votes FROM s WHERE r <= 10 GROUP BY query, label) SELECT query, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM c) WHERE k = 1""")
def r05(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = R.unit(e, "vec_id", "embedding")
    near = R.vector_top_k(v, v.filter("key % 100 = 0"), 11).filter("query <> key")
    w = Window.partitionBy("query")
    near = near.withColumn("r", F.row_number().over(w.orderBy("rank"))).filter("r <= 10").join(e.select(F.col("vec_id").alias("key"), "label"), "key")
    c = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    return c.withColumn("k", F.row_number().over(w.orderBy(F.desc("votes"), "label"))).filter("k = 1").drop("k")


@BOOK.add("J11_similar_vectors")
def j11(spark, d) -> DataFrame:
    """Pairs of representatives; J11_vector_copies tells which rows each stands for."""
    return R.similar_pairs(R.unit(table(spark, d, "embeddings"), "vec_id", "embedding"), 0.5)


@BOOK.add("J11_vector_copies", f"WITH {VEC} SELECT key, min(key) OVER (PARTITION BY v) AS representative FROM u")
def j11_copies(spark, d) -> DataFrame:
    return R.exact_copies(R.unit(table(spark, d, "embeddings"), "vec_id", "embedding")).select("key", "representative")


@BOOK.add("R06_node_search", f"""WITH n AS (SELECT DISTINCT entity_id, canonical_name FROM registry WHERE canonical_name IS NOT NULL), t AS (SELECT entity_id, unnest(list_distinct({W.format('canonical_name')})) AS token FROM n),
df AS (SELECT token, count(DISTINCT entity_id) AS df FROM t GROUP BY token), s AS (SELECT count(DISTINCT entity_id) AS n FROM t),
q AS (SELECT query_id AS query, unnest(list_filter(list_distinct({W.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x))) AS token FROM questions),
sc AS (SELECT query, entity_id AS key, round(sum(least(3.0, greatest(1.0, log10(n / df)))), 6) AS score FROM (SELECT DISTINCT * FROM t) t JOIN q USING (token) JOIN df USING (token), s GROUP BY query, entity_id)
SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM sc) WHERE rank <= 10""")
def r06(spark, d) -> DataFrame:
    n = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select(F.col("entity_id").alias("key"), F.explode(F.array_distinct(T.words(F.col("canonical_name")))).alias("token")).distinct()
    df = n.groupBy("token").agg(F.countDistinct("key").alias("df"))
    size = n.agg(F.countDistinct("key").alias("n"))
    q = table(spark, d, "questions").select(F.col("query_id").alias("query"), F.explode(T.search_words(F.col("question"))).alias("token"))
    boost = F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.log10(F.col("n") / F.col("df"))))
    sc = n.join(q, "token").join(df, "token").join(F.broadcast(size)).groupBy("query", "key").agg(F.round(F.sum(boost), 6).alias("score"))
    return R.top_k(sc, 10)


@BOOK.add("R13_ranked_triples", f"""WITH t AS (SELECT triple_id, list_filter(list_distinct({W.format("concat_ws(' ', subject, replace(predicate, '_', ' '), object)")}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS tw,
  greatest(1, coalesce(TRY_CAST(relationship_properties['mention_count'] AS INT), 1)) AS m, coalesce(relationship_properties['extraction_method'] = 'system_linking', false) AS link FROM triples),
q AS (SELECT query_id AS query, list_filter(list_distinct({W.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS qw FROM questions),
tt AS (SELECT triple_id, m, link, unnest(tw) AS w FROM t), qq AS (SELECT query, len(qw) AS n, unnest(qw) AS w FROM q),
h AS (SELECT query, n, triple_id, m, link, count(*) AS c FROM tt JOIN qq USING (w) GROUP BY ALL),
x AS (SELECT *, max(m) OVER (PARTITION BY query) AS most FROM h),
s AS (SELECT query, triple_id, round((0.7 * c / n + 0.3 * CASE WHEN most <= 1 THEN 1.0 ELSE ln(1 + m) / ln(1 + most) END) * CASE WHEN link THEN 0.5 ELSE 1.0 END, 6) AS score FROM x)
SELECT query, triple_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, triple_id)::INT AS rank FROM s) WHERE rank <= 20""")
def r13(spark, d) -> DataFrame:
    q = table(spark, d, "questions").select(F.col("query_id").alias("query"), T.search_words(F.col("question")).alias("words")).filter(F.size("words") > 0)
    return R.top_k(R.ranked_triples(table(spark, d, "triples"), q), 20, key="triple_id")


@BOOK.add("R15_capped_sources", f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores), p AS (SELECT r.query, r.key, r.rank, coalesce(d.source, '') AS source FROM r JOIN documents d ON r.key = d.doc_id WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY rank) > 2 AS over FROM p) SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY over, rank)::INT AS rank FROM o""")
def r15(spark, d) -> DataFrame:
    pool = R.top_k(_scores(spark, d), 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("source")), "key")
    return R.capped(pool, "query", "source", 2).select("query", "key", F.col("new_rank").alias("rank"))


@BOOK.add("R10_merged_channels", f"""WITH {BM25}, a AS (SELECT query, key, 0 AS channel, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS r FROM scores),
lang AS (SELECT query, key, 1 AS channel, row_number() OVER (PARTITION BY query ORDER BY d.n_chars DESC, key) AS r FROM scores JOIN documents d ON key = d.doc_id WHERE score > 5),
u AS (SELECT query, key, min((channel, r)) AS p FROM (SELECT * FROM a WHERE r <= 5 UNION ALL SELECT * FROM lang WHERE r <= 10) GROUP BY query, key)
SELECT query, key, rank FROM (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY p, key)::INT AS rank FROM u) WHERE rank <= 10""")
def r10(spark, d) -> DataFrame:
    s = _scores(spark, d)
    long = s.filter("score > 5").join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars"), "key")
    return R.merged([R.top_k(s, 5), R.top_k(long, 10, score="n_chars")], 10)


@BOOK.add("R14_seeded_budgets", "SELECT query_id AS query, greatest(1, 60 // greatest(1, len(list_filter(list_distinct(" + W.format("question") + f"), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)))))::BIGINT AS budget FROM questions")
def r14(spark, d) -> DataFrame:
    n = F.greatest(F.lit(1), F.size(T.search_words(F.col("question"))))
    return table(spark, d, "questions").select(F.col("query_id").alias("query"), F.greatest(F.lit(1), F.floor(F.lit(60) / n)).cast("long").alias("budget"))


@BOOK.add("R17_contexts", f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores)
SELECT query, string_agg('[' || rank || '] ' || left(d.text, 300), chr(10) ORDER BY rank) AS context FROM r JOIN documents d ON r.key = d.doc_id WHERE rank <= 3 GROUP BY query""")
def r17(spark, d) -> DataFrame:
    top = R.top_k(_scores(spark, d), 3).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.substring("text", 1, 300).alias("t")), "key")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("t"))
    items = F.array_sort(F.collect_list(F.struct("rank", line.alias("l"))))
    return top.groupBy("query").agg(F.array_join(F.transform(items, lambda x: x["l"]), "\n").alias("context"))


@BOOK.add("R18_preset_channels", "SELECT p.preset, p.nodes, p.triples, p.neighbors, p.subgraph, p.path, p.text, p.hops, count(r.result_id) AS n_results FROM (VALUES " + ", ".join(f"('{k}', {p.nodes}, {p.triples}, {p.neighbors}, {p.subgraph}, {p.path}, {p.text}, {p.hops})" for k, p in R.PRESETS.items()) + ") p(preset, nodes, triples, neighbors, subgraph, path, text, hops) LEFT JOIN (SELECT DISTINCT result_id, regexp_replace(lower(trim(strategy)), '[\\s-]+', '_', 'g') AS s FROM results) r ON r.s = p.preset GROUP BY ALL".replace("\\\\", "\\"))
def r18(spark, d) -> DataFrame:
    rows = [(k, p.nodes, p.triples, p.neighbors, p.subgraph, p.path, p.text, p.hops) for k, p in R.PRESETS.items()]
    p = spark.createDataFrame(rows, "preset string, nodes boolean, triples boolean, neighbors boolean, subgraph boolean, path boolean, text boolean, hops int")
    n = table(spark, d, "results").select("result_id", F.regexp_replace(F.lower(F.trim("strategy")), r"[\s-]+", "_").alias("preset")).distinct().groupBy("preset").agg(F.count(F.lit(1)).alias("c"))
    return F.broadcast(p).join(n, "preset", "left").select("preset", "nodes", "triples", "neighbors", "subgraph", "path", "text", "hops", F.coalesce("c", F.lit(0)).alias("n_results"))


@BOOK.add("R20_context_recall", f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores),
c AS (SELECT query, list_distinct(flatten(list({W.format('d.text')}))) AS words FROM r JOIN documents d ON r.key = d.doc_id WHERE rank <= 5 GROUP BY query),
qs AS (SELECT query_id AS query, list_filter(list_distinct({W.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS qw FROM questions)
SELECT qs.query, round(len(list_intersect(qw, words)) / len(qw), 6) AS recall FROM qs JOIN c ON qs.query = c.query WHERE len(qw) > 0""")
def r20(spark, d) -> DataFrame:
    top = R.top_k(_scores(spark, d), 5).select("query", "key").join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")), "key").select("query", "w").distinct()
    q = table(spark, d, "questions").select(F.col("query_id").alias("query"), T.search_words(F.col("question")).alias("qw")).filter(F.size("qw") > 0)
    have = _scores(spark, d).select("query").distinct()
    words = q.select("query", F.size("qw").alias("n"), F.explode("qw").alias("w")).join(top.withColumn("hit", F.lit(1)), ["query", "w"], "left")
    return words.groupBy("query", "n").agg(F.round(F.count("hit") / F.col("n"), 6).alias("recall")).join(have, "query", "left_semi").select("query", "recall")


@BOOK.add("F25_term_boosts", f"""WITH t AS (SELECT doc_id, unnest(list_distinct({W.format('text')})) AS token FROM documents) SELECT token, round(least(3.0, greatest(1.0, log10((SELECT count(*) FROM documents) / count(*)))), 6) AS boost FROM t GROUP BY token""")
def f25(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", F.round(F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.log10(F.col("n") / F.col("df")))), 6).alias("boost"))


@BOOK.add("F23_search_terms_rarest", f"""WITH t AS (SELECT doc_id, unnest(list_distinct({W.format('text')})) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM t GROUP BY token),
q AS (SELECT DISTINCT query_id AS query, unnest({W.format('question')}) AS token FROM questions), k AS (SELECT query, q.token, coalesce(df, 0) AS df FROM q LEFT JOIN df ON q.token = df.token WHERE length(q.token) >= 3 AND NOT list_contains({STOP_SQL}, q.token))
SELECT query, token, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY df, token)::INT AS rank FROM k) WHERE rank <= 8""")
def f23(spark, d) -> DataFrame:
    df = table(spark, d, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    q = table(spark, d, "questions").select(F.col("query_id").alias("query"), F.explode(T.search_words(F.col("question"))).alias("token")).distinct()
    k = q.join(df, "token", "left").fillna(0, ["df"])
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("df", "token"))).filter("rank <= 8").select("query", "token", "rank")


@BOOK.add("U07_question_jaccard", f"""WITH q AS (SELECT query_id, list_filter(list_distinct({W.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS s FROM questions)
SELECT a, b, round(j, 6) AS jaccard FROM (SELECT a.query_id AS a, b.query_id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM q a JOIN q b ON a.query_id < b.query_id WHERE len(list_intersect(a.s, b.s)) > 0) WHERE round(j, 6) >= 0.75""")
def u07(spark, d) -> DataFrame:
    q = table(spark, d, "questions").select("query_id", T.search_words(F.col("question")).alias("s")).withColumn("n", F.size("s"))
    df = q.select(F.explode("s").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # prefix filter: similar sets share one of their rarest words
    w = Window.partitionBy("query_id").orderBy("df", "w")
    r = q.select("query_id", "n", F.explode("s").alias("w")).join(df, "w").withColumn("k", F.row_number().over(w))
    head = r.filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * 0.75) + 1)
    a, b = head.select(F.col("query_id").alias("a"), "w"), head.select(F.col("query_id").alias("b"), "w")
    cand = a.join(b, "w").filter("a < b").select("a", "b").distinct()
    full = cand.join(q.select(F.col("query_id").alias("a"), F.col("s").alias("sa")), "a").join(q.select(F.col("query_id").alias("b"), F.col("s").alias("sb")), "b")
    j = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return full.select("a", "b", F.round(j, 6).alias("jaccard")).filter("jaccard >= 0.75")


@BOOK.add("O01_ordered_limit", "SELECT triple_id, subject, score FROM (SELECT triple_id, subject, round(coalesce(TRY_CAST(relationship_properties['confidence'] AS DOUBLE), 0.0), 6) AS score FROM triples) ORDER BY score DESC, triple_id LIMIT 50")
def o01(spark, d) -> DataFrame:
    s = F.round(F.coalesce(F.col("relationship_properties")["confidence"].try_cast("double"), F.lit(0.0)), 6)
    return table(spark, d, "triples").select("triple_id", "subject", s.alias("score")).orderBy(F.desc("score"), "triple_id").limit(50)


@BOOK.add("O04_canonical_order", "SELECT entity_id, alias AS canonical FROM (SELECT entity_id, alias, row_number() OVER (PARTITION BY entity_id ORDER BY length(alias) DESC, lower(alias), alias) AS r FROM (SELECT entity_id, unnest(aliases) AS alias FROM registry)) WHERE r = 1")
def o04(spark, d) -> DataFrame:
    a = table(spark, d, "registry").select("entity_id", F.explode("aliases").alias("alias"))
    best = F.min(F.struct((-F.length("alias")).alias("n"), F.lower("alias").alias("l"), "alias")).alias("b")
    return a.groupBy("entity_id").agg(best).select("entity_id", F.col("b.alias").alias("canonical"))


@BOOK.add("O05_shortest_canonical", "SELECT group_key AS key, name FROM (SELECT lower(regexp_replace(canonical_name, '[^A-Za-z0-9]+', '', 'g')) AS group_key, canonical_name AS name, row_number() OVER (PARTITION BY lower(regexp_replace(canonical_name, '[^A-Za-z0-9]+', '', 'g')) ORDER BY starts_with(lower(canonical_name), 'the '), length(canonical_name), canonical_name) AS r FROM registry WHERE canonical_name IS NOT NULL) WHERE r = 1")
def o05(spark, d) -> DataFrame:
    n = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select(F.lower(F.regexp_replace("canonical_name", "[^A-Za-z0-9]+", "")).alias("key"), F.col("canonical_name").alias("name"))
    best = F.min(F.struct(F.lower("name").startswith("the ").alias("t"), F.length("name").alias("n"), "name")).alias("b")
    return n.groupBy("key").agg(best).select("key", F.col("b.name").alias("name"))


@BOOK.add("O08_seeded_shuffle", "SELECT result_id, row_number() OVER (ORDER BY md5(result_id || '7'), result_id) AS position FROM (SELECT DISTINCT result_id FROM results WHERE result_id IS NOT NULL)")
def o08(spark, d) -> DataFrame:
    q = table(spark, d, "results").filter("result_id IS NOT NULL").select("result_id", F.md5(F.concat(F.col("result_id").cast("string"), F.lit("7"))).alias("h")).distinct()
    return K.numbered(q, [], ["h", "result_id"], "position").select("result_id", "position")
