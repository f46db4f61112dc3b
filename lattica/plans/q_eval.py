"""Queries of evaluation: joins of runs with gold, metrics, statistics, reports (families A, J, M, T, L, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded, materialize, table
from lattica.functions import text as T
from lattica.operators import extract
from lattica.operators import metrics as M
from lattica.operators import ranks as K
from lattica.operators import retrieval as R
from lattica.plans.base import Book

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql

PRESET = "regexp_replace(lower(trim(strategy)), '[\\s-]+', '_', 'g')"
# one row for each execution: deliveries of one result_id have equal content
RUNS = f"""runs AS (SELECT result_id, min({PRESET}) AS strategy, min(query_id) AS query_id, min(question) AS question, min(answer) AS answer, min(CASE WHEN isnan(latency_ms) OR latency_ms < 0 THEN NULL ELSE latency_ms END) AS latency,
  min(sub_questions) AS sub_questions, min(kg_triples_used) AS kg_triples_used, bool_or(insufficient_answer) AS insufficient, min(metadata['model_id']) AS model, min(metadata['run_index']) AS run_index, min(started_at) AS started_at FROM results GROUP BY result_id)"""


def _runs(spark, d) -> DataFrame:
    lat = F.when(F.isnan("latency_ms") | (F.col("latency_ms") < 0), None).otherwise(F.col("latency_ms"))
    preset = F.regexp_replace(F.lower(F.trim("strategy")), r"[\s-]+", "_")
    r = table(spark, d, "results")
    return r.groupBy("result_id").agg(
        F.min(preset).alias("strategy"), F.min("query_id").alias("query_id"), F.min("question").alias("question"), F.min("answer").alias("answer"), F.min(lat).alias("latency"), F.min("sub_questions").alias("sub_questions"),
        F.min("kg_triples_used").alias("kg_triples_used"), F.bool_or("insufficient_answer").alias("insufficient"), F.min(F.col("metadata")["model_id"]).alias("model"), F.min(F.col("metadata")["run_index"]).alias("run_index"), F.min("started_at").alias("started_at"),
    )


# ---- J: joins of runs and gold


@BOOK.add("J01_runs_with_questions", f"WITH {RUNS} SELECT result_id, q.query_id, q.lang FROM runs r JOIN questions q ON r.query_id = q.query_id")
def j01(spark, d) -> DataFrame:
    return _runs(spark, d).join(table(spark, d, "questions").select("query_id", "lang"), "query_id").select("result_id", "query_id", "lang")


QKEY = "translate(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '^ +| +$', '', 'g'), '[?!.,;: ]+$', '', 'g'), '" + T.MARKED + "', '" + T.PLAIN + "')"


@BOOK.add("J02_fallback_join", f"""WITH {RUNS}, k AS (SELECT query_id, {QKEY.format('question')} AS qk FROM questions), u AS (SELECT qk, min(query_id) AS query_id FROM k GROUP BY qk HAVING count(*) = 1)
SELECT r.result_id, coalesce(q.query_id, u.query_id) AS query_id, CASE WHEN q.query_id IS NOT NULL THEN 'id' WHEN u.query_id IS NOT NULL THEN 'text' ELSE 'none' END AS joined_by
FROM runs r LEFT JOIN questions q ON r.query_id = q.query_id LEFT JOIN u ON u.qk = {QKEY.format('r.question')}""")
def j02(spark, d) -> DataFrame:
    q = table(spark, d, "questions").select(F.col("query_id").alias("gid"), T.question_key(F.col("question")).alias("qk"))
    unique = q.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("qk"))).filter("c = 1").select("qk", F.col("gid").alias("tid"))
    r = _runs(spark, d).withColumn("qk", T.question_key(F.col("question")))
    j = r.join(q.select("gid"), r.query_id == q.gid, "left").join(unique, "qk", "left")
    by = F.when(F.col("gid").isNotNull(), "id").when(F.col("tid").isNotNull(), "text").otherwise("none")
    return j.select("result_id", F.coalesce("gid", "tid").alias("query_id"), by.alias("joined_by"))


@BOOK.add("J04_positional_join", """WITH a AS (SELECT left_group AS k, pair_id, row_number() OVER (PARTITION BY left_group ORDER BY pair_id) AS n FROM match_pairs), b AS (SELECT right_group AS k, pair_id, row_number() OVER (PARTITION BY right_group ORDER BY pair_id) AS n FROM match_pairs)
SELECT a.k, a.n, a.pair_id AS left_pair, b.pair_id AS right_pair FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def j04(spark, d) -> DataFrame:
    m = table(spark, d, "match_pairs")
    a = m.select(F.col("left_group").alias("k"), F.col("pair_id").alias("left_pair"), F.row_number().over(Window.partitionBy("left_group").orderBy("pair_id")).cast("long").alias("n"))
    b = m.select(F.col("right_group").alias("k"), F.col("pair_id").alias("right_pair"), F.row_number().over(Window.partitionBy("right_group").orderBy("pair_id")).cast("long").alias("n"))
    return a.join(b, ["k", "n"])


@BOOK.add("J09_semi_join", "SELECT chunk_id, count(*) AS n FROM chunks WHERE chunk_id IN (SELECT relationship_properties['chunk_id'] FROM triples) GROUP BY chunk_id")
def j09(spark, d) -> DataFrame:
    t = table(spark, d, "triples").select(F.col("relationship_properties")["chunk_id"].alias("chunk_id"))
    return table(spark, d, "chunks").join(t, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("J10_anti_join", "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT relationship_properties['chunk_id'] FROM triples WHERE relationship_properties['chunk_id'] IS NOT NULL)")
def j10(spark, d) -> DataFrame:
    t = table(spark, d, "triples").select(F.col("relationship_properties")["chunk_id"].alias("chunk_id"))
    return table(spark, d, "chunks").select("chunk_id").join(t, "chunk_id", "left_anti").distinct()


@BOOK.add("J14_page_range_join", "SELECT DISTINCT c.chunk_id, p.page_number FROM chunks c JOIN page_chunks p ON c.doc_id = p.doc_id AND p.page_number BETWEEN c.page_start AND c.page_end")
def j14(spark, d) -> DataFrame:
    # pages exploded, so that the range becomes an equality
    c = table(spark, d, "chunks").filter("page_end >= page_start").select("chunk_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number")).distinct()
    return c.join(table(spark, d, "page_chunks").select("doc_id", "page_number").distinct(), ["doc_id", "page_number"]).select("chunk_id", "page_number")


@BOOK.add("J24_paired_variants", f"""WITH {RUNS}, m AS (SELECT strategy, query_id, avg(latency) AS latency FROM runs WHERE query_id IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL)
SELECT a.query_id, round(a.latency - b.latency, 4) AS delta FROM m a JOIN m b ON a.query_id = b.query_id WHERE a.strategy = 'hybrid' AND b.strategy = 'default'""")
def j24(spark, d) -> DataFrame:
    m = _runs(spark, d).filter("query_id IS NOT NULL AND strategy IS NOT NULL").groupBy("strategy", "query_id").agg(F.avg("latency").alias("latency"))
    a = m.filter("strategy = 'hybrid'").select("query_id", F.col("latency").alias("a"))
    b = m.filter("strategy = 'default'").select("query_id", F.col("latency").alias("b"))
    return a.join(b, "query_id").select("query_id", F.round(F.col("a") - F.col("b"), 4).alias("delta"))


@BOOK.add("J25_answer_agreement", f"""WITH {RUNS}, k AS (SELECT query_id, strategy, run_index, min(lower(trim(answer))) AS a FROM runs WHERE query_id IS NOT NULL GROUP BY ALL)
SELECT x.run_index, count(*) AS n, sum((x.a = y.a)::INT)::BIGINT AS same FROM k x JOIN k y ON x.query_id = y.query_id AND x.run_index = y.run_index WHERE x.strategy = 'hybrid' AND y.strategy = 'default' GROUP BY x.run_index""")
def j25(spark, d) -> DataFrame:
    k = _runs(spark, d).filter("query_id IS NOT NULL").groupBy("query_id", "strategy", "run_index").agg(F.min(F.lower(F.trim("answer"))).alias("a"))
    x = k.filter("strategy = 'hybrid'").select("query_id", "run_index", F.col("a").alias("xa"))
    y = k.filter("strategy = 'default'").select("query_id", "run_index", F.col("a").alias("ya"))
    return x.join(y, ["query_id", "run_index"]).groupBy("run_index").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("xa") == F.col("ya")).cast("int")).alias("same"))


# ---- A: run statistics and reports


@BOOK.add("A07_strategy_summary", f"WITH {RUNS} SELECT strategy, count(*) AS n, round(avg(latency), 4) AS avg_latency, round(avg(kg_triples_used), 4) AS avg_triples, round(avg(sub_questions), 4) AS avg_sub_questions, count(*) FILTER (WHERE insufficient) AS n_insufficient, round(avg(coalesce(insufficient, false)::INT), 6) AS insufficient_rate FROM runs GROUP BY strategy")
def a07(spark, d) -> DataFrame:
    return _runs(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 4).alias("avg_latency"), F.round(F.avg("kg_triples_used"), 4).alias("avg_triples"), F.round(F.avg("sub_questions"), 4).alias("avg_sub_questions"), F.count_if("insufficient").alias("n_insufficient"), F.round(F.avg(F.coalesce("insufficient", F.lit(False)).cast("int")), 6).alias("insufficient_rate"))


@BOOK.add("A08_run_statistics", f"""WITH {RUNS} SELECT CASE WHEN grouping(strategy) = 1 THEN '(all)' ELSE strategy END AS strategy, count(latency) AS n, round(avg(latency), 1) AS mean, round(coalesce(stddev_samp(latency), 0), 1) AS std, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, min(latency) AS lo, max(latency) AS hi, round(count(latency) / (sum(latency) / 1000), 9) AS qps
FROM runs WHERE strategy IS NOT NULL AND latency IS NOT NULL GROUP BY GROUPING SETS ((strategy), ())""")
def a08(spark, d) -> DataFrame:
    r = _runs(spark, d).filter("strategy IS NOT NULL AND latency IS NOT NULL").select("strategy", "latency")
    r = materialize(r.unionByName(r.withColumn("strategy", F.lit("(all)"))), "runs")
    got = r.groupBy("strategy").agg(
        F.count("latency").alias("n"), F.round(F.avg("latency"), 1).alias("mean"), F.round(F.coalesce(F.stddev_samp("latency"), F.lit(0.0)), 1).alias("std"),
        F.min("latency").alias("lo"), F.max("latency").alias("hi"), F.round(F.count("latency") / (F.sum("latency") / 1000), 9).alias("qps"),
    )
    q = K.quantiles(r, ["strategy"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return got.join(q.select("strategy", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")]), "strategy")


@BOOK.add("A09_model_matrix", f"""WITH {RUNS}, v AS (SELECT model, strategy, query_id, latency, row_number() OVER (PARTITION BY model, strategy ORDER BY latency, result_id) AS r, count(*) OVER (PARTITION BY model, strategy) AS n FROM runs WHERE latency IS NOT NULL)
SELECT model, strategy, max(n) AS runs, count(DISTINCT query_id) AS questions, round(avg(latency), 1) AS mean, max(CASE WHEN r = greatest(1, floor(0.95 * n)) THEN latency END) AS p95_index FROM v GROUP BY model, strategy""")
def a09(spark, d) -> DataFrame:
    v = materialize(_runs(spark, d).filter("latency IS NOT NULL").select("model", "strategy", "query_id", "latency"), "runs")
    base = v.groupBy("model", "strategy").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("query_id").alias("questions"), F.round(F.avg("latency"), 1).alias("mean"))
    c = K.value_counts(v, ["model", "strategy"], "latency")
    k = F.greatest(F.lit(1), F.floor(0.95 * F.col("total")))
    at = c.filter((F.col("before") < k) & (k <= F.col("before") + F.col("n"))).select("model", "strategy", F.col("latency").alias("p95_index"))
    return K.same(base, at, ["model", "strategy"])


@BOOK.add("A13_group_summary", f"""WITH {RUNS}, v AS (SELECT r.model, r.strategy, q.lang AS segment, r.latency FROM runs r LEFT JOIN questions q ON r.query_id = q.query_id WHERE latency IS NOT NULL)
SELECT model, strategy, CASE WHEN grouping(segment) = 1 THEN '(all)' ELSE segment END AS segment, count(*) AS n, round(avg(latency), 1) AS mean, round(coalesce(stddev_samp(latency), 0), 1) AS std FROM v GROUP BY GROUPING SETS ((model, strategy, segment), (model, strategy)) HAVING grouping(segment) = 1 OR segment IS NOT NULL""")
def a13(spark, d) -> DataFrame:
    q = table(spark, d, "questions").select("query_id", F.col("lang").alias("segment"))
    v = _runs(spark, d).filter("latency IS NOT NULL").join(q, "query_id", "left")
    g = v.groupingSets([["model", "strategy", "segment"], ["model", "strategy"]], "model", "strategy", "segment").agg(F.grouping("segment").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 1).alias("mean"), F.round(F.coalesce(F.stddev_samp("latency"), F.lit(0.0)), 1).alias("std"))
    return g.filter("g = 1 OR segment IS NOT NULL").withColumn("segment", F.when(F.col("g") == 1, "(all)").otherwise(F.col("segment"))).drop("g")


@BOOK.add("A16_source_rollup", """SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE coalesce(lang, '') END AS lang, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE coalesce(source, '') END AS source, count(*) FILTER (WHERE published IS NOT NULL) AS dated, count(*) FILTER (WHERE published IS NULL) AS undated, round(count(*) FILTER (WHERE published IS NOT NULL) / count(*), 6) AS share
FROM documents GROUP BY ROLLUP (lang, source)""")
def a16(spark, d) -> DataFrame:
    g = table(spark, d, "documents").rollup("lang", "source").agg(F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.count("published").alias("dated"), F.count_if(F.col("published").isNull()).alias("undated"), F.round(F.count("published") / F.count(F.lit(1)), 6).alias("share"))
    lab = lambda g_, c: F.when(F.col(g_) == 1, "(all)").otherwise(F.coalesce(c, F.lit("")))
    return g.select(lab("gl", "lang").alias("lang"), lab("gs", "source").alias("source"), "dated", "undated", "share")


@BOOK.add("A17_citation_tally", f"""WITH {RUNS}, c AS (SELECT strategy, result_id, len(regexp_extract_all(coalesce(answer, ''), '\\[\\d+\\]|\\([A-Z]+-\\d+\\)')) AS n FROM runs)
SELECT strategy, count(*) AS answers, count(*) FILTER (WHERE n > 0) AS cited, sum(n)::BIGINT AS citations, round(avg(n), 6) AS per_answer FROM c GROUP BY strategy""".replace("\\\\", "\\"))
def a17(spark, d) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(\[\d+\]|\([A-Z]+-\d+\))"), 1))
    c = _runs(spark, d).withColumn("n", n)
    return c.groupBy("strategy").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("n") > 0).alias("cited"), F.sum("n").alias("citations"), F.round(F.avg("n"), 6).alias("per_answer"))


@BOOK.add("A18_weighted_latency", f"WITH {RUNS}, s AS (SELECT strategy, avg(latency) AS m, count(latency) AS n FROM runs WHERE latency IS NOT NULL GROUP BY strategy) SELECT round(sum(m * n) / sum(n), 1) AS weighted_mean, sum(n)::BIGINT AS n FROM s")
def a18(spark, d) -> DataFrame:
    s = _runs(spark, d).filter("latency IS NOT NULL").groupBy("strategy").agg(F.avg("latency").alias("m"), F.count("latency").alias("n"))
    return s.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 1).alias("weighted_mean"), F.sum("n").alias("n"))


@BOOK.add("A25_suite_stats", "SELECT coalesce(question_type, '') AS question_type, lang, count(DISTINCT item_id) AS n, count(DISTINCT passage) AS passages FROM eval_items GROUP BY 1, 2")
def a25(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").groupBy(F.coalesce("question_type", F.lit("")).alias("question_type"), "lang").agg(F.countDistinct("item_id").alias("n"), F.countDistinct("passage").alias("passages"))


@BOOK.add("A27_gold_coverage", f"WITH {RUNS} SELECT q.query_id, count(result_id) AS runs FROM questions q LEFT JOIN runs r ON q.query_id = r.query_id GROUP BY q.query_id")
def a27(spark, d) -> DataFrame:
    return table(spark, d, "questions").select("query_id").join(_runs(spark, d).select("query_id", "result_id"), "query_id", "left").groupBy("query_id").agg(F.count("result_id").alias("runs"))


COLS = ["query_id", "strategy", "question", "answer", "answer_lang"]


@BOOK.add("A28_schema_coverage", " UNION ALL ".join(f"SELECT '{c}' AS col, round(avg((coalesce({c}, '') <> '')::INT), 6) AS filled FROM results" for c in COLS))
def a28(spark, d) -> DataFrame:
    one = table(spark, d, "results").agg(*[F.round(F.avg((F.coalesce(c, F.lit("")) != "").cast("int")), 6).alias(c) for c in COLS])
    return one.select(F.explode(F.create_map(*[x for c in COLS for x in (F.lit(c), F.col(c))])).alias("col", "filled"))


@BOOK.add("A29_describe", f"WITH {RUNS} SELECT model, min(latency) AS lo, round(quantile_cont(latency, 0.05), 9) AS p05, round(median(latency), 9) AS med, max(latency) AS hi FROM runs GROUP BY model")
def a29(spark, d) -> DataFrame:
    r = materialize(_runs(spark, d).select("model", "latency"), "runs")
    q = K.quantiles(r, ["model"], "latency", {"p05": 0.05, "med": 0.5})
    base = r.groupBy("model").agg(F.min("latency").alias("lo"), F.max("latency").alias("hi"))
    return K.same(base, q, ["model"], "left").select("model", "lo", F.round("p05", 9).alias("p05"), F.round("med", 9).alias("med"), "hi")


@BOOK.add("A30_trend", f"WITH {RUNS} SELECT CAST(date_trunc('week', started_at) AS DATE)::VARCHAR AS week, count(*) AS n, round(median(latency), 9) AS med FROM runs GROUP BY 1")
def a30(spark, d) -> DataFrame:
    r = materialize(_runs(spark, d).select(F.to_date(F.date_trunc("week", "started_at")).cast("string").alias("week"), "latency"), "runs")
    q = K.quantiles(r, ["week"], "latency", {"med": 0.5})
    return K.same(r.groupBy("week").agg(F.count(F.lit(1)).alias("n")), q, ["week"], "left").select("week", "n", F.round("med", 9).alias("med"))


@BOOK.add("A38_bench_pivot", f"WITH {RUNS}, m AS (SELECT strategy, run_index, median(latency) AS m FROM runs WHERE run_index IN ('1', '2', '3') GROUP BY ALL) SELECT strategy, round(max(m) FILTER (WHERE run_index = '1'), 9) AS first, round(max(m) FILTER (WHERE run_index = '3'), 9) AS last, round(max(m) FILTER (WHERE run_index = '3') - max(m) FILTER (WHERE run_index = '1'), 9) AS delta FROM m GROUP BY strategy")
def a38(spark, d) -> DataFrame:
    r = _runs(spark, d).filter("run_index IN ('1', '2', '3')").select("strategy", "run_index", "latency")
    q = materialize(K.quantiles(r, ["strategy", "run_index"], "latency", {"m": 0.5}), "medians")
    at = lambda i: F.max(F.when(F.col("run_index") == i, F.col("m")))
    p = r.select("strategy").distinct()
    got = q.groupBy("strategy").agg(at("1").alias("a"), at("3").alias("c"))
    return K.same(p, got, ["strategy"], "left").select("strategy", F.round("a", 9).alias("first"), F.round("c", 9).alias("last"), F.round(F.col("c") - F.col("a"), 9).alias("delta"))


@BOOK.add("F33_wilson_intervals", f"""WITH {RUNS}, s AS (SELECT strategy, count(*) FILTER (WHERE insufficient) AS k, count(insufficient) AS n FROM runs GROUP BY strategy)
SELECT strategy, k, n, CASE WHEN n > 0 THEN round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) END AS lo,
 CASE WHEN n > 0 THEN round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) END AS hi FROM s""")
def f33(spark, d) -> DataFrame:
    s = _runs(spark, d).groupBy("strategy").agg(F.count_if("insufficient").alias("k"), F.count("insufficient").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return s.select("strategy", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


# ---- M: metrics. Relevant documents of a question: those that hold the by-product it asks for

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
FIRST3 = "array_to_string({0}[1:3], ' ')"


def _sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s): the sentences of each text, as their words."""
    s = df.select(key, F.explode(F.split(text, r"(?<=[.!?])\s+")).alias("s"))
    return s.select(key, F.array_join(T.words(F.col("s")), " ").alias("s")).filter("s <> ''")


def _sentence_sql(key: str, text: str, of: str) -> str:
    cut = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"SELECT DISTINCT {key} AS k, array_to_string({WORDS.format('s')}, ' ') AS s FROM (SELECT {key}, unnest({cut}) AS s FROM {of})"


@BOOK.add("M01_M06_ranking_metrics", f"""WITH post AS (SELECT token, doc_id AS key, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token), size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT key, dl FROM post)),
q AS (SELECT DISTINCT item_id AS query, unnest(list_distinct({WORDS.format('question')})) AS token FROM eval_items),
scores AS (SELECT query, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN df USING (token) JOIN q USING (token), size GROUP BY query, key),
run AS (SELECT * FROM (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scores) WHERE rank <= 100),
rel AS (SELECT DISTINCT i.k AS query, d.k AS key FROM ({_sentence_sql('item_id', 'passage', 'eval_items')}) i JOIN ({_sentence_sql('doc_id', 'text', 'documents')}) d USING (s) WHERE s <> ''),
nr AS (SELECT query, count(*) AS n_rel FROM rel GROUP BY query),
h AS (SELECT run.*, (rel.key IS NOT NULL)::INT AS rl, sum((rel.key IS NOT NULL)::INT) OVER (PARTITION BY run.query ORDER BY rank) AS hits FROM run LEFT JOIN rel ON run.query = rel.query AND run.key = rel.key),
a AS (SELECT query, count(*) FILTER (WHERE rank <= 10) AS n_top, sum(rl) FILTER (WHERE rank <= 10) AS top_hits, sum(CASE WHEN rank <= 10 AND rl = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN rl = 1 THEN rank END) AS first, sum(CASE WHEN rl = 1 THEN hits / rank ELSE 0 END) AS ap FROM h GROUP BY query)
SELECT i.query, round(coalesce(top_hits / n_top, 0), 6) AS precision, round(coalesce(top_hits / n_rel, 0), 6) AS recall, coalesce((top_hits > 0)::INT, 0) AS hit, round(coalesce(dcg / nullif(list_sum(list_transform(range(1, least(n_rel, n_top)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 0), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(ap / n_rel, 0), 6) AS ap
FROM (SELECT DISTINCT item_id AS query FROM eval_items) i LEFT JOIN a ON i.query = a.query LEFT JOIN nr ON i.query = nr.query""")
def m01(spark, d) -> DataFrame:
    """Every item with the BM25 ranking of its question over all documents, the first hundred of which are the run.

    Relevant are the documents that hold a sentence of the item's passage, also those that the run has not; items
    without a run or a relevant document get zeros.
    """
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query"), "question", "passage").distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    run = R.bm25_top_k(docs, "key", "text", items.select("query", "question").distinct(), "query", "question", 100)
    run = materialize(run.select("query", "key", "rank"), "run")
    rel = _sentences(docs, "key", "text").join(bounded(_sentences(items, "query", "passage").distinct()), "s").select("query", "key").distinct()
    got = M.ranking_metrics(run, materialize(rel, "relevant"), 10)
    return items.select("query").distinct().join(got, "query", "left").fillna(0)


@BOOK.add("M09_exact_and_partial", f"""SELECT item_id, lower(trim(question)) = lower(trim(canonical_answer)) AS exact, round(len(list_intersect(list_distinct({WORDS.format('passage')}), list_distinct({WORDS.format('canonical_answer')}))) / len(list_distinct({WORDS.format('canonical_answer')})), 6) AS partial
FROM eval_items WHERE len({WORDS.format('canonical_answer')}) > 0""")
def m09(spark, d) -> DataFrame:
    e = table(spark, d, "eval_items").withColumn("p", F.array_distinct(T.words(F.col("passage")))).withColumn("a", F.array_distinct(T.words(F.col("canonical_answer")))).filter(F.size("a") > 0)
    return e.select("item_id", (F.lower(F.trim("question")) == F.lower(F.trim("canonical_answer"))).alias("exact"), F.round(F.size(F.array_intersect("p", "a")) / F.size("a"), 6).alias("partial"))


@BOOK.add("M10_token_f1", f"""WITH a AS (SELECT item_id, unnest({WORDS.format('canonical_answer')}) AS w FROM eval_items), b AS (SELECT item_id, unnest({WORDS.format('passage')}) AS w FROM eval_items),
ca AS (SELECT item_id, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY ALL), o AS (SELECT ca.item_id, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (item_id, w) GROUP BY 1),
l AS (SELECT item_id, len({WORDS.format('canonical_answer')}) AS la, len({WORDS.format('passage')}) AS lb FROM eval_items)
SELECT l.item_id, round(CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE 2 * (c / la) * (c / lb) / (c / la + c / lb) END, 6) AS f1 FROM l LEFT JOIN o ON l.item_id = o.item_id""")
def m10(spark, d) -> DataFrame:
    e = table(spark, d, "eval_items").select("item_id", T.words(F.col("canonical_answer")).alias("a"), T.words(F.col("passage")).alias("b"))
    return M.token_overlap(e, "a", "b").select("item_id", F.round("f1", 6).alias("f1"))


@BOOK.add("M11_M12_rouge_bleu")
def m11(spark, d) -> DataFrame:
    e = table(spark, d, "eval_items").select("item_id", T.words(F.col("canonical_answer")).alias("a"), T.words(F.col("passage")).alias("b"))
    return M.rouge_bleu(e, "item_id", "a", "b")


@BOOK.add("M15_concept_prf", """WITH e AS (SELECT doc_id, list_distinct(list(lower(section_title))) AS got, count(*) AS n FROM chunks WHERE section_title IS NOT NULL GROUP BY doc_id),
x AS (SELECT doc_id, list_distinct(flatten(list(list_transform(sections, lambda s: lower(s.title))))) AS want FROM doc_records GROUP BY doc_id),
j AS (SELECT x.doc_id, len(list_filter(want, lambda w: w IS NOT NULL)) AS n_want, coalesce(len(got), 0) AS n_got, coalesce(len(list_intersect(want, got)), 0) AS hit FROM x LEFT JOIN e ON x.doc_id = e.doc_id)
SELECT doc_id, n_want, n_got, hit, round(hit / nullif(n_got, 0), 6) AS precision, round(hit / nullif(n_want, 0), 6) AS recall FROM j""")
def m15(spark, d) -> DataFrame:
    got = table(spark, d, "chunks").filter("section_title IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.lower("section_title")).alias("got"))
    titles = F.transform("sections", lambda s: F.lower(s["title"]))
    want = table(spark, d, "doc_records").select("doc_id", F.explode_outer(titles).alias("t")).groupBy("doc_id").agg(F.collect_set("t").alias("want"))
    none = F.array().cast("array<string>")
    j = want.join(got, "doc_id", "left").withColumn("got", F.coalesce("got", none))
    hit = F.size(F.array_intersect("want", "got")).cast("long")
    j = j.select("doc_id", F.size("want").cast("long").alias("n_want"), F.size("got").cast("long").alias("n_got"), hit.alias("hit"))
    return j.select("*", F.round(M.ratio(F.col("hit"), F.col("n_got")), 6).alias("precision"), F.round(M.ratio(F.col("hit"), F.col("n_want")), 6).alias("recall"))


@BOOK.add("A14_micro_macro", """WITH p AS (SELECT left_label AS label, count(*) FILTER (WHERE same_entity) AS tp, count(*) FILTER (WHERE similarity >= 0.9) AS got, count(*) FILTER (WHERE same_entity AND similarity >= 0.9) AS hit FROM match_pairs WHERE left_label IS NOT NULL AND same_entity IS NOT NULL GROUP BY left_label)
SELECT round(sum(hit) / nullif(sum(got), 0), 6) AS micro_precision, round(sum(hit) / nullif(sum(tp), 0), 6) AS micro_recall, round(avg(hit / nullif(got, 0)), 6) AS macro_precision, round(avg(hit / nullif(tp, 0)), 6) AS macro_recall FROM p""")
def a14(spark, d) -> DataFrame:
    m = table(spark, d, "match_pairs").filter("left_label IS NOT NULL AND same_entity IS NOT NULL")
    high = F.col("similarity") >= 0.9
    p = m.groupBy("left_label").agg(F.count_if("same_entity").alias("tp"), F.count_if(high).alias("got"), F.count_if(F.col("same_entity") & high).alias("hit"))
    r = lambda a, b: F.round(M.ratio(F.sum(a), F.sum(b)), 6)
    return p.agg(r("hit", "got").alias("micro_precision"), r("hit", "tp").alias("micro_recall"), F.round(F.avg(M.ratio(F.col("hit"), F.col("got"))), 6).alias("macro_precision"), F.round(F.avg(M.ratio(F.col("hit"), F.col("tp"))), 6).alias("macro_recall"))


@BOOK.add("M19_label_resolver", f"""WITH c AS (SELECT lower(a) AS form, predicate AS uri, 1 AS tier FROM (SELECT predicate, unnest(aliases) AS a FROM relation_vocab) UNION ALL SELECT lower(label_it), predicate, 2 FROM relation_vocab UNION ALL SELECT lower(replace(predicate, '_', ' ')), predicate, 0 FROM relation_vocab),
b AS (SELECT form, min(tier) AS tier FROM c GROUP BY form), u AS (SELECT c.form, min(uri) AS uri, count(DISTINCT uri) AS n FROM c JOIN b ON c.form = b.form AND c.tier = b.tier GROUP BY c.form)
SELECT triple_id, u.uri, u.n > 1 AS ambiguous FROM triples t JOIN u ON lower(replace(t.predicate, '_', ' ')) = u.form""")
def m19(spark, d) -> DataFrame:
    v = table(spark, d, "relation_vocab")
    c = v.select(F.explode("aliases").alias("a"), F.col("predicate").alias("uri")).select(F.lower("a").alias("form"), "uri", F.lit(1).alias("tier"))
    c = c.unionByName(v.select(F.lower("label_it").alias("form"), F.col("predicate").alias("uri"), F.lit(2).alias("tier"))).unionByName(v.select(F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("form"), F.col("predicate").alias("uri"), F.lit(0).alias("tier")))
    best = c.withColumn("best", F.min("tier").over(Window.partitionBy("form"))).filter("tier = best").groupBy("form").agg(F.min("uri").alias("uri"), (F.countDistinct("uri") > 1).alias("ambiguous"))
    t = table(spark, d, "triples").select("triple_id", F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("form"))
    return t.join(best, "form").select("triple_id", "uri", "ambiguous")


FOLDED = "translate(lower({0}), '" + T.MARKED + "', '" + T.PLAIN + "')"
FORMS = f"forms AS (SELECT DISTINCT array_to_string({WORDS.format(FOLDED.format('f'))}, ' ') AS form FROM (SELECT label_it AS f FROM relation_vocab UNION ALL SELECT unnest(aliases) FROM relation_vocab) WHERE f IS NOT NULL)"


@BOOK.add("M20_gazetteer_mentions", f"""WITH {FORMS}, w AS (SELECT chunk_id, {WORDS.format(FOLDED.format('text'))} AS w FROM (SELECT DISTINCT chunk_id, text FROM chunks)),
g AS (SELECT chunk_id, array_to_string(w[p:(p + n - 1)], ' ') AS form FROM (SELECT chunk_id, w, p, unnest(range(1, least((SELECT max(len(string_split(form, ' '))) FROM forms), len(w) - p + 1) + 1)) AS n FROM (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)))
SELECT chunk_id, form, count(*) AS n FROM g JOIN forms USING (form) WHERE form <> '' GROUP BY chunk_id, form""")
def m20(spark, d) -> DataFrame:
    """Forms of any number of words, folded on both sides."""
    v = table(spark, d, "relation_vocab")
    fold = lambda c: F.translate(F.lower(c), T.MARKED, T.PLAIN)
    forms = v.select(F.col("label_it").alias("f")).unionByName(v.select(F.explode("aliases").alias("f"))).filter("f IS NOT NULL")
    forms = forms.select(F.array_join(T.words(fold(F.col("f"))), " ").alias("phrase"))
    chunks = table(spark, d, "chunks").select("chunk_id", "text").distinct().select("chunk_id", fold(F.col("text")).alias("text"))
    got = extract.gazetteer_mentions(chunks, "chunk_id", "text", forms)
    return got.groupBy("chunk_id", F.col("phrase").alias("form")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("M21_hard_questions", f"WITH {RUNS} SELECT query_id FROM questions WHERE query_id NOT IN (SELECT query_id FROM runs WHERE strategy = 'no_retrieval' AND NOT coalesce(insufficient, true) AND query_id IS NOT NULL)")
def m21(spark, d) -> DataFrame:
    easy = _runs(spark, d).filter("strategy = 'no_retrieval' AND NOT coalesce(insufficient, true)").select("query_id")
    return table(spark, d, "questions").select("query_id").join(easy, "query_id", "left_anti")


@BOOK.add("M28_cell_scores", f"WITH {RUNS} SELECT model, strategy, query_id, count(*) AS n, round(avg(length(answer)), 4) AS avg_chars FROM runs WHERE query_id IS NOT NULL AND NOT coalesce(insufficient, false) GROUP BY ALL")
def m28(spark, d) -> DataFrame:
    return _runs(spark, d).filter("query_id IS NOT NULL AND NOT coalesce(insufficient, false)").groupBy("model", "strategy", "query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("answer")), 4).alias("avg_chars"))


# ---- T: statistics


@BOOK.add("T01_bootstrap_means", f"""WITH {RUNS}, v AS (SELECT strategy, result_id, latency FROM runs WHERE latency IS NOT NULL), r AS (SELECT *, unnest(range(1, 101)) AS r FROM v),
u AS (SELECT *, ('0x' || left(md5(result_id || '|' || r), 8))::UBIGINT / 4294967296.0 AS u FROM r),
w AS (SELECT strategy, r, latency, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS w FROM u),
m AS (SELECT strategy, sum(w * latency) / sum(w) AS m FROM w GROUP BY strategy, r HAVING sum(w) > 0), c AS (SELECT strategy, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY strategy),
b AS (SELECT strategy, avg(latency) AS mean, count(*) AS n FROM v GROUP BY strategy)
SELECT b.strategy, round(mean, 1) AS mean, round(lo, 1) AS lo, round(hi, 1) AS hi, n FROM b JOIN c ON b.strategy IS NOT DISTINCT FROM c.strategy""")
def t01(spark, d) -> DataFrame:
    got = M.hashed_bootstrap(_runs(spark, d).filter("latency IS NOT NULL"), "strategy", "result_id", "latency")
    return got.select("strategy", *[F.round(c, 1).alias(c) for c in ("mean", "lo", "hi")], "n")


@BOOK.add("T05_regression_gate", f"""WITH {RUNS}, m AS (SELECT strategy, median(latency) FILTER (WHERE run_index = '1') AS base, median(latency) FILTER (WHERE run_index = '2') AS cur FROM runs GROUP BY strategy)
SELECT strategy, CASE WHEN base IS NULL OR cur IS NULL OR base = 0 THEN 'stable' WHEN (cur - base) / base > 0.05 THEN 'regressed' WHEN (cur - base) / base < -0.05 THEN 'improved' ELSE 'stable' END AS status FROM m""")
def t05(spark, d) -> DataFrame:
    r = materialize(_runs(spark, d).select("strategy", "run_index", "latency"), "runs")
    q = materialize(K.quantiles(r.filter("run_index IN ('1', '2')"), ["strategy", "run_index"], "latency", {"m": 0.5}), "medians")
    at = lambda i: F.max(F.when(F.col("run_index") == i, F.col("m")))
    m = K.same(r.select("strategy").distinct(), q.groupBy("strategy").agg(at("1").alias("base"), at("2").alias("cur")), ["strategy"], "left")
    rel = M.ratio(F.col("cur") - F.col("base"), F.col("base"))
    return m.select("strategy", F.when(rel > 0.05, "regressed").when(rel < -0.05, "improved").otherwise("stable").alias("status"))


@BOOK.add("T06_spearman_by_strategy", f"""WITH {RUNS}, v AS (SELECT strategy, latency AS x, length(answer) AS y FROM runs WHERE latency IS NOT NULL AND answer IS NOT NULL AND strategy IS NOT NULL),
r AS (SELECT strategy, rank() OVER (PARTITION BY strategy ORDER BY x) + (count(*) OVER (PARTITION BY strategy, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY strategy ORDER BY y) + (count(*) OVER (PARTITION BY strategy, y) - 1) / 2.0 AS ry FROM v)
SELECT strategy, count(*) AS n, CASE WHEN count(*) >= 2 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY strategy""")
def t06(spark, d) -> DataFrame:
    v = _runs(spark, d).filter("latency IS NOT NULL AND answer IS NOT NULL AND strategy IS NOT NULL").select("strategy", F.col("latency").alias("x"), F.length("answer").alias("y"))
    v = materialize(v, "runs")
    r = K.tie_ranks(K.tie_ranks(v, "x", "rx", ["strategy"]), "y", "ry", ["strategy"])
    varied = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    return r.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.when(varied, F.round(F.corr("rx", "ry"), 6)).alias("spearman"))


@BOOK.add("A34_length_correlation", f"WITH {RUNS} SELECT strategy, round(corr(length(answer), kg_triples_used), 6) AS r FROM runs WHERE answer IS NOT NULL AND strategy IS NOT NULL GROUP BY strategy")
def a34(spark, d) -> DataFrame:
    return _runs(spark, d).filter("answer IS NOT NULL AND strategy IS NOT NULL").groupBy("strategy").agg(F.round(F.corr(F.length("answer"), "kg_triples_used"), 6).alias("r"))


# ---- W, L


@BOOK.add("W01_top_triples_per_chunk", "SELECT chunk_id, triple_id, r FROM (SELECT relationship_properties['chunk_id'] AS chunk_id, triple_id, row_number() OVER (PARTITION BY relationship_properties['chunk_id'] ORDER BY coalesce(TRY_CAST(relationship_properties['confidence'] AS DOUBLE), 0) DESC, triple_id)::INT AS r FROM triples) WHERE r <= 3")
def w01(spark, d) -> DataFrame:
    p = F.col("relationship_properties")
    t = table(spark, d, "triples").select(p["chunk_id"].alias("chunk_id"), "triple_id", F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0)).alias("c"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("c"), "triple_id"))).filter("r <= 3").select("chunk_id", "triple_id", "r")


@BOOK.add("W13_recent_strategies", f"""WITH {RUNS}, o AS (SELECT query_id, strategy, row_number() OVER (PARTITION BY query_id ORDER BY started_at, result_id) AS turn, count(*) OVER (PARTITION BY query_id) AS turns FROM runs WHERE query_id IS NOT NULL)
SELECT query_id, strategy, count(*) AS mentions, max(turn) AS last_turn FROM o WHERE turn > turns - 3 GROUP BY query_id, strategy""")
def w13(spark, d) -> DataFrame:
    w = Window.partitionBy("query_id")
    o = _runs(spark, d).filter("query_id IS NOT NULL").withColumn("turn", F.row_number().over(w.orderBy("started_at", "result_id")).cast("long")).withColumn("turns", F.count(F.lit(1)).over(w))
    return o.filter("turn > turns - 3").groupBy("query_id", "strategy").agg(F.count(F.lit(1)).alias("mentions"), F.max("turn").alias("last_turn"))


@BOOK.add("L04_relevance_grades", f"""WITH {RUNS}, g AS (SELECT result_id, len(list_intersect(list_distinct({WORDS.format('question')}), list_distinct({WORDS.format('answer')}))) AS hit, len(list_distinct({WORDS.format('question')})) AS n FROM runs WHERE question IS NOT NULL AND answer IS NOT NULL)
SELECT result_id, hit >= 1 AND (hit >= 2 OR hit / n >= 0.30) AS relevant FROM g WHERE n > 0""")
def l04(spark, d) -> DataFrame:
    g = _runs(spark, d).filter("question IS NOT NULL AND answer IS NOT NULL").select("result_id", F.array_distinct(T.words(F.col("question"))).alias("q"), F.array_distinct(T.words(F.col("answer"))).alias("a")).filter(F.size("q") > 0)
    hit = F.size(F.array_intersect("q", "a"))
    return g.select("result_id", ((hit >= 1) & ((hit >= 2) | (hit / F.size("q") >= 0.30))).alias("relevant"))


@BOOK.add("L06_evidence_index", "SELECT doc_id, chunk_id, 'S' || r AS ref_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS r FROM (SELECT DISTINCT doc_id, chunk_id, chunk_index FROM chunks)) WHERE r <= 12")
def l06(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").select("doc_id", "chunk_id", "chunk_index").distinct()
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))
    return c.withColumn("r", r).filter("r <= 12").select("doc_id", "chunk_id", F.concat(F.lit("S"), F.col("r").cast("string")).alias("ref_id"))


@BOOK.add("L08_citation_check", f"""WITH {RUNS}, c AS (SELECT result_id, unnest(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))) AS ref, kg_triples_used FROM runs WHERE answer IS NOT NULL)
SELECT result_id, count(*) AS cited, count(*) FILTER (WHERE ref::INT > coalesce(kg_triples_used, 0)) AS phantom FROM c GROUP BY result_id""".replace("\\\\", "\\"))
def l08(spark, d) -> DataFrame:
    c = _runs(spark, d).filter("answer IS NOT NULL").select("result_id", "kg_triples_used", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1))).alias("ref"))
    return c.groupBy("result_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("ref").cast("int") > F.coalesce("kg_triples_used", F.lit(0))).alias("phantom"))


@BOOK.add("L17_experiment_grid", "SELECT query_id, p.preset, r.run FROM questions, (VALUES " + ", ".join(f"('{k}')" for k in R.PRESETS) + ") p(preset), (VALUES (1), (2), (3)) r(run)")
def l17(spark, d) -> DataFrame:
    grid = F.array(*[F.lit(k) for k in R.PRESETS])
    return table(spark, d, "questions").select("query_id", F.explode(grid).alias("preset")).select("query_id", "preset", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))


@BOOK.add("X03_acronyms", r"SELECT acronym, min(long_form) AS long_form, count(*) AS n FROM (SELECT regexp_extract(m, '\(([A-Z]{2,6})\)', 1) AS acronym, trim(regexp_extract(m, '^(.*?)\s*\(', 1)) AS long_form FROM (SELECT unnest(regexp_extract_all(text, '(?:[A-Z][a-z]+ ){1,4}\([A-Z]{2,6}\)')) AS m FROM documents)) GROUP BY acronym")
def x03(spark, d) -> DataFrame:
    m = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"((?:[A-Z][a-z]+ ){1,4}\([A-Z]{2,6}\))"), 1)).alias("m"))
    m = m.select(F.regexp_extract("m", r"\(([A-Z]{2,6})\)", 1).alias("acronym"), F.trim(F.regexp_extract("m", r"^(.*?)\s*\(", 1)).alias("long_form"))
    return m.groupBy("acronym").agg(F.min("long_form").alias("long_form"), F.count(F.lit(1)).alias("n"))


@BOOK.add("X05_open_types", "SELECT coalesce(subject_labels[1], '') AS label, count(*) AS n, count(DISTINCT subject) AS n_names FROM triples GROUP BY 1")
def x05(spark, d) -> DataFrame:
    lab = F.coalesce(F.try_element_at("subject_labels", F.lit(1)), F.lit(""))
    return table(spark, d, "triples").groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_names"))


@BOOK.add("U05_shared_keys", "SELECT DISTINCT relationship_properties['chunk_id'] AS chunk_id FROM triples INTERSECT SELECT chunk_id FROM chunks")
def u05(spark, d) -> DataFrame:
    return table(spark, d, "triples").select(F.col("relationship_properties")["chunk_id"].alias("chunk_id")).intersect(table(spark, d, "chunks").select("chunk_id"))


@BOOK.add("U06_missing_keys", "SELECT query_id FROM questions EXCEPT SELECT query_id FROM results WHERE insufficient_answer")
def u06(spark, d) -> DataFrame:
    return table(spark, d, "questions").select("query_id").subtract(table(spark, d, "results").filter("insufficient_answer").select("query_id"))


@BOOK.add("U08_snapshot_counts", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS chunks, coalesce(b.n, 0) AS pages FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM page_chunks GROUP BY 1) b ON a.doc_id = b.doc_id")
def u08(spark, d) -> DataFrame:
    a = table(spark, d, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    b = table(spark, d, "page_chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return a.join(b, "doc_id", "full").fillna(0, ["chunks", "pages"])


# ---- ST: windows over the event stream, as batch plans; see lattica.streaming for the streaming form


@BOOK.add("ST4_tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st4(spark, d) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@BOOK.add("ST4_sessions", """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1, 2""")
def st4s(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = table(spark, d, "events").withColumn("new", F.when(gap < 30 * 60 * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
