"""Queries of sources, sinks, extraction, repair and streaming (families S, K, X, P, G, ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lattica.common import table
from lattica.functions import text as T
from lattica.operators import extract, graph
from lattica.plans.base import Book
from lattica.plans.q_eval import RUNS, _runs
from lattica.plans.q_graph import EDGES, _edges, _key, _name
from lattica.sources import io
from lattica.streaming import stream

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql

RESULT = StructType([StructField("result_id", LongType()), StructField("query_id", StringType()), StructField("strategy", StringType()), StructField("answer", StringType()), StructField("latency_ms", DoubleType())])
LAT = "CASE WHEN isnan(latency_ms) OR abs(latency_ms) > 1e15 THEN NULL ELSE floor(latency_ms)::BIGINT END AS latency_ms"


def _plain(spark, d) -> DataFrame:
    lat = F.when(F.isnan("latency_ms") | (F.abs("latency_ms") > 1e15), None).otherwise(F.col("latency_ms"))
    return table(spark, d, "results").select("result_id", "query_id", "strategy", "answer", lat.alias("latency_ms"))


@BOOK.add("S07_results_jsonl", f"SELECT DISTINCT result_id, query_id, strategy, {LAT} FROM results")
def s07(spark, d) -> DataFrame:
    path = io.scratch(spark, "jsonl")
    io.write_jsonl(_plain(spark, d), path)
    return io.read_jsonl(spark, path, RESULT)[0].select("result_id", "query_id", "strategy", F.floor("latency_ms").alias("latency_ms")).distinct()


@BOOK.add("S08_results_csv", f"SELECT DISTINCT result_id, query_id, length(answer) AS n_chars FROM results WHERE answer IS NOT NULL AND answer <> ''")
def s08(spark, d) -> DataFrame:
    path = io.scratch(spark, "csv")
    # line ends and outer blanks inside a field survive in quotes
    io.write_csv(_plain(spark, d).filter("answer IS NOT NULL AND answer <> ''"), path)
    return io.read_csv(spark, path, RESULT).select("result_id", "query_id", F.length("answer").cast("long").alias("n_chars")).distinct()


@BOOK.add("S11_gold_by_question", f"SELECT qk, query_id FROM (SELECT {_key('question')} AS qk, query_id, row_number() OVER (PARTITION BY {_key('question')} ORDER BY query_id) AS r FROM questions) WHERE r = 1")
def s11(spark, d) -> DataFrame:
    return table(spark, d, "questions").groupBy(T.triple_key(F.col("question")).alias("qk")).agg(F.min("query_id").alias("query_id"))


@BOOK.add("S14_distinct_questions", "SELECT question FROM (SELECT question, row_number() OVER (PARTITION BY lower(question) ORDER BY query_id) AS r FROM questions) WHERE r = 1")
def s14(spark, d) -> DataFrame:
    return table(spark, d, "questions").groupBy(F.lower("question").alias("l")).agg(F.min_by("question", "query_id").alias("question")).select("question")


@BOOK.add("S15_first_by_filename", "SELECT filename, doc_id FROM (SELECT filename, doc_id, row_number() OVER (PARTITION BY lower(filename) ORDER BY doc_id, filename) AS r FROM doc_records) WHERE r = 1")
def s15(spark, d) -> DataFrame:
    w = Window.partitionBy(F.lower("filename")).orderBy("doc_id", "filename")
    return table(spark, d, "doc_records").withColumn("r", F.row_number().over(w)).filter("r = 1").select("filename", "doc_id")


@BOOK.add("S25_label_claims", "SELECT DISTINCT lower(a) AS form, predicate AS uri, 'alias' AS source FROM (SELECT predicate, unnest(aliases) AS a FROM relation_vocab) UNION SELECT lower(label_it), predicate, 'label' FROM relation_vocab")
def s25(spark, d) -> DataFrame:
    v = table(spark, d, "relation_vocab")
    a = v.select(F.explode("aliases").alias("a"), "predicate").select(F.lower("a").alias("form"), F.col("predicate").alias("uri"), F.lit("alias").alias("source"))
    return a.unionByName(v.select(F.lower("label_it").alias("form"), F.col("predicate").alias("uri"), F.lit("label").alias("source"))).distinct()


@BOOK.add("S27_table_assertions", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS filled FROM {t}" for t in ("results", "chunks", "triples", "registry", "documents")))
def s27(spark, d) -> DataFrame:
    out = None
    for t in ("results", "chunks", "triples", "registry", "documents"):
        one = table(spark, d, t).agg((F.count(F.lit(1)) > 0).alias("filled")).select(F.lit(t).alias("name"), "filled")
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.add("K04_rejects", "SELECT error, count(*) AS n FROM (SELECT CASE WHEN question IS NULL OR trim(question) = '' THEN 'no question' WHEN answer IS NULL THEN 'no answer' ELSE '' END AS error FROM results) WHERE error <> '' GROUP BY error")
def k04(spark, d) -> DataFrame:
    err = F.when(F.col("question").isNull() | (F.trim("question") == ""), "no question").when(F.col("answer").isNull(), "no answer").otherwise("")
    return io.split_valid(table(spark, d, "results"), err)[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("K05_result_exports", "SELECT DISTINCT result_id, printf('%.6f', latency_ms) AS latency FROM results WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND abs(latency_ms) < 1e9")
def k05(spark, d) -> DataFrame:
    r = table(spark, d, "results").filter("latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND abs(latency_ms) < 1e9")
    return r.select("result_id", F.format_string("%.6f", "latency_ms").alias("latency")).distinct()


@BOOK.add("K11_snapshot_verified", "SELECT count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS different FROM triples")
def k11(spark, d) -> DataFrame:
    t = table(spark, d, "triples").select("triple_id", "subject", "predicate", "object")
    path = io.scratch(spark, "snapshot")
    t.write.parquet(path)
    return io.same_rows(t, spark.read.parquet(path))


@BOOK.add("K02_upserted_runs", f"SELECT result_id, max(ingested_at)::VARCHAR[:19] AS ingested FROM results GROUP BY result_id".replace("max(ingested_at)::VARCHAR[:19]", "strftime(max(ingested_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"))
def k02(spark, d) -> DataFrame:
    r = table(spark, d, "results").select("result_id", "ingested_at", "strategy")
    old, new = r.filter(F.dayofmonth("ingested_at") < 15), r.filter((F.dayofmonth("ingested_at") >= 15) | F.col("ingested_at").isNull())
    return io.upsert(old, new, ["result_id"], "ingested_at").select("result_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


@BOOK.add("K18_flat_metrics", f"WITH {RUNS}, g AS (SELECT strategy, avg(latency) AS m, count(*)::DOUBLE AS n FROM runs WHERE strategy IS NOT NULL GROUP BY strategy) SELECT strategy, 'latency_mean' AS metric, round(m, 3) AS value FROM g UNION ALL SELECT strategy, 'runs', n FROM g")
def k18(spark, d) -> DataFrame:
    g = _runs(spark, d).filter("strategy IS NOT NULL").groupBy("strategy").agg(F.round(F.avg("latency"), 3).alias("latency_mean"), F.count(F.lit(1)).cast("double").alias("runs"))
    return g.unpivot(["strategy"], ["latency_mean", "runs"], "metric", "value")


# ---- X: extraction

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
NAMES = f"names AS (SELECT DISTINCT array_to_string({WORDS.format('canonical_name')}, ' ') AS phrase FROM registry WHERE canonical_name IS NOT NULL)"
GRAMS = f"""w AS (SELECT chunk_id, {WORDS.format('text')} AS w FROM (SELECT DISTINCT chunk_id, text FROM chunks)),
g AS (SELECT chunk_id, pos, n, array_to_string(w[pos:(pos + n - 1)], ' ') AS phrase FROM (SELECT chunk_id, w, pos, unnest(range(1, least((SELECT max(len(string_split(phrase, ' '))) FROM names), len(w) - pos + 1) + 1)) AS n FROM (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w))),
m AS (SELECT chunk_id, pos, n, phrase FROM g WHERE phrase <> '' AND phrase IN (SELECT phrase FROM names)), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, pos ORDER BY n DESC) AS r FROM m) WHERE r = 1)"""


def _mentions(spark, d) -> DataFrame:
    names = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select(F.array_join(T.words(F.col("canonical_name")), " ").alias("phrase")).filter("phrase <> ''")
    chunks = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return extract.longest_mentions(extract.gazetteer_mentions(chunks, "chunk_id", "text", names), "chunk_id")


@BOOK.add("X01_gazetteer_mentions", f"WITH {NAMES}, {GRAMS} SELECT chunk_id, phrase, count(*) AS n FROM l GROUP BY chunk_id, phrase")
def x01(spark, d) -> DataFrame:
    return _mentions(spark, d).groupBy("chunk_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("X02_neighbour_relations", f"WITH {NAMES}, {GRAMS}, p AS (SELECT phrase AS subject, lead(phrase) OVER (PARTITION BY chunk_id ORDER BY pos) AS object FROM l) SELECT subject, object, count(*) AS n FROM p WHERE object IS NOT NULL AND object <> subject GROUP BY ALL")
def x02(spark, d) -> DataFrame:
    return extract.neighbour_relations(_mentions(spark, d), "chunk_id")


@BOOK.add("X14_rare_types", f"WITH {EDGES}, t AS (SELECT type, sum(n)::BIGINT AS n FROM edges GROUP BY type HAVING sum(n) < 10), v AS (SELECT predicate FROM relation_vocab) SELECT type, n, CASE WHEN type IN (SELECT predicate FROM v) THEN type ELSE 'RELATED_TO' END AS new FROM t")
def x14(spark, d) -> DataFrame:
    t = _edges(spark, d).groupBy("type").agg(F.sum("n").alias("n")).filter("n < 10")
    v = table(spark, d, "relation_vocab").select(F.col("predicate").alias("type"), F.lit(True).alias("known"))
    return t.join(v, "type", "left").select("type", "n", F.when(F.col("known"), F.col("type")).otherwise("RELATED_TO").alias("new"))


@BOOK.add("RESOLVE_initial_groups", "SELECT label, norm, predicate, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT name, label, predicate, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS norm FROM (SELECT subject AS name, coalesce(subject_labels[1], 'Concept') AS label, predicate FROM triples UNION ALL SELECT object, coalesce(object_labels[1], 'Concept'), predicate FROM triples) WHERE name IS NOT NULL AND predicate IS NOT NULL) GROUP BY ALL")
def resolve(spark, d) -> DataFrame:
    return extract.initial_groups(table(spark, d, "triples"))


@BOOK.add("X06_closed_list_candidates", f"WITH {NAMES}, {GRAMS}, t AS (SELECT phrase, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY max(n) DESC, length(phrase) DESC, phrase) AS r FROM l WHERE n <= 8 GROUP BY chunk_id, phrase) SELECT chunk_id, phrase, r AS rank FROM t WHERE r <= 25")
def x06(spark, d) -> DataFrame:
    """Names of one to eight words, the first 25 of a chunk."""
    m = _mentions(spark, d).filter("n <= 8").groupBy("chunk_id", "phrase").agg(F.max("n").alias("n"))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("n"), F.desc(F.length("phrase")), "phrase")
    return m.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 25").select("chunk_id", "phrase", "rank")


# ---- P, G: predicates and repairs over names


@BOOK.add("P01_name_predicate", "SELECT DISTINCT entity_id FROM registry WHERE lower(canonical_name) = 'olive pomace' OR contains(lower(canonical_name), 'olive') OR list_contains(list_transform(aliases, lambda x: lower(x)), 'olive pomace')")
def p01(spark, d) -> DataFrame:
    n = F.lower("canonical_name")
    hit = F.coalesce(n.contains("olive"), F.lit(False)) | F.coalesce(F.array_contains(F.transform("aliases", F.lower), "olive pomace"), F.lit(False))
    return table(spark, d, "registry").filter(hit).select("entity_id").distinct()


@BOOK.add("P02_display_names", "SELECT DISTINCT entity_id, coalesce(merged_properties['name'], canonical_name, aliases[1], entity_id::VARCHAR) AS display FROM registry")
def p02(spark, d) -> DataFrame:
    return table(spark, d, "registry").select("entity_id", F.coalesce(F.col("merged_properties")["name"], "canonical_name", F.try_element_at("aliases", F.lit(1)), F.col("entity_id").cast("string")).alias("display")).distinct()


@BOOK.add("P16_generic_names", f"WITH {EDGES}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT node, degree FROM deg WHERE degree <= 3 AND regexp_matches(node, '^(the |this |these |it|such )')")
def p16(spark, d) -> DataFrame:
    return graph.degrees(_edges(spark, d)).filter((F.col("degree") <= 3) & F.col("node").rlike("^(the |this |these |it|such )"))


@BOOK.add("G23_all_caps_titles", f"""WITH n AS (SELECT DISTINCT entity_id, canonical_name AS name FROM registry WHERE canonical_name IS NOT NULL), c AS (SELECT entity_id, array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM n WHERE upper(name) = name AND lower(name) <> name),
k AS (SELECT name, min(entity_id) AS keep FROM n GROUP BY name) SELECT entity_id, title, keep FROM c LEFT JOIN k ON c.title = k.name""")
def g23(spark, d) -> DataFrame:
    n = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", F.col("canonical_name").alias("name")).distinct()
    title = F.array_join(F.transform(F.split(F.lower("name"), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000))), " ")
    k = n.groupBy(F.col("name").alias("title")).agg(F.min("entity_id").alias("keep"))
    return n.filter(T.all_caps(F.col("name"))).select("entity_id", title.alias("title")).join(k, "title", "left").select("entity_id", "title", "keep")


@BOOK.add("G10_alias_collapse", f"SELECT {_name('canonical_name')} AS key, min(entity_id) AS keep, count(DISTINCT entity_id) AS merged, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT entity_id, canonical_name, unnest(aliases) AS a FROM registry WHERE canonical_name IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT entity_id) > 1")
def g10(spark, d) -> DataFrame:
    a = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", T.name_key(F.col("canonical_name")).alias("key"), F.explode("aliases").alias("a"))
    g = a.groupBy("key").agg(F.min("entity_id").alias("keep"), F.countDistinct("entity_id").alias("merged"), F.array_join(F.array_sort(F.collect_set("a")), "|").alias("aliases"))
    return g.filter("merged > 1")


@BOOK.add("G24_best_alias_names", "SELECT entity_id, alias AS name FROM (SELECT entity_id, canonical_name, alias, row_number() OVER (PARTITION BY entity_id ORDER BY len(string_split(alias, ' ')), length(alias), alias) AS r FROM (SELECT DISTINCT entity_id, canonical_name, unnest(aliases) AS alias FROM registry WHERE len(string_split(canonical_name, ' ')) > 4)) WHERE r = 1")
def g24(spark, d) -> DataFrame:
    a = table(spark, d, "registry").filter(F.size(F.split("canonical_name", " ")) > 4).select("entity_id", F.explode("aliases").alias("alias"))
    best = F.min(F.struct(F.size(F.split("alias", " ")).alias("w"), F.length("alias").alias("n"), "alias")).alias("b")
    return a.groupBy("entity_id").agg(best).select("entity_id", F.col("b.alias").alias("name"))


# ---- ST: streams


@BOOK.add("ST4_stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st4(spark, d) -> DataFrame:
    return stream.collected(stream.tumbling(stream.stream_of(spark, d, "events")), "complete").withColumn("total", F.round("total", 4))


@BOOK.add("ST4_stream_sliding", "SELECT b::VARCHAR AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS b FROM events) GROUP BY 1, 2")
def st4b(spark, d) -> DataFrame:
    return stream.collected(stream.sliding(stream.stream_of(spark, d, "events")), "complete")


@BOOK.add("ST2_first_deliveries", "SELECT DISTINCT result_id FROM results")
def st2(spark, d) -> DataFrame:
    return stream.collected(stream.first_deliveries(stream.stream_of(spark, d, "results").select("result_id", "ingested_at"), "3650 days"), "append").select("result_id")
