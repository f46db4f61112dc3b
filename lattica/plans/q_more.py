"""Further queries of the survey: joins, reports, unions, ranks, repairs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize, table
from lattica.functions import text as T
from lattica.operators import graph as G
from lattica.operators import metrics as M
from lattica.operators import ranks as K
from lattica.operators import retrieval as R
from lattica.plans.base import Book
from lattica.plans.q_eval import RUNS, WORDS, _runs
from lattica.plans.q_graph import DEG, EDGES, INC, NODES, SEEDS, _edges, _key, _name, _nodes, _seeds, closure_sql
from lattica.plans.q_retrieval import VEC

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql

# Plural and singular forms of words in the domain's names.
SINGULAR = {"shells": "shell", "husks": "husk", "peels": "peel", "skins": "skin", "hulls": "hull", "cobs": "cob", "leaves": "leaf", "feathers": "feather", "grounds": "ground", "trimmings": "trimming", "tops": "top", "bucce": "buccia", "gusci": "guscio", "foglie": "foglia", "scarti": "scarto", "tutoli": "tutolo"}
SING_SQL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SINGULAR.items()) + "}"


@BOOK.add("F08_fold_number", f"SELECT DISTINCT entity_id, array_to_string(list_transform(string_split(lower(canonical_name), ' '), lambda w: coalesce({SING_SQL}[w], w)), ' ') AS value FROM registry WHERE canonical_name IS NOT NULL")
def f08(spark, d) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in SINGULAR.items() for x in kv])
    words = F.transform(F.split(F.lower("canonical_name"), " "), lambda w: F.coalesce(F.try_element_at(m, w), w))
    return table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", F.array_join(words, " ").alias("value")).distinct()


@BOOK.add("F10_gold_tokens", f"SELECT item_id, len(list_filter(list_distinct(regexp_extract_all(translate(lower(canonical_answer), '{T.MARKED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) > 1)) AS n FROM eval_items".replace("\\\\", "\\"))
def f10(spark, d) -> DataFrame:
    w = F.filter(F.array_distinct(T.words(T.fold(F.lower("canonical_answer")))), lambda x: F.length(x) > 1)
    return table(spark, d, "eval_items").select("item_id", F.size(w).cast("long").alias("n"))


@BOOK.add("F12_triple_forms", f"SELECT triple_id, {_key('subject')} || '|' || {_key('predicate')} || '|' || {_key('object')} AS form FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
def f12(spark, d) -> DataFrame:
    t = table(spark, d, "triples").filter("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    return t.select("triple_id", F.concat_ws("|", *[T.triple_key(F.col(c)) for c in ("subject", "predicate", "object")]).alias("form"))


@BOOK.add("F16_quote_keys", f"SELECT DISTINCT doc_id, page_number, length(regexp_replace(translate(lower(regexp_replace(text, '-\\n', '', 'g')), '{T.MARKED}', '{T.PLAIN}'), '[^a-z0-9]+', '', 'g')) AS n_chars FROM page_chunks WHERE text IS NOT NULL".replace("\\\\", "\\"))
def f16(spark, d) -> DataFrame:
    x = F.regexp_replace(T.fold(F.lower(F.regexp_replace("text", "-\n", ""))), "[^a-z0-9]+", "")
    return table(spark, d, "page_chunks").filter("text IS NOT NULL").select("doc_id", "page_number", F.length(x).cast("long").alias("n_chars")).distinct()


@BOOK.add("F17_doc_labels", r"SELECT DISTINCT filename, left(regexp_replace(regexp_replace(regexp_replace(lower(filename), '\.[a-z0-9]{1,5}$', ''), '\s*\(\d+\)|_v\d+|-final', '', 'g'), '[_-]+', ' ', 'g'), 34) AS label FROM chunks WHERE filename IS NOT NULL")
def f17(spark, d) -> DataFrame:
    x = F.regexp_replace(F.lower("filename"), r"\.[a-z0-9]{1,5}$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\(\d+\)|_v\d+|-final", ""), "[_-]+", " ")
    return table(spark, d, "chunks").filter("filename IS NOT NULL").select("filename", F.substring(x, 1, 34).alias("label")).distinct()


@BOOK.add("F18_source_tags", "SELECT DISTINCT doc_id || '#page=' || page_number AS tag, doc_id AS base, 'p. ' || page_number AS page FROM page_chunks")
def f18(spark, d) -> DataFrame:
    tag = F.concat_ws("#page=", "doc_id", "page_number")
    t = table(spark, d, "page_chunks").select(tag.alias("tag")).distinct()
    return t.select("tag", F.regexp_extract("tag", "^(.*?)#", 1).alias("base"), F.concat(F.lit("p. "), F.regexp_extract("tag", r"page=(\d+)", 1)).alias("page"))


@BOOK.add("F31_salient_terms", f"SELECT DISTINCT query_id, unnest(list_concat(regexp_extract_all(question, '[A-Z]{{2,}}-[0-9]+'), list_filter({WORDS.format('question')}, lambda w: length(w) >= 6))) AS term FROM questions")
def f31(spark, d) -> DataFrame:
    long = F.filter(T.words(F.col("question")), lambda w: F.length(w) >= 6)
    codes = F.regexp_extract_all("question", F.lit("([A-Z]{2,}-[0-9]+)"), 1)
    return table(spark, d, "questions").select("query_id", F.explode(F.array_union(codes, long)).alias("term"))


@BOOK.add("F32_entropy_by_document", "WITH c AS (SELECT relationship_properties['source_doc'] AS doc, predicate, count(*) AS n FROM triples WHERE predicate IS NOT NULL GROUP BY ALL), t AS (SELECT doc, sum(n) AS s FROM c GROUP BY doc) SELECT c.doc, round(-sum(n / s * log2(n / s)), 6) AS entropy FROM c JOIN t ON c.doc IS NOT DISTINCT FROM t.doc GROUP BY c.doc")
def f32(spark, d) -> DataFrame:
    c = table(spark, d, "triples").filter("predicate IS NOT NULL").groupBy(F.col("relationship_properties")["source_doc"].alias("doc"), "predicate").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("doc").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log2("n")).alias("h"))
    return g.select("doc", F.round(F.log2("s") - F.col("h") / F.col("s"), 6).alias("entropy"))


@BOOK.add("F35_metadata_json", "SELECT DISTINCT result_id, coalesce(metadata['framework'], '') AS framework, TRY_CAST(metadata['run_index'] AS INT) AS run_index FROM results")
def f35(spark, d) -> DataFrame:
    j = table(spark, d, "results").select("result_id", F.to_json("metadata").alias("j"))
    p = F.from_json("j", "framework string, run_index string")
    return j.select("result_id", p.alias("p")).select("result_id", F.coalesce("p.framework", F.lit("")).alias("framework"), F.col("p.run_index").try_cast("int").alias("run_index")).distinct()


@BOOK.add("F41_suite_dedupe", f"SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY array_to_string({WORDS.format('question')}, ' ') ORDER BY item_id) AS r FROM eval_items) WHERE r = 1")
def f41(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").groupBy(F.array_join(T.words(F.col("question")), " ").alias("k")).agg(F.min("item_id").alias("item_id")).select("item_id")


@BOOK.add("F42_name_containment", f"SELECT pair_id, contains(' ' || array_to_string({WORDS.format('left_name')}, ' ') || ' ', ' ' || array_to_string({WORDS.format('right_name')}, ' ') || ' ') AND len({WORDS.format('right_name')}) > 0 AS inside FROM match_pairs WHERE left_name IS NOT NULL AND right_name IS NOT NULL")
def f42(spark, d) -> DataFrame:
    m = table(spark, d, "match_pairs").filter("left_name IS NOT NULL AND right_name IS NOT NULL")
    return m.select("pair_id", T.contains_words(F.col("left_name"), F.col("right_name")).alias("inside"))


@BOOK.add("P05_type_whitelist", f"WITH {EDGES} SELECT src, type, dst FROM edges WHERE type IN ('PARTNER_OF', 'REPLACES', 'EMITS')")
def p05(spark, d) -> DataFrame:
    return _edges(spark, d).filter(F.col("type").isin("PARTNER_OF", "REPLACES", "EMITS")).select("src", "type", "dst")


@BOOK.add("P11_storable_properties", "SELECT triple_id, e.key AS property, e.value AS value FROM (SELECT triple_id, unnest(map_entries(relationship_properties)) AS e FROM triples) WHERE e.value IS NOT NULL")
def p11(spark, d) -> DataFrame:
    return table(spark, d, "triples").select("triple_id", F.explode("relationship_properties").alias("property", "value")).filter("value IS NOT NULL")


@BOOK.add("P20_question_quality", "SELECT item_id, CASE WHEN length(question) < 30 THEN 'short' WHEN contains(lower(passage), lower(question)) THEN 'self answering' WHEN question_type IS NULL THEN 'no type' ELSE 'ok' END AS verdict FROM eval_items")
def p20(spark, d) -> DataFrame:
    v = F.when(F.length("question") < 30, "short").when(F.contains(F.lower("passage"), F.lower("question")), "self answering").when(F.col("question_type").isNull(), "no type").otherwise("ok")
    return table(spark, d, "eval_items").select("item_id", v.alias("verdict"))


@BOOK.add("P25_abstentions", f"WITH {RUNS} SELECT strategy, count(*) FILTER (WHERE coalesce(kg_triples_used, 0) = 0 AND insufficient) AS abstained, count(*) FILTER (WHERE coalesce(kg_triples_used, 0) = 0) AS empty_handed FROM runs GROUP BY strategy")
def p25(spark, d) -> DataFrame:
    none = F.coalesce("kg_triples_used", F.lit(0)) == 0
    return _runs(spark, d).groupBy("strategy").agg(F.count_if(none & F.col("insufficient")).alias("abstained"), F.count_if(none).alias("empty_handed"))


# ---- A: reports


@BOOK.add("A11_resource_peaks", "SELECT event_type, date_part('hour', ts)::INT AS hour, round(max(value), 6) AS peak, count(*) AS n FROM events GROUP BY 1, 2")
def a11(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.round(F.max("value"), 6).alias("peak"), F.count(F.lit(1)).alias("n"))


@BOOK.add("A12_telemetry_summary", "SELECT user_id, count(*) AS samples, round(avg(value), 4) AS mean, max(value) AS peak, round(date_diff('second', min(ts), max(ts)), 0)::BIGINT AS seconds FROM events GROUP BY user_id")
def a12(spark, d) -> DataFrame:
    sec = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"), sec.alias("seconds"))


@BOOK.add("A15_level_gaps", f"WITH {RUNS}, s AS (SELECT strategy, avg((NOT coalesce(insufficient, false))::INT) AS answered, avg((coalesce(kg_triples_used, 0) > 0)::INT) AS grounded FROM runs WHERE strategy IS NOT NULL GROUP BY strategy) SELECT strategy, round(answered - grounded, 6) AS gap FROM s")
def a15(spark, d) -> DataFrame:
    s = _runs(spark, d).filter("strategy IS NOT NULL").groupBy("strategy").agg(F.avg((~F.coalesce("insufficient", F.lit(False))).cast("int")).alias("a"), F.avg((F.coalesce("kg_triples_used", F.lit(0)) > 0).cast("int")).alias("g"))
    return s.select("strategy", F.round(F.col("a") - F.col("g"), 6).alias("gap"))


@BOOK.add("A21_top_types", f"WITH {EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC, type LIMIT 50")
def a21(spark, d) -> DataFrame:
    return _edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(50)


@BOOK.add("A26_slot_buckets", f"""WITH v AS (SELECT DISTINCT lower(replace(predicate, '_', ' ')) AS en FROM relation_vocab), i AS (SELECT DISTINCT lower(label_it) AS it FROM relation_vocab), x AS (SELECT DISTINCT predicate, lower(replace(predicate, '_', ' ')) AS p FROM triples WHERE predicate IS NOT NULL)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN p IN (SELECT en FROM v) THEN 'en' WHEN p IN (SELECT it FROM i) THEN 'it_only' ELSE 'absent' END AS bucket FROM x) GROUP BY bucket""")
def a26(spark, d) -> DataFrame:
    v = table(spark, d, "relation_vocab")
    x = table(spark, d, "triples").filter("predicate IS NOT NULL").select("predicate", F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("p")).distinct()
    x = x.join(v.select(F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("p"), F.lit(1).alias("en")).distinct(), "p", "left").join(v.select(F.lower("label_it").alias("p"), F.lit(1).alias("it")).distinct(), "p", "left")
    return x.groupBy(F.when(F.col("en") == 1, "en").when(F.col("it") == 1, "it_only").otherwise("absent").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("A31_baseline_update", f"WITH {RUNS}, o AS (SELECT strategy, count(*) AS n FROM runs WHERE run_index = '1' GROUP BY strategy), c AS (SELECT strategy, count(*) AS n FROM runs WHERE run_index = '2' AND strategy <> 'hybrid' GROUP BY strategy) SELECT coalesce(c.strategy, o.strategy) AS strategy, coalesce(c.n, o.n) AS n FROM (SELECT * FROM o WHERE strategy IS NOT NULL) o FULL JOIN c ON o.strategy = c.strategy")
def a31(spark, d) -> DataFrame:
    r = _runs(spark, d).filter("strategy IS NOT NULL")
    o = r.filter("run_index = '1'").groupBy("strategy").agg(F.count(F.lit(1)).alias("o"))
    c = r.filter("run_index = '2' AND strategy <> 'hybrid'").groupBy("strategy").agg(F.count(F.lit(1)).alias("c"))
    return o.join(c, "strategy", "full").select("strategy", F.coalesce("c", "o").alias("n"))


@BOOK.add("A36_source_listing", "SELECT coalesce(source, '') AS source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def a36(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@BOOK.add("A37_annotation_accuracy", "SELECT left_label AS label, count(*) FILTER (WHERE same_entity) AS yes, count(*) FILTER (WHERE NOT same_entity) AS no, count(*) FILTER (WHERE same_entity IS NULL) AS unclear, round(count(*) FILTER (WHERE same_entity) / nullif(count(same_entity), 0), 6) AS accuracy FROM match_pairs GROUP BY left_label")
def a37(spark, d) -> DataFrame:
    g = table(spark, d, "match_pairs").groupBy(F.col("left_label").alias("label"))
    return g.agg(F.count_if("same_entity").alias("yes"), F.count_if(~F.col("same_entity")).alias("no"), F.count_if(F.col("same_entity").isNull()).alias("unclear"), F.round(M.ratio(F.count_if("same_entity"), F.count("same_entity")), 6).alias("accuracy"))


# ---- J, U, W


@BOOK.add("J05_two_judges", "WITH a AS (SELECT least(left_group, right_group) AS x, greatest(left_group, right_group) AS y, max(similarity) AS s FROM match_pairs WHERE left_group < right_group GROUP BY ALL), b AS (SELECT least(left_group, right_group) AS x, greatest(left_group, right_group) AS y, max(similarity) AS s FROM match_pairs WHERE left_group > right_group GROUP BY ALL) SELECT a.x, a.y, round(a.s - b.s, 6) AS delta FROM a JOIN b ON a.x = b.x AND a.y = b.y WHERE a.s IS NOT NULL AND b.s IS NOT NULL")
def j05(spark, d) -> DataFrame:
    m = table(spark, d, "match_pairs").select(F.least("left_group", "right_group").alias("x"), F.greatest("left_group", "right_group").alias("y"), "similarity", (F.col("left_group") < F.col("right_group")).alias("up"), (F.col("left_group") > F.col("right_group")).alias("down"))
    g = m.groupBy("x", "y").agg(F.max(F.when(F.col("up"), F.col("similarity"))).alias("a"), F.max(F.when(F.col("down"), F.col("similarity"))).alias("b"))
    return g.filter("a IS NOT NULL AND b IS NOT NULL").select("x", "y", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@BOOK.add("J17_best_namesake", f"WITH {NODES}, {EDGES}, {DEG}, k AS (SELECT node_id, {_name('name')} AS key, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg ON node_id = node), b AS (SELECT key, node_id AS best, row_number() OVER (PARTITION BY key ORDER BY degree DESC, node_id) AS r FROM k) SELECT DISTINCT e.entity_id, b.best FROM registry e JOIN b ON {_name('e.canonical_name')} = b.key WHERE r = 1 AND b.key <> ''")
def j17(spark, d) -> DataFrame:
    k = _nodes(spark, d).select("node_id", T.name_key(F.col("name")).alias("key")).filter("key <> ''").join(G.degrees(_edges(spark, d)).withColumnRenamed("node", "node_id"), "node_id", "left").fillna(0, ["degree"])
    b = k.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node_id")).alias("b")).select("key", F.col("b.node_id").alias("best"))
    return table(spark, d, "registry").select("entity_id", T.name_key(F.col("canonical_name")).alias("key")).join(b, "key").select("entity_id", "best").distinct()


@BOOK.add("J18_connected_pairs", f"WITH {EDGES}, h AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM edges), p AS (SELECT DISTINCT pair_id, least({_key('left_name')}, {_key('right_name')}) AS x, greatest({_key('left_name')}, {_key('right_name')}) AS y FROM match_pairs WHERE left_name IS NOT NULL AND right_name IS NOT NULL) SELECT pair_id FROM p WHERE EXISTS (SELECT 1 FROM h WHERE h.x = p.x AND h.y = p.y)")
def j18(spark, d) -> DataFrame:
    h = _edges(spark, d).select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    a, b = T.triple_key(F.col("left_name")), T.triple_key(F.col("right_name"))
    p = table(spark, d, "match_pairs").filter("left_name IS NOT NULL AND right_name IS NOT NULL").select("pair_id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    return p.join(h, ["x", "y"], "left_semi").select("pair_id")


@BOOK.add("J22_slots_found", f"WITH s AS (SELECT item_id, unnest(list_distinct({WORDS.format('canonical_answer')})) AS w FROM eval_items), m AS (SELECT item_id, unnest(list_distinct({WORDS.format('passage')})) AS w FROM eval_items) SELECT s.item_id, count(*) AS slots, count(m.w) AS found FROM s LEFT JOIN m ON s.item_id = m.item_id AND s.w = m.w GROUP BY s.item_id")
def j22(spark, d) -> DataFrame:
    e = table(spark, d, "eval_items")
    s = e.select("item_id", F.explode(F.array_distinct(T.words(F.col("canonical_answer")))).alias("w"))
    m = e.select("item_id", F.explode(F.array_distinct(T.words(F.col("passage")))).alias("w")).withColumn("hit", F.lit(1))
    return s.join(m, ["item_id", "w"], "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("slots"), F.count("hit").alias("found"))


@BOOK.add("U01_anomalies", f"WITH {NODES}, {EDGES} SELECT edge_id FROM edges e JOIN nodes n ON e.src = n.node_id WHERE type = 'LOCATED_IN' AND label = 'Place' UNION SELECT edge_id FROM edges WHERE src = dst")
def u01(spark, d) -> DataFrame:
    e = _edges(spark, d)
    a = e.filter("type = 'LOCATED_IN'").join(_nodes(spark, d).filter("label = 'Place'").select(F.col("node_id").alias("src")), "src").select("edge_id")
    return a.union(e.filter("src = dst").select("edge_id")).distinct()


@BOOK.add("U04_context_union", "SELECT doc_id, count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS n FROM chunks GROUP BY doc_id".replace("\\\\", "\\"))
def u04(spark, d) -> DataFrame:
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.countDistinct(T.triple_key(F.col("text"))).alias("n"))


@BOOK.add("W08_tie_ranks", "SELECT pair_id, rank() OVER (PARTITION BY left_label ORDER BY round(similarity, 1)) + (count(*) OVER (PARTITION BY left_label, round(similarity, 1)) - 1) / 2.0 AS r FROM match_pairs WHERE similarity IS NOT NULL")
def w08(spark, d) -> DataFrame:
    m = table(spark, d, "match_pairs").filter("similarity IS NOT NULL").withColumn("s", F.round("similarity", 1))
    return K.tie_ranks(m, "s", "r", ["left_label"]).select("pair_id", "r")


@BOOK.add("W12_kth_occurrence", f"WITH {RUNS} SELECT result_id, row_number() OVER (PARTITION BY strategy, query_id ORDER BY started_at, result_id)::INT AS k FROM runs")
def w12(spark, d) -> DataFrame:
    r = K.numbered(_runs(spark, d).select("strategy", "query_id", "started_at", "result_id"), ["strategy", "query_id"], ["started_at", "result_id"], "k")
    return r.select("result_id", F.col("k").cast("int").alias("k"))


@BOOK.add("O06_most_common", "SELECT doc, predicate, n FROM (SELECT relationship_properties['source_doc'] AS doc, predicate, count(*) AS n, row_number() OVER (PARTITION BY relationship_properties['source_doc'] ORDER BY count(*) DESC, predicate) AS r FROM triples WHERE predicate IS NOT NULL GROUP BY 1, 2) WHERE r <= 3")
def o06(spark, d) -> DataFrame:
    c = table(spark, d, "triples").filter("predicate IS NOT NULL").groupBy(F.col("relationship_properties")["source_doc"].alias("doc"), "predicate").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "predicate"))).filter("r <= 3").select("doc", "predicate", "n")


# ---- G, R


SAME = "SELECT left_group AS u, right_group AS v FROM match_pairs WHERE same_entity AND left_group IS NOT NULL AND right_group IS NOT NULL"


@BOOK.add("G09_same_as_contracted", closure_sql(f"{SAME} UNION SELECT v, u FROM ({SAME})") + """, g AS (SELECT entity_id, max(len(aliases)) AS degree FROM registry GROUP BY entity_id), k AS (SELECT c, u, row_number() OVER (PARTITION BY c ORDER BY coalesce(degree, 0) DESC, u) AS rn FROM cc LEFT JOIN g ON u = entity_id)
SELECT cc.u AS entity_id, k.u AS keep FROM cc JOIN k ON cc.c = k.c AND k.rn = 1""")
def g09(spark, d) -> DataFrame:
    return _contracted(spark, d, table(spark, d, "match_pairs").filter("same_entity"))


def _contracted(spark, d, m: DataFrame) -> DataFrame:
    """(entity_id, keep): records of the pairs m, and the one of their component that stays."""
    c = G.components(m.select(F.col("left_group").alias("src"), F.lit("SAME_AS").alias("type"), F.col("right_group").alias("dst"), F.col("pair_id").alias("edge_id")))
    g = table(spark, d, "registry").groupBy(F.col("entity_id").alias("node")).agg(F.max(F.size("aliases")).alias("degree"))
    k = c.join(g, "node", "left").groupBy("component").agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "node")).alias("k"))
    return c.join(k, "component").select(F.col("node").alias("entity_id"), F.col("k.node").alias("keep"))


@BOOK.add("G15_renamed_types", f"WITH {EDGES} SELECT src, type, dst, min(edge_id) AS edge_id, sum(n)::BIGINT AS n FROM (SELECT src, CASE type WHEN 'REDUCES' THEN 'AFFECTS' WHEN 'INCREASES' THEN 'AFFECTS' ELSE type END AS type, dst, edge_id, n FROM edges) GROUP BY src, type, dst")
def g15(spark, d) -> DataFrame:
    return G.rewrite_types(_edges(spark, d), [("REDUCES", "AFFECTS", False), ("INCREASES", "AFFECTS", False)])


@BOOK.add("G17_directed_by_labels", f"WITH {NODES}, {EDGES} SELECT CASE WHEN s.label = 'Place' AND o.label = 'Organization' THEN e.dst ELSE e.src END AS src, CASE WHEN s.label = 'Place' AND o.label = 'Organization' THEN e.src ELSE e.dst END AS dst, e.edge_id FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes o ON e.dst = o.node_id WHERE type = 'LOCATED_IN'")
def g17(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    e = _edges(spark, d).filter("type = 'LOCATED_IN'").join(n.select(F.col("node_id").alias("src"), F.col("label").alias("ls")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("label").alias("lo")), "dst")
    flip = (F.col("ls") == "Place") & (F.col("lo") == "Organization")
    return e.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge_id")


@BOOK.add("G22_relabelled_by_names", "SELECT DISTINCT entity_id, CASE WHEN regexp_matches(canonical_name, '^(Cooperativa|Consorzio|Fondazione|Istituto) ') THEN 'Organization' ELSE labels[1] END AS label FROM registry WHERE canonical_name IS NOT NULL")
def g22(spark, d) -> DataFrame:
    lab = F.when(F.col("canonical_name").rlike("^(Cooperativa|Consorzio|Fondazione|Istituto) "), "Organization").otherwise(F.try_element_at("labels", F.lit(1)))
    return table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", lab.alias("label")).distinct()


NODE_HITS = f"""nw AS (SELECT node_id AS node, unnest(list_distinct({WORDS.format('name')})) AS token FROM nodes), sw AS (SELECT DISTINCT token FROM nw JOIN seeds ON node = node_id),
ndf AS (SELECT token, count(*) AS df FROM nw GROUP BY token), hits AS (SELECT s.node_id AS seed, b.node, round(sum(1.0 / df), 6) AS score FROM seeds s JOIN nw a ON a.node = s.node_id JOIN nw b USING (token) JOIN ndf USING (token) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) AS r FROM hits) WHERE r <= 5)"""


@BOOK.add("R07_triple_search", f"WITH {NODES}, {EDGES}, {INC}, {SEEDS}, {NODE_HITS}, h AS (SELECT seed, edge_id, max(score) AS score FROM inc JOIN best USING (node) GROUP BY seed, edge_id) SELECT seed, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, edge_id) AS r FROM h) WHERE r <= 20")
def r07(spark, d) -> DataFrame:
    """Edges of the nodes that the text search finds for each seed name, with the best node's score; 20 for each seed."""
    words = materialize(_nodes(spark, d).select(F.col("node_id").alias("node"), F.explode(F.array_distinct(T.words(F.col("name")))).alias("token")), "namewords")
    df = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    own = words.join(_seeds(spark, d).withColumnRenamed("node_id", "node"), "node", "left_semi").join(df, "token").select(F.col("node").alias("seed"), "token", (1.0 / F.col("df")).alias("w"))
    hits = words.join(own, "token").groupBy("seed", "node").agg(F.round(F.sum("w"), 6).alias("score"))
    best = R.top_k(hits, 5, group="seed", key="node")
    h = G.incident(_edges(spark, d)).join(best.select("seed", "node", "score"), "node").groupBy("seed", "edge_id").agg(F.max("score").alias("score"))
    return R.top_k(h, 20, group="seed", key="edge_id").select("seed", "edge_id", "score")


@BOOK.add("R08_vector_nodes", f"WITH {VEC}, s AS (SELECT a.key AS query, b.key, b.label, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.key % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS r FROM s) SELECT query, key, score FROM t WHERE r <= 20 AND score >= 0.2 AND label < 5")
def r08(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = R.unit(e, "vec_id", "embedding")
    # the filters stand after the top-k on purpose: they shrink the result
    near = R.vector_top_k(v, v.filter("key % 100 = 0"), 20).filter("score >= 0.2")
    return near.join(e.filter("label < 5").select(F.col("vec_id").alias("key")), "key").select("query", "key", "score")


@BOOK.add("R21_candidate_edges", f"WITH q AS (SELECT item_id, list_distinct({WORDS.format('canonical_answer')}) AS qw FROM eval_items WHERE item_id % 100 = 0), t AS (SELECT triple_id, list_distinct({WORDS.format('subject')}) AS sw, list_distinct({WORDS.format('object')}) AS ow FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL), x AS (SELECT item_id, triple_id, len(list_intersect(list_distinct(list_concat(sw, ow)), qw)) AS c, len(list_distinct(list_concat(sw, ow))) AS n FROM q, t WHERE list_has_any(sw, qw) AND list_has_any(ow, qw)) SELECT item_id, triple_id, round(0.6 * c / n + 0.4, 6) AS score FROM x")
def r21(spark, d) -> DataFrame:
    q = table(spark, d, "eval_items").filter("item_id % 100 = 0").select("item_id", F.array_distinct(T.words(F.col("canonical_answer"))).alias("qw"))
    t = table(spark, d, "triples").filter("subject IS NOT NULL AND object IS NOT NULL").select("triple_id", F.array_distinct(T.words(F.col("subject"))).alias("sw"), F.array_distinct(T.words(F.col("object"))).alias("ow"))
    s = t.select("triple_id", "sw", "ow", F.explode("sw").alias("w")).join(q.select("item_id", "qw", F.explode("qw").alias("w")), "w").filter(F.arrays_overlap("ow", "qw")).dropDuplicates(["item_id", "triple_id"])
    every = F.array_union("sw", "ow")
    return s.select("item_id", "triple_id", F.round(0.6 * F.size(F.array_intersect(every, "qw")) / F.size(every) + 0.4, 6).alias("score"))


@BOOK.add("M14_best_variant", f"SELECT entity_id, max(len(list_intersect(list_distinct({WORDS.format('canonical_name')}), list_distinct({WORDS.format('a')})))) AS best FROM (SELECT entity_id, canonical_name, unnest(aliases) AS a FROM registry WHERE canonical_name IS NOT NULL) GROUP BY entity_id")
def m14(spark, d) -> DataFrame:
    own = T.words(F.col("canonical_name"))
    r = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", F.array_max(F.transform("aliases", lambda a: F.size(F.array_intersect(own, T.words(a))))).cast("long").alias("b"))
    return r.filter("b IS NOT NULL").groupBy("entity_id").agg(F.max("b").alias("best"))


@BOOK.add("M24_label_collisions", "SELECT form, count(DISTINCT predicate) AS n FROM (SELECT predicate, lower(unnest(list_append(aliases, label_it))) AS form FROM relation_vocab) GROUP BY form")
def m24(spark, d) -> DataFrame:
    v = table(spark, d, "relation_vocab").select("predicate", F.explode(F.array_append("aliases", F.col("label_it"))).alias("f"))
    return v.groupBy(F.lower("f").alias("form")).agg(F.countDistinct("predicate").alias("n"))


@BOOK.add("M27_gate_confusion", f"WITH {RUNS} SELECT strategy, count(*) FILTER (WHERE insufficient AND coalesce(kg_triples_used, 0) > 0) AS false_refusals, count(*) FILTER (WHERE NOT insufficient AND coalesce(kg_triples_used, 0) = 0) AS false_accepts, count(insufficient) AS n FROM runs GROUP BY strategy")
def m27(spark, d) -> DataFrame:
    k = F.coalesce("kg_triples_used", F.lit(0))
    return _runs(spark, d).groupBy("strategy").agg(F.count_if(F.col("insufficient") & (k > 0)).alias("false_refusals"), F.count_if(~F.col("insufficient") & (k == 0)).alias("false_accepts"), F.count("insufficient").alias("n"))


@BOOK.add("M29_citation_extraction", r"WITH c AS (SELECT DISTINCT result_id, unnest(regexp_extract_all(answer, '\(([A-Z]+-\d+)\)', 1)) AS code FROM results WHERE answer IS NOT NULL) SELECT code, count(*) AS answers FROM c GROUP BY code")
def m29(spark, d) -> DataFrame:
    c = table(spark, d, "results").filter("answer IS NOT NULL").select("result_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\(([A-Z]+-\d+)\)"), 1)).alias("code")).distinct()
    return c.groupBy("code").agg(F.count(F.lit(1)).alias("answers"))


@BOOK.add("T02_paired_bootstrap", f"""WITH {RUNS}, m AS (SELECT strategy, query_id, avg(latency) AS l FROM runs WHERE latency IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL), p AS (SELECT a.query_id, a.l - b.l AS delta FROM m a JOIN m b ON a.query_id = b.query_id WHERE a.strategy = 'hybrid' AND b.strategy = 'default'),
r AS (SELECT *, unnest(range(1, 101)) AS r FROM p), u AS (SELECT *, ('0x' || left(md5(query_id || '|' || r), 8))::UBIGINT / 4294967296.0 AS u FROM r),
w AS (SELECT r, delta, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS w FROM u),
b AS (SELECT sum(w * delta) / sum(w) AS m FROM w GROUP BY r HAVING sum(w) > 0) SELECT (SELECT count(*) FROM p) AS n, round(avg((m > 0)::INT), 6) AS p_above FROM b""")
def t02(spark, d) -> DataFrame:
    m = _runs(spark, d).filter("latency IS NOT NULL AND query_id IS NOT NULL").groupBy("strategy", "query_id").agg(F.avg("latency").alias("l"))
    p = m.filter("strategy = 'hybrid'").select("query_id", F.col("l").alias("a")).join(m.filter("strategy = 'default'").select("query_id", F.col("l").alias("b")), "query_id").select("query_id", (F.col("a") - F.col("b")).alias("delta"))
    sums = M.resampled(p, "query_id", "delta", [])
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return sums.agg(F.round(F.avg((F.col("m") > 0).cast("int")), 6).alias("p_above")).join(F.broadcast(n)).select("n", "p_above")


@BOOK.add("S24_failed_chunks", "SELECT DISTINCT chunk_id FROM chunks WHERE text IS NULL OR length(trim(text)) < 20 OR lang IS NULL")
def s24(spark, d) -> DataFrame:
    return table(spark, d, "chunks").filter(F.col("text").isNull() | (F.length(F.trim("text")) < 20) | F.col("lang").isNull()).select("chunk_id").distinct()


@BOOK.add("K10_telemetry_rows", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def k10(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("X04_acronyms_expanded", r"""WITH a AS (SELECT upper(alias) AS k, canonical_name FROM (SELECT unnest(aliases) AS alias, canonical_name FROM registry WHERE canonical_name IS NOT NULL) WHERE regexp_matches(alias, '^[A-Z]{2,6}( |$)')
 AND starts_with(upper(array_to_string(list_transform(regexp_extract_all(canonical_name, '[\p{L}\p{N}]+'), lambda w: left(w, 1)), '')), regexp_extract(alias, '^([A-Z]{2,6})', 1))),
m AS (SELECT k, min(canonical_name) AS full_name FROM a GROUP BY k), s AS (SELECT DISTINCT n FROM (SELECT subject AS n FROM triples UNION ALL SELECT object FROM triples) WHERE n IS NOT NULL)
SELECT n AS surface, full_name FROM s JOIN m ON upper(n) = k""")
def x04(spark, d) -> DataFrame:
    """Names of the triples that are an acronym of a record: an alias in capitals whose letters begin the words of its name."""
    r = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("canonical_name", F.explode("aliases").alias("alias"))
    initials = F.upper(F.array_join(F.transform(F.regexp_extract_all("canonical_name", F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.left(w, F.lit(1))), ""))
    r = r.filter(F.col("alias").rlike("^[A-Z]{2,6}( |$)") & F.startswith(initials, F.regexp_extract("alias", "^([A-Z]{2,6})", 1)))
    known = r.groupBy(F.upper("alias").alias("k")).agg(F.min("canonical_name").alias("full_name"))
    t = table(spark, d, "triples")
    names = t.select(F.col("subject").alias("surface")).unionByName(t.select(F.col("object").alias("surface"))).filter("surface IS NOT NULL").distinct()
    return names.withColumn("k", F.upper("surface")).join(known, "k").select("surface", "full_name")


@BOOK.add("L19_evidence_lines", "SELECT triple_id, subject || ' ' || lower(replace(predicate, '_', ' ')) || ' ' || object AS line FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
def l19(spark, d) -> DataFrame:
    t = table(spark, d, "triples").filter("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    return t.select("triple_id", F.concat_ws(" ", "subject", F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))), "object").alias("line"))
