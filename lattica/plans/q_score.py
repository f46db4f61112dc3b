"""Queries of scorers, evidence and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize, table
from lattica.functions import text as T
from lattica.operators import evidence as E
from lattica.operators import extract
from lattica.operators import graph as G
from lattica.operators import metrics as M
from lattica.operators import ranks as K
from lattica.plans.base import Book
from lattica.plans.q_build import WORDS
from lattica.plans.q_eval import RUNS, _runs
from lattica.plans.q_graph import ARCS, EDGES, NODES, _edges, _nodes, closure_sql
from lattica.plans.q_text import STOP_SQL

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- M: expected and retrieved entities of the held-out items. An entity is what a registry name names, without whose
# it is ("olive pomace" of "olive pomace of Selrendodera"); it is anchored where all its records bear one label

HEAD = r" (of|di|de|del|della|dell'|von|da) .*$"
HEADS = f"names AS (SELECT DISTINCT array_to_string({WORDS.format(f"regexp_replace(canonical_name, {_lit(HEAD)}, '')")}, ' ') AS phrase FROM registry WHERE canonical_name IS NOT NULL)"


def _heads(spark, d) -> DataFrame:
    """(phrase, label): what the registry names name."""
    r = table(spark, d, "registry").filter("canonical_name IS NOT NULL")
    return r.select(F.array_join(T.words(F.regexp_replace("canonical_name", HEAD, "")), " ").alias("phrase"), F.get("labels", F.lit(0)).alias("label")).filter("phrase <> ''")


def _grams(field: str) -> str:
    longest = "(SELECT max(len(string_split(phrase, ' '))) FROM names)"
    return f"(SELECT DISTINCT item_id, phrase FROM (SELECT item_id, array_to_string(w[p:(p + n - 1)], ' ') AS phrase FROM (SELECT item_id, w, p, unnest(range(1, least({longest}, len(w) - p + 1) + 1)) AS n FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT item_id, {WORDS.format(field)} AS w FROM eval_items)))) WHERE phrase IN (SELECT phrase FROM names WHERE phrase <> ''))"


ENTITIES = f"""{HEADS}, owners AS (SELECT array_to_string({WORDS.format(f"regexp_replace(canonical_name, {_lit(HEAD)}, '')")}, ' ') AS phrase, count(DISTINCT labels[1]) AS owners FROM registry WHERE canonical_name IS NOT NULL GROUP BY 1),
want AS {_grams('canonical_answer')}, got AS {_grams('passage')},
m AS (SELECT coalesce(want.item_id, got.item_id) AS item_id, coalesce(want.phrase, got.phrase) AS phrase, want.phrase IS NOT NULL AS w, got.phrase IS NOT NULL AS g FROM want FULL JOIN got ON want.item_id = got.item_id AND want.phrase = got.phrase),
s AS (SELECT item_id, count(*) FILTER (WHERE w) AS n_want, count(*) FILTER (WHERE g) AS n_got, count(*) FILTER (WHERE w AND g) AS hit, count(*) FILTER (WHERE w AND owners = 1) AS anchorable, count(*) FILTER (WHERE w AND g AND owners = 1) AS grounded FROM m JOIN owners USING (phrase) GROUP BY item_id),
items AS (SELECT item_id, max(question_type) AS question_type, coalesce(max(n_want), 0) AS n_want, coalesce(max(n_got), 0) AS n_got, coalesce(max(hit), 0) AS hit, coalesce(max(anchorable), 0) AS anchorable, coalesce(max(grounded), 0) AS grounded FROM eval_items LEFT JOIN s USING (item_id) GROUP BY item_id)"""


def _item_entities(spark, d) -> DataFrame:
    """Per item: entities expected (in the answer), retrieved (in the passage), both; those that are anchored."""
    reg = _heads(spark, d)
    owners = reg.groupBy("phrase").agg(F.countDistinct("label").alias("owners"))
    items = table(spark, d, "eval_items")
    both = items.select("item_id", F.lit("want").alias("side"), F.col("canonical_answer").alias("t")).unionByName(items.select("item_id", F.lit("got").alias("side"), F.col("passage").alias("t"))).distinct()
    both = both.withColumn("k", F.struct("item_id", "side"))
    m = extract.gazetteer_mentions(both, "k", "t", reg).select("k.item_id", "k.side", "phrase").distinct()
    m = m.groupBy("item_id", "phrase").agg(F.max(F.col("side") == "want").alias("w"), F.max(F.col("side") == "got").alias("g")).join(owners, "phrase")
    w, g, one = F.col("w"), F.col("g"), F.col("owners") == 1
    s = m.groupBy("item_id").agg(F.count_if(w).alias("n_want"), F.count_if(g).alias("n_got"), F.count_if(w & g).alias("hit"), F.count_if(w & one).alias("anchorable"), F.count_if(w & g & one).alias("grounded"))
    kinds = items.groupBy("item_id").agg(F.max("question_type").alias("question_type"))
    return kinds.join(s, "item_id", "left").fillna(0, ["n_want", "n_got", "hit", "anchorable", "grounded"])


@BOOK.add("M07_entity_coverage", f"WITH {ENTITIES} SELECT item_id, n_want, n_got, round(hit / nullif(n_want, 0), 6) AS coverage FROM items")
def m07(spark, d) -> DataFrame:
    """Share of the expected entities that were retrieved; null where none is expected."""
    return _item_entities(spark, d).select("item_id", "n_want", "n_got", F.round(M.ratio(F.col("hit"), F.col("n_want")), 6).alias("coverage"))


@BOOK.add("M16_grounding_prf", f"WITH {ENTITIES} SELECT item_id, n_got, anchorable, grounded, round(grounded / nullif(n_got, 0), 6) AS precision, round(grounded / nullif(anchorable, 0), 6) AS recall FROM items")
def m16(spark, d) -> DataFrame:
    """Only anchored entities ground; retrieved ones of several labels stay in the denominator, expected ones are out of scope."""
    e = _item_entities(spark, d)
    return e.select("item_id", "n_got", "anchorable", "grounded", F.round(M.ratio(F.col("grounded"), F.col("n_got")), 6).alias("precision"), F.round(M.ratio(F.col("grounded"), F.col("anchorable")), 6).alias("recall"))


@BOOK.add("M17_M18_row_scores", f"""WITH {ENTITIES} SELECT item_id, CASE WHEN question_type IS NULL THEN 'distractor' ELSE 'scored' END AS kind, CASE WHEN question_type IS NULL THEN (n_got = 0)::INT END AS abstained,
CASE WHEN question_type IS NOT NULL THEN round(hit / nullif(n_want, 0), 6) END AS concept_recall, CASE WHEN question_type IS NOT NULL THEN round(grounded / nullif(anchorable, 0), 6) END AS grounding_recall FROM items""")
def m18(spark, d) -> DataFrame:
    """Items without a type are taken as distractors and scored on abstention alone; nothing anchorable, no grounding."""
    e = _item_entities(spark, d)
    off = F.col("question_type").isNull()
    return e.select(
        "item_id", F.when(off, "distractor").otherwise("scored").alias("kind"), F.when(off, (F.col("n_got") == 0).cast("int")).alias("abstained"),
        F.when(~off, F.round(M.ratio(F.col("hit"), F.col("n_want")), 6)).alias("concept_recall"), F.when(~off, F.round(M.ratio(F.col("grounded"), F.col("anchorable")), 6)).alias("grounding_recall"),
    )


# ---- L, F: evidence and definitions


@BOOK.add("L07_visible_references", r"""WITH a AS (SELECT result_id, min(answer) AS answer FROM results GROUP BY result_id), r AS (SELECT result_id, list_distinct(regexp_extract_all(answer, '\[\d+\]|\([A-Z]+-\d+\)')) AS every, list_distinct(regexp_extract_all(left(answer, 400), '\[\d+\]|\([A-Z]+-\d+\)')) AS seen FROM a WHERE answer IS NOT NULL)
SELECT result_id, len(every) AS n_refs, len(seen) AS n_visible FROM r WHERE len(every) > 0""")
def l07(spark, d) -> DataFrame:
    """References of an answer, and those that remain in a context compressed to its first 400 characters."""
    refs = lambda c: F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[\d+\]|\([A-Z]+-\d+\))"), 1))).cast("long")
    a = table(spark, d, "results").groupBy("result_id").agg(F.min("answer").alias("answer")).filter("answer IS NOT NULL")
    return a.select("result_id", refs(F.col("answer")).alias("n_refs"), refs(F.left("answer", F.lit(400))).alias("n_visible")).filter("n_refs > 0")


QUOTES = f"""q AS (SELECT DISTINCT result_id, array_to_string({WORDS.format('raw')}, ' ') AS quote FROM (SELECT result_id, unnest(regexp_extract_all(answer, {_lit(E.QUOTE)}, 1)) AS raw FROM results WHERE answer IS NOT NULL)),
ev AS (SELECT DISTINCT ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS t FROM (SELECT text FROM chunks UNION ALL SELECT passage FROM eval_items) WHERE text IS NOT NULL)"""


@BOOK.add("L09_quotes_verified", f"WITH {QUOTES}, u AS (SELECT DISTINCT quote FROM q WHERE length(quote) >= 25), ok AS (SELECT DISTINCT quote FROM u, ev WHERE contains(t, ' ' || quote || ' ') AND len(string_split(quote, ' ')) >= 4) SELECT result_id, quote, quote IN (SELECT quote FROM ok) AS verified FROM q WHERE length(quote) >= 25")
def l09(spark, d) -> DataFrame:
    """Quoted passages of answers, and whether they stand word for word in a chunk or a passage."""
    q = materialize(E.quotes(table(spark, d, "results").filter("answer IS NOT NULL"), "result_id", "answer"), "quotes")
    texts = table(spark, d, "chunks").select("text").unionByName(table(spark, d, "eval_items").select(F.col("passage").alias("text"))).filter("text IS NOT NULL").distinct()
    ok = E.verbatim(texts, "text", q.select("quote").distinct()).withColumn("hit", F.lit(True))
    return q.join(ok, "quote", "left").select("result_id", "quote", F.coalesce("hit", F.lit(False)).alias("verified"))


@BOOK.add("L10_reference_lists", """WITH r AS (SELECT subject, relationship_properties['source_doc'] AS doc, count(DISTINCT relationship_properties['page_range']) AS pages, min(relationship_properties['page_range']) AS first_pages FROM triples WHERE subject IS NOT NULL AND relationship_properties['source_doc'] IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pages DESC, doc) AS rank, count(*) OVER (PARTITION BY subject) AS documents FROM r) SELECT subject, doc, pages, first_pages, rank::INT AS rank, documents FROM n WHERE rank <= 5""")
def l10(spark, d) -> DataFrame:
    """The documents that a subject is drawn from, the five with most places first, with how many there are."""
    p = F.col("relationship_properties")
    t = table(spark, d, "triples").select("subject", p["source_doc"].alias("doc"), p["page_range"].alias("pages")).filter("subject IS NOT NULL AND doc IS NOT NULL")
    r = materialize(t.groupBy("subject", "doc").agg(F.countDistinct("pages").alias("pages"), F.min("pages").alias("first_pages")), "references")
    top = r.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("pages"), "doc"))).filter("rank <= 5")
    return top.join(r.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")), "subject").select("subject", "doc", "pages", "first_pages", "rank", "documents")


ASKED = "(SELECT DISTINCT trim(question) AS question FROM results WHERE question IS NOT NULL UNION SELECT DISTINCT trim(question) FROM eval_items WHERE question IS NOT NULL)"


def _asked(spark, d) -> DataFrame:
    q = table(spark, d, "results").select(F.trim("question").alias("question")).unionByName(table(spark, d, "eval_items").select(F.trim("question").alias("question")))
    return q.filter("question IS NOT NULL").distinct()


@BOOK.add("F26_F30_question_kinds", f"""WITH a AS (SELECT question, regexp_extract(question, {_lit(E.DEFINITION)}, 1) AS term, regexp_matches(question, {_lit(E.ENUMERATION)}) AS enumerative FROM {ASKED}),
b AS (SELECT *, CASE WHEN term <> '' AND length(term) <= 60 AND len(regexp_split_to_array(term, '\\s+')) <= 6 AND NOT regexp_matches(term, {_lit(E.DEICTIC)}) AND NOT enumerative THEN lower(term) END AS definitional_term FROM a)
SELECT question, definitional_term, enumerative, regexp_matches(question, {_lit(E.FOLLOW_UP)}) OR (len(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) <= 16 AND regexp_matches(question, {_lit(E.POINTING)})) AS follow_up FROM b""")
def f26(spark, d) -> DataFrame:
    """Of every question asked: the term to define, whether it asks for a list, whether it leans on what was said before."""
    q = F.col("question")
    follow = q.rlike(E.FOLLOW_UP) | ((F.size(T.words(q)) <= 16) & q.rlike(E.POINTING))
    return _asked(spark, d).select("question", E.definitional_term(q).alias("definitional_term"), q.rlike(E.ENUMERATION).alias("enumerative"), follow.alias("follow_up"))


TERM_SENTENCES = f"""{HEADS}, s AS (SELECT DISTINCT s, ' ' || array_to_string({WORDS.format('s')}, ' ') || ' ' AS w FROM (SELECT unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM chunks WHERE text IS NOT NULL) WHERE length(s) BETWEEN 40 AND 420 AND regexp_matches(s, '^\\p{{Lu}}') AND regexp_matches(s, '[.!?]$') AND len({WORDS.format('s')}) >= 8),
h AS (SELECT phrase, s, w, string_split(w, ' ' || phrase || ' ') AS parts FROM names JOIN s ON contains(w, ' ' || phrase || ' ') WHERE phrase <> ''),
sc AS (SELECT phrase, s, 0.5 * (length(w) - length(replace(w, ' ' || phrase || ' ', ''))) / (length(phrase) + 2) + CASE WHEN regexp_matches(parts[-1], '^(is|are|means|è|sono|indica) ') THEN 2 ELSE 0 END + CASE WHEN contains(lower(s), phrase || ' (') THEN 3 ELSE 0 END + CASE WHEN contains(lower(s), phrase || ':') THEN 1 ELSE 0 END AS score FROM h)"""


@BOOK.add("F27_F28_L11_definitions", f"WITH {TERM_SENTENCES} SELECT phrase AS term, s AS sentence, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY round(score, 6) DESC, s) AS r FROM sc) WHERE r = 1")
def f27(spark, d) -> DataFrame:
    """The sentence of the chunks that best defines each entity, verbatim."""
    cut = table(spark, d, "chunks").filter("text IS NOT NULL").select(F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s")).distinct()
    good = F.length("s").between(40, 420) & F.col("s").rlike(r"^\p{Lu}") & F.col("s").rlike("[.!?]$") & (F.size(T.words(F.col("s"))) >= 8)
    hits = extract.gazetteer_mentions(cut.filter(good).select("s", F.col("s").alias("t")), "s", "t", _heads(spark, d))
    hits = hits.select("s", F.col("phrase").alias("term")).distinct()
    score = F.round(E.definition_score(F.col("s"), F.array_join(T.words(F.col("s")), " "), F.col("term")), 6)
    best = hits.select("term", "s", score.alias("score")).groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("o"), "s")).alias("b"))
    return best.select("term", F.col("b.s").alias("sentence"), (-F.col("b.o")).alias("score"))


@BOOK.add("U09_kept_questions")
def u09(spark, d) -> DataFrame:
    """Items whose question stays when questions alike by three quarters of their words to an earlier one that stays are dropped.

    Copies (the same set of words) are one set with its smallest item; only sets are compared.
    """
    q = table(spark, d, "eval_items").filter("question IS NOT NULL").select("item_id", F.array_sort(T.search_words(F.col("question"))).alias("words")).filter(F.size("words") > 0)
    sets = materialize(q.groupBy("words").agg(F.min("item_id").alias("id")), "sets")
    return E.kept_first(sets, E.similar_sets(sets, 0.75)).select(F.col("id").alias("item_id"))


@BOOK.add("J12_entity_node_containment", f"""WITH {NODES}, n AS (SELECT DISTINCT array_to_string({WORDS.format('name')}, ' ') AS phrase FROM nodes WHERE length(name) >= 4), r AS (SELECT DISTINCT entity_id, {WORDS.format('canonical_name')} AS w FROM registry WHERE canonical_name IS NOT NULL),
x AS (SELECT entity_id, array_to_string(w, ' ') AS phrase, w FROM r), e AS (SELECT DISTINCT entity_id, phrase FROM x WHERE phrase IN (SELECT phrase FROM n) AND phrase <> ''),
g AS (SELECT DISTINCT entity_id, phrase FROM (SELECT entity_id, array_to_string(w[p:(p + k - 1)], ' ') AS phrase FROM (SELECT entity_id, w, p, unnest(range(1, len(w) - p + 2)) AS k FROM (SELECT entity_id, w, unnest(range(1, len(w) + 1)) AS p FROM x WHERE entity_id NOT IN (SELECT entity_id FROM e)))) WHERE phrase IN (SELECT phrase FROM n) AND phrase <> '')
SELECT entity_id, phrase, 'equal' AS how FROM e UNION ALL SELECT entity_id, phrase, 'contains' FROM g""")
def j12(spark, d) -> DataFrame:
    """Node names equal to a record's name; for records without one, the node names that stand in theirs as whole words."""
    n = _nodes(spark, d).filter(F.length("name") >= 4).select(F.array_join(T.words(F.col("name")), " ").alias("phrase")).filter("phrase <> ''").distinct()
    n = materialize(n, "nodenames")
    r = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", "canonical_name").distinct()
    equal = materialize(r.select("entity_id", F.array_join(T.words(F.col("canonical_name")), " ").alias("phrase")).join(n, "phrase", "left_semi").distinct(), "equal")
    rest = r.join(equal, "entity_id", "left_anti")
    inside = extract.gazetteer_mentions(rest, "entity_id", "canonical_name", n).select("entity_id", "phrase").distinct()
    return equal.select("entity_id", "phrase", F.lit("equal").alias("how")).unionByName(inside.withColumn("how", F.lit("contains")))


# ---- A, J, T: reports


@BOOK.add("J23_baseline_and_current", f"""WITH {RUNS}, m AS (SELECT strategy, run_index, count(*) AS runs, round(avg(coalesce(insufficient, false)::INT), 6) AS insufficient_rate, round(avg(sub_questions), 6) AS sub_questions FROM runs WHERE strategy IS NOT NULL AND run_index IS NOT NULL GROUP BY ALL),
l AS (SELECT strategy, run_index, 'runs' AS metric, runs::DOUBLE AS value FROM m UNION ALL SELECT strategy, run_index, 'insufficient_rate', insufficient_rate FROM m UNION ALL SELECT strategy, run_index, 'sub_questions', sub_questions FROM m)
SELECT a.strategy, a.metric, a.value AS baseline, b.value AS current, round(b.value - a.value, 6) AS change FROM l a JOIN l b ON a.strategy = b.strategy AND a.metric = b.metric WHERE a.run_index = '1' AND b.run_index = '2' AND a.value IS NOT NULL AND b.value IS NOT NULL""")
def j23(spark, d) -> DataFrame:
    m = _runs(spark, d).filter("strategy IS NOT NULL AND run_index IN ('1', '2')").groupBy("strategy", "run_index").agg(
        F.count(F.lit(1)).cast("double").alias("runs"), F.round(F.avg(F.coalesce("insufficient", F.lit(False)).cast("int")), 6).alias("insufficient_rate"), F.round(F.avg("sub_questions"), 6).alias("sub_questions"))
    long = materialize(m.unpivot(["strategy", "run_index"], ["runs", "insufficient_rate", "sub_questions"], "metric", "value").filter("value IS NOT NULL"), "metrics")
    a = long.filter("run_index = '1'").select("strategy", "metric", F.col("value").alias("baseline"))
    b = long.filter("run_index = '2'").select("strategy", "metric", F.col("value").alias("current"))
    return a.join(b, ["strategy", "metric"]).withColumn("change", F.round(F.col("current") - F.col("baseline"), 6))


@BOOK.add("A10_single_runs", f"""WITH {RUNS}, v AS (SELECT run_index, strategy, latency, row_number() OVER (PARTITION BY run_index, strategy ORDER BY latency) AS r, count(*) OVER (PARTITION BY run_index, strategy) AS n FROM runs WHERE latency IS NOT NULL)
SELECT run_index, strategy, max(n) AS n, round(avg(latency), 1) AS mean, max(CASE WHEN r = greatest(1, floor(0.95 * n)) THEN latency END) AS p95_index FROM v GROUP BY run_index, strategy""")
def a10(spark, d) -> DataFrame:
    v = materialize(_runs(spark, d).filter("latency IS NOT NULL").select("run_index", "strategy", "latency"), "runs")
    c = K.value_counts(v, ["run_index", "strategy"], "latency")
    k = F.greatest(F.lit(1), F.floor(0.95 * F.col("total")))
    at = c.filter((F.col("before") < k) & (k <= F.col("before") + F.col("n"))).select("run_index", "strategy", F.col("latency").alias("p95_index"))
    base = v.groupBy("run_index", "strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 1).alias("mean"))
    return K.same(base, at, ["run_index", "strategy"])


@BOOK.add("A22_structure", closure_sql(ARCS) + f""", {EDGES}, size AS (SELECT c, count(*) AS n FROM cc GROUP BY c)
SELECT (SELECT count(*) FROM cc) AS nodes, (SELECT count(*) FROM size) AS components, round((SELECT max(n) FROM size) / (SELECT count(*) FROM cc), 6) AS giant_share, (SELECT count(*) FROM size WHERE n = 2) AS pair_components,
 count(*) AS edges, count(*) FILTER (WHERE src = dst) AS self_loops, round(avg((type = 'RELATED_TO')::INT), 6) AS related_share, count(DISTINCT (least(src, dst), greatest(src, dst))) AS simple_edges FROM edges""")
def a22(spark, d) -> DataFrame:
    """One row: nodes, components, share of the largest, components of two, loops, share of RELATED_TO, edges without direction and type."""
    e = materialize(_edges(spark, d), "edges")
    size = G.components(e).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = size.agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"), F.round(F.max("n") / F.sum("n"), 6).alias("giant_share"), F.count_if(F.col("n") == 2).alias("pair_components"))
    t = e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.round(F.avg((F.col("type") == "RELATED_TO").cast("int")), 6).alias("related_share"))
    simple = e.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().agg(F.count(F.lit(1)).alias("simple_edges"))
    return c.join(F.broadcast(t)).join(F.broadcast(simple))


@BOOK.add("T10_separability", """WITH l AS (SELECT left_label AS label, min(similarity) FILTER (WHERE same_entity) AS lowest_same, max(similarity) FILTER (WHERE NOT same_entity) AS highest_other FROM match_pairs WHERE left_label IS NOT NULL GROUP BY 1)
SELECT label, lowest_same, highest_other, coalesce(lowest_same > highest_other, false) AS separable, round((lowest_same + highest_other) / 2, 9) AS threshold FROM l""")
def t10(spark, d) -> DataFrame:
    """By label the lowest similarity of one entity against the highest of two, and the threshold between them."""
    m = table(spark, d, "match_pairs").filter("left_label IS NOT NULL").groupBy(F.col("left_label").alias("label")).agg(
        F.min(F.when(F.col("same_entity"), F.col("similarity"))).alias("lowest_same"), F.max(F.when(~F.col("same_entity"), F.col("similarity"))).alias("highest_other"))
    return m.select("*", F.coalesce(F.col("lowest_same") > F.col("highest_other"), F.lit(False)).alias("separable"), F.round((F.col("lowest_same") + F.col("highest_other")) / 2, 9).alias("threshold"))


@BOOK.add("P03_property_names", "SELECT triple_id, array_to_string(list_sort(list_filter(map_keys(relationship_properties), lambda k: k NOT IN ('embedding', 'vector'))), ',') AS kept FROM triples WHERE relationship_properties IS NOT NULL")
def p03(spark, d) -> DataFrame:
    """Properties without those that hold a vector."""
    kept = F.map_filter("relationship_properties", lambda k, v: ~k.isin("embedding", "vector"))
    return table(spark, d, "triples").filter("relationship_properties IS NOT NULL").select("triple_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@BOOK.add("P23_salient_matches", f"""SELECT DISTINCT item_id, len(qw) AS terms, len(list_filter(qw, lambda x: list_contains(pw, x))) AS matched FROM (SELECT item_id, list_filter(list_distinct({WORDS.format('question')}), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS qw, {WORDS.format('passage')} AS pw FROM eval_items WHERE question IS NOT NULL AND passage IS NOT NULL)""")
def p23(spark, d) -> DataFrame:
    """Salient words of the question that stand in the passage as whole words."""
    e = table(spark, d, "eval_items").filter("question IS NOT NULL AND passage IS NOT NULL").select("item_id", T.search_words(F.col("question")).alias("q"), T.words(F.col("passage")).alias("p"))
    return e.select("item_id", F.size("q").cast("long").alias("terms"), F.size(F.array_intersect("q", "p")).cast("long").alias("matched")).distinct()


@BOOK.add("T03_contrasts")
def t03(spark, d) -> DataFrame:
    """Effect of each strategy against the default on insufficient answers, questions as fixed effects and as clusters."""
    r = _runs(spark, d).select("query_id", "strategy", F.col("insufficient").cast("int").alias("y"))
    got = M.contrasts(r, "query_id", "strategy", "y", "default")
    return got.select("arm", *[F.round(c, 9).alias(c) for c in ("effect", "lo", "hi", "p")])
