"""Queries of the normalisers, predicates and segmentation (families F, P, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import table
from lattica.functions import text as T
from lattica.operators import chunking
from lattica.plans.base import Book

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pat: str, to: str) -> str:
    return f"regexp_replace({x}, {_lit(pat)}, {_lit(to)}, 'g')"


def _collapse(x: str) -> str:
    return f"trim({_sub(x, chr(92) + 's+', ' ')})"


def _fold(x: str) -> str:
    return f"translate({x}, '{T.MARKED}', '{T.PLAIN}')"


WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
SCORING = _sub(_sub(_collapse("lower(x)"), "^[\"'«»“”‘’`\\-–— ]+", ""), "[\"'«»“”‘’`\\-–—.,;: ]+$", "")
QUESTION = _fold(_sub(_collapse("lower(x)"), "[?!.,;: ]+$", ""))

# (query, table, key, column, function, SQL over x): normalisers over whole columns
NORMALISERS: list[tuple[str, str, str, str, object, str]] = [
    ("F01_alnum_key", "registry", "entity_id", "canonical_name", T.alnum_key, _sub("lower(x)", "[^a-z0-9]+", "")),
    ("F02_triple_key", "triples", "triple_id", "object", T.triple_key, _collapse("lower(x)")),
    ("F03_name_key", "registry", "entity_id", "canonical_name", T.name_key, f"trim({_sub(_sub(_collapse('lower(x)'), '^(the|a|an) ', ''), '[^a-z0-9]+', ' ')})"),
    ("F04_relation_type", "triples", "triple_id", "predicate", T.relation_type, _sub(_sub(_sub("upper(trim(x))", "[^A-Z0-9_]+", "_"), "_+", "_"), "^_+|_+$", "")),
    ("F05_scoring_key", "match_pairs", "pair_id", "left_name", T.scoring_key, SCORING),
    ("F06_fold_accents", "questions", "query_id", "question", T.fold, _fold("x")),
    ("F07_match_key", "match_pairs", "pair_id", "right_name", T.match_key, _fold(SCORING)),
    ("F09_question_key", "results", "result_id", "question", T.question_key, QUESTION),
    ("F14_scan_key", "chunks", "chunk_id", "section_title", T.scan_key, f"trim({_sub('lower(' + _fold('x') + ')', '[^a-z0-9]+', ' ')})"),
    ("F38_slug", "chunks", "chunk_id", "filename", T.slug, _sub(_sub(_sub("lower(x)", "\\.[a-z0-9]{1,5}$", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")),
    ("P13_identifier", "registry", "entity_id", "canonical_name", T.identifier, "CASE WHEN regexp_matches({0}, '^[0-9]') THEN '_' || {0} ELSE {0} END".format(_sub(_sub(_sub("x", "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""))),
]


def _normaliser(name: str, tab: str, key: str, col: str, fn, sql: str) -> None:
    @BOOK.add(name, f"SELECT DISTINCT {key}, {sql} AS value FROM (SELECT {key}, {col} AS x FROM {tab})")
    def run(spark, d) -> DataFrame:
        return table(spark, d, tab).select(key, fn(F.col(col)).alias("value")).distinct()


for spec in NORMALISERS:
    _normaliser(*spec)


@BOOK.add("F20_word_stats", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def f20(spark, d) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


STOP_SQL = "[" + ", ".join(_lit(w) for w in T.STOPWORDS) + "]"


@BOOK.add("F21_search_terms", f"SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest({WORDS.format('question')}) AS t FROM questions) WHERE length(t) >= 3 AND NOT list_contains({STOP_SQL}, t)")
def f21(spark, d) -> DataFrame:
    return table(spark, d, "questions").select("query_id", F.explode(T.search_words(F.col("question"))).alias("term"))


@BOOK.add("F22_entity_candidates", r"""SELECT DISTINCT query_id, c AS candidate FROM (
  SELECT query_id, unnest(list_concat(regexp_extract_all(question, '\b[A-Z][\w-]*(?:\s+(?:(?:di|del|della|delle|dei|degli|dello|da|dal|dalla|e|ed|il|lo|la|le|gli|of|the|and|for|de|van|von|der)\s+)*[A-Z][\w-]*)+\b'),
    regexp_extract_all(question, '\b(?:(?:19|20)\d{2}|\d+(?:[.,]\d+)?\s*(?:%|kg|Mt|Gt|million|billion|tonnes))'))) AS c FROM questions)""")
def f22(spark, d) -> DataFrame:
    title = r"(\b[A-Z][\w-]*(?:\s+(?:(?:di|del|della|delle|dei|degli|dello|da|dal|dalla|e|ed|il|lo|la|le|gli|of|the|and|for|de|van|von|der)\s+)*[A-Z][\w-]*)+\b)"
    number = r"(\b(?:(?:19|20)\d{2}|\d+(?:[.,]\d+)?\s*(?:%|kg|Mt|Gt|million|billion|tonnes)))"
    q = F.col("question")
    found = F.array_union(F.regexp_extract_all(q, F.lit(title), 1), F.regexp_extract_all(q, F.lit(number), 1))
    return table(spark, d, "questions").select("query_id", F.explode(found).alias("candidate"))


IT = "il lo la gli di del della che per con una sono come quali perché è non nel"
EN = "the of and to in is are what which how does for with why a that who from"


@BOOK.add("F29_language_it_en", f"""SELECT query_id, CASE WHEN i > e THEN 'it' WHEN e > i THEN 'en' WHEN regexp_matches(question, '[àèéìòù]') THEN 'it' ELSE 'en' END AS lang FROM (
  SELECT query_id, question, len(list_filter({WORDS.format('question')}, lambda w: list_contains(string_split('{IT}', ' '), w))) AS i, len(list_filter({WORDS.format('question')}, lambda w: list_contains(string_split('{EN}', ' '), w))) AS e FROM questions)""")
def f29(spark, d) -> DataFrame:
    return table(spark, d, "questions").select("query_id", T.language_it_en(F.col("question")).alias("lang"))


@BOOK.add("F36_coerced_properties", """SELECT triple_id, greatest(1, coalesce(TRY_CAST(relationship_properties['mention_count'] AS INT), 1)) AS mentions,
  round(greatest(0.0, least(1.0, coalesce(TRY_CAST(relationship_properties['confidence'] AS DOUBLE), 0.0))), 6) AS confidence FROM triples""")
def f36(spark, d) -> DataFrame:
    p = F.col("relationship_properties")
    return table(spark, d, "triples").select("triple_id", T.mention_count(p["mention_count"]).alias("mentions"), F.round(T.confidence(p["confidence"]), 6).alias("confidence"))


@BOOK.add("F37_judge_scores", "SELECT pair_id, round(least(1.0, greatest(0.0, CASE WHEN s > 1 THEN (s - 1) / 4 ELSE s END)), 6) AS score FROM (SELECT pair_id, similarity * 5 AS s FROM match_pairs WHERE similarity IS NOT NULL)")
def f37(spark, d) -> DataFrame:
    return table(spark, d, "match_pairs").filter("similarity IS NOT NULL").select("pair_id", F.round(T.judge_score(F.col("similarity") * 5), 6).alias("score"))


@BOOK.add("F19_page_numbers", """SELECT DISTINCT triple_id, p AS page FROM (SELECT triple_id, a, b, unnest(CASE WHEN b < a OR b - a > 200 THEN [a] ELSE range(a, b + 1) END) AS p FROM (
  SELECT triple_id, CAST(regexp_extract(relationship_properties['page_range'], '^(\\d+)', 1) AS BIGINT) AS a, CAST(regexp_extract(relationship_properties['page_range'], '(\\d+)$', 1) AS BIGINT) AS b
  FROM triples WHERE regexp_matches(relationship_properties['page_range'], '^\\d+(-\\d+)?$')))""".replace("\\\\", "\\"))
def f19(spark, d) -> DataFrame:
    r = F.col("relationship_properties")["page_range"]
    return table(spark, d, "triples").filter(r.rlike(r"^\d+(-\d+)?$")).select("triple_id", F.explode(T.page_spec(r)).alias("page")).select("triple_id", F.col("page").cast("long").alias("page"))


@BOOK.add("F39_corpus_fingerprint", "SELECT source, left(sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 8))::UBIGINT)::BIGINT || ':' || bit_xor(('0x' || substr(h, 9, 15))::UBIGINT)::BIGINT), 16) AS fingerprint FROM (SELECT coalesce(source, '') AS source, sha256(doc_id || ':' || text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY source")
def f39(spark, d) -> DataFrame:
    """Count, sum and exclusive or of the hashes of the documents: the same in any order, and added up before the shuffle."""
    h = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), 256)
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), h.alias("h"))
    part = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    got = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1, 8)).alias("s"), F.bit_xor(part(9, 15)).alias("x"))
    return got.select("source", F.left(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s", "x")]), 256), F.lit(16)).alias("fingerprint"))


@BOOK.add("F40_rendered_triples", """SELECT triple_id, '(' || subject || ', ' || predicate || ', ' || object || ') [source=' || relationship_properties['source_doc'] || ', pages=' || relationship_properties['page_range'] || ', mentions=' ||
  greatest(1, coalesce(TRY_CAST(relationship_properties['mention_count'] AS INT), 1)) || ']' AS line FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND relationship_properties['source_doc'] IS NOT NULL AND relationship_properties['page_range'] IS NOT NULL""")
def f40(spark, d) -> DataFrame:
    p = F.col("relationship_properties")
    t = table(spark, d, "triples").filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull() & p["source_doc"].isNotNull() & p["page_range"].isNotNull())
    return t.select("triple_id", T.rendered_triple(F.col("subject"), F.col("predicate"), F.col("object"), p["source_doc"], p["page_range"], T.mention_count(p["mention_count"])).alias("line"))


@BOOK.add("F13_squad_word_counts", """SELECT DISTINCT result_id, len(list_filter(string_split(regexp_replace(regexp_replace(translate(lower(answer), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g'), '^ +| +$', '', 'g'), ' '), lambda w: w <> '' AND NOT list_contains(string_split('a an the il lo la i gli le un uno una', ' '), w))) AS n
  FROM results WHERE answer IS NOT NULL""".replace("\\\\", "\\"))
def f13(spark, d) -> DataFrame:
    r = table(spark, d, "results").filter("answer IS NOT NULL")
    return r.select("result_id", F.size(T.squad_words(F.col("answer"))).cast("long").alias("n")).distinct()


MARK_SQL = ", ".join(f"nullif(instr(a, {_lit(m)}), 0)" for m in T.INSUFFICIENT)


@BOOK.add("P24_insufficient_answers", f"""SELECT DISTINCT result_id, CASE WHEN answer IS NULL OR NOT regexp_matches(answer, '\\S') THEN true ELSE pos < 1073741824 AND (length(a) <= 400 OR pos - 1 <= floor(length(a) * 0.30)) END AS insufficient FROM (
  SELECT result_id, answer, lower(answer) AS a, coalesce(least({MARK_SQL.replace('instr(a,', 'instr(lower(answer),')}), 1073741824) AS pos FROM results)""")
def p24(spark, d) -> DataFrame:
    return table(spark, d, "results").select("result_id", T.insufficient(F.col("answer")).alias("insufficient")).distinct()


@BOOK.add("P07_front_matter_chunks", f"SELECT DISTINCT chunk_id, regexp_matches(coalesce(section_title, ''), {_lit('(?i)' + T.FRONT_MATTER)}) AS skipped FROM chunks")
def p07(spark, d) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.is_front_matter(F.col("section_title")).alias("skipped")).distinct()


@BOOK.add("P15_skip_reasons", """SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN r.query_id IS NULL OR q.query_id IS NULL THEN 'question_not_found' WHEN r.answer IS NULL OR NOT regexp_matches(r.answer, '\\S') THEN 'empty_context' ELSE '' END AS skip_reason
  FROM (SELECT DISTINCT result_id, query_id, answer FROM results) r LEFT JOIN questions q ON r.query_id = q.query_id) GROUP BY skip_reason""")
def p15(spark, d) -> DataFrame:
    r = table(spark, d, "results").select("result_id", "query_id", "answer").distinct()
    j = r.join(table(spark, d, "questions").select("query_id", F.lit(True).alias("known")), "query_id", "left")
    reason = F.when(F.col("known").isNull(), "question_not_found").when(F.col("answer").isNull() | ~F.col("answer").rlike(r"\S"), "empty_context").otherwise("")
    return j.groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("P17_long_names", "SELECT DISTINCT entity_id, len(string_split(canonical_name, ' ')) > 6 AS is_long, regexp_matches(canonical_name, '\\(\\d{4}\\)|et al') AS is_citation FROM registry".replace("\\\\", "\\"))
def p17(spark, d) -> DataFrame:
    n = F.col("canonical_name")
    return table(spark, d, "registry").select("entity_id", (F.size(F.split(n, " ")) > 6).alias("is_long"), n.rlike(r"\(\d{4}\)|et al").alias("is_citation")).distinct()


@BOOK.add("P18_region_artifacts", "SELECT DISTINCT entity_id, canonical_name FROM registry WHERE contains(canonical_name, '/') OR contains(canonical_name, '*') OR (canonical_name = upper(canonical_name) AND len(string_split(canonical_name, ' ')) > 3)")
def p18(spark, d) -> DataFrame:
    n = F.col("canonical_name")
    return table(spark, d, "registry").filter(n.contains("/") | n.contains("*") | ((n == F.upper(n)) & (F.size(F.split(n, " ")) > 3))).select("entity_id", "canonical_name").distinct()


@BOOK.add("P19_all_caps_names", "SELECT DISTINCT entity_id, canonical_name FROM registry WHERE upper(canonical_name) = canonical_name AND lower(canonical_name) <> canonical_name")
def p19(spark, d) -> DataFrame:
    return table(spark, d, "registry").filter(T.all_caps(F.col("canonical_name"))).select("entity_id", "canonical_name").distinct()


@BOOK.add("P04_label_whitelist", "SELECT triple_id FROM triples WHERE list_has_any(subject_labels, ['Material', 'Product']) OR list_has_any(object_labels, ['Material', 'Product'])")
def p04(spark, d) -> DataFrame:
    keep = F.array(F.lit("Material"), F.lit("Product"))
    return table(spark, d, "triples").filter(F.arrays_overlap("subject_labels", keep) | F.arrays_overlap("object_labels", keep)).select("triple_id")


@BOOK.add("P06_predicate_blacklist", "SELECT triple_id, predicate FROM triples WHERE upper(trim(predicate)) NOT IN ('RELATED_TO', 'CITES_DOCUMENT', 'LOCATED_IN')")
def p06(spark, d) -> DataFrame:
    return table(spark, d, "triples").filter(~F.upper(F.trim("predicate")).isin("RELATED_TO", "CITES_DOCUMENT", "LOCATED_IN")).select("triple_id", "predicate")


@BOOK.add("P08_enforced_labels", "SELECT triple_id, CASE WHEN len(l) = 0 THEN 'Concept' ELSE array_to_string(l, '|') END AS labels FROM (SELECT triple_id, list_filter(coalesce(subject_labels, []), lambda x: list_contains(['Material', 'Organization', 'Place', 'Process', 'Product', 'Project'], x)) AS l FROM triples)")
def p08(spark, d) -> DataFrame:
    allowed = ["Material", "Organization", "Place", "Process", "Product", "Project"]
    keep = F.filter(F.coalesce("subject_labels", F.array().cast("array<string>")), lambda x: x.isin(*allowed))
    return table(spark, d, "triples").select("triple_id", F.when(F.size(keep) == 0, "Concept").otherwise(F.array_join(keep, "|")).alias("labels"))


REL = _sub(_sub(_sub("upper(trim(predicate))", "[^A-Z0-9_]+", "_"), "_+", "_"), "^_+|_+$", "")


@BOOK.add("P09_off_vocabulary_remap", f"SELECT triple_id, CASE WHEN {REL} IN (SELECT predicate FROM relation_vocab) THEN {REL} ELSE 'RELATED_TO' END AS predicate FROM triples WHERE predicate IS NOT NULL")
def p09(spark, d) -> DataFrame:
    t = table(spark, d, "triples").filter("predicate IS NOT NULL").select("triple_id", T.relation_type(F.col("predicate")).alias("p"))
    v = table(spark, d, "relation_vocab").select(F.col("predicate").alias("p"), F.lit(True).alias("known"))
    return t.join(v, "p", "left").select("triple_id", F.when(F.col("known"), F.col("p")).otherwise("RELATED_TO").alias("predicate"))


@BOOK.add("P10_triple_validation", f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(subject, '')) = '' OR trim(coalesce(object, '')) = '' THEN 'empty name' WHEN predicate IS NULL THEN 'no predicate'
  WHEN NOT regexp_matches(upper(predicate), '^[A-Z][A-Z0-9_]*$') THEN 'bad predicate' ELSE '' END AS error FROM triples) GROUP BY error""")
def p10(spark, d) -> DataFrame:
    blank = (F.trim(F.coalesce("subject", F.lit(""))) == "") | (F.trim(F.coalesce("object", F.lit(""))) == "")
    err = F.when(blank, "empty name").when(F.col("predicate").isNull(), "no predicate").when(~F.upper("predicate").rlike("^[A-Z][A-Z0-9_]*$"), "bad predicate").otherwise("")
    return table(spark, d, "triples").groupBy(err.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("P12_clean_properties", "SELECT DISTINCT entity_id, e.key AS property, e.value AS value FROM (SELECT entity_id, unnest(map_entries(merged_properties)) AS e FROM registry) WHERE trim(coalesce(e.value, '')) <> ''")
def p12(spark, d) -> DataFrame:
    clean = F.map_filter("merged_properties", lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    return table(spark, d, "registry").select("entity_id", F.explode(clean).alias("property", "value")).distinct()


@BOOK.add("P21_system_links", "SELECT triple_id, coalesce(relationship_properties['extraction_method'] = 'system_linking', false) OR coalesce(upper(predicate) IN ('MENTIONED_IN', 'SAME_AS'), false) AS is_system FROM triples")
def p21(spark, d) -> DataFrame:
    link = F.coalesce(F.col("relationship_properties")["extraction_method"] == "system_linking", F.lit(False)) | F.coalesce(F.upper("predicate").isin("MENTIONED_IN", "SAME_AS"), F.lit(False))
    return table(spark, d, "triples").select("triple_id", link.alias("is_system"))


# ---- C: segmentation


@BOOK.add("C01_paragraphs", r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_no, p AS paragraph FROM (
  SELECT doc_id, generate_subscripts(a, 1) AS i, regexp_replace(unnest(a), '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(13), ''), '\n\s*\n') AS a FROM documents)) WHERE p <> ''""")
def c01(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    p = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(p).alias("k", "paragraph")).select("doc_id", (F.col("k") + 1).cast("long").alias("paragraph_no"), "paragraph")


@BOOK.add("C02_token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n_tokens FROM documents")
def c02(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


PAGES = "(SELECT doc_id, page_number, min(text) AS text FROM page_chunks GROUP BY doc_id, page_number)"
SECTIONS = rf"""h AS (SELECT doc_id, page_number, trim(regexp_extract(text, '(?m)^(#{{1,6}})\s+(.+?)\s*$', 2)) AS title, length(regexp_extract(text, '(?m)^(#{{1,6}})\s+(.+?)\s*$', 1)) AS level FROM {PAGES}),
k AS (SELECT *, lag(lower(title)) OVER (PARTITION BY doc_id ORDER BY page_number) AS prev FROM h WHERE title <> ''),
s AS (SELECT *, lead(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS nxt FROM k WHERE prev IS NULL OR prev <> lower(title)),
l AS (SELECT doc_id, max(page_number) AS last_page FROM page_chunks GROUP BY doc_id),
sections AS (SELECT s.doc_id, title, level, page_number AS start_page, greatest(page_number, coalesce(nxt, last_page)) AS end_page FROM s JOIN l ON s.doc_id = l.doc_id
  UNION ALL SELECT doc_id, 'Full Document', 1, 1, last_page FROM l WHERE doc_id NOT IN (SELECT doc_id FROM s))"""


def _pages(spark, d) -> DataFrame:
    return table(spark, d, "page_chunks").groupBy("doc_id", "page_number").agg(F.min("text").alias("text"))


@BOOK.add("C03_sections", f"WITH {SECTIONS} SELECT doc_id, title, level, start_page, end_page FROM sections")
def c03(spark, d) -> DataFrame:
    return chunking.sections(_pages(spark, d)).select("doc_id", "title", F.col("level").cast("long").alias("level"), "start_page", "end_page")


@BOOK.add("C04_titles_years", rf"""WITH p AS (SELECT doc_id, min(CASE WHEN page_number <= 3 AND regexp_matches(text, '(?m)^#\s+\S') THEN page_number END) AS pg FROM {PAGES} GROUP BY doc_id)
SELECT d.doc_id, coalesce(regexp_extract(t.text, '(?m)^#\s+(.+?)\s*$', 1), trim(string_split(d.markdown_text, chr(10))[1])) AS title, nullif(regexp_extract(d.markdown_text, '\b((?:19|20)\d{{2}})\b', 1), '') AS year
FROM (SELECT doc_id, max(markdown_text) AS markdown_text FROM doc_records GROUP BY doc_id) d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN {PAGES} t ON t.doc_id = p.doc_id AND t.page_number = p.pg""")
def c04(spark, d) -> DataFrame:
    pages = _pages(spark, d)
    h1 = pages.filter((F.col("page_number") <= 3) & F.col("text").rlike(r"(?m)^#\s+\S")).groupBy("doc_id").agg(F.min_by("text", "page_number").alias("t"))
    docs = table(spark, d, "doc_records").groupBy("doc_id").agg(F.max("markdown_text").alias("m"))
    first = F.trim(F.split("m", "\n")[0])
    year = F.nullif(F.regexp_extract("m", r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    return docs.join(h1, "doc_id", "left").select("doc_id", F.coalesce(F.regexp_extract("t", r"(?m)^#\s+(.+?)\s*$", 1), first).alias("title"), year.alias("year"))


@BOOK.add("C05_pages_in_sections", f"WITH {SECTIONS} SELECT p.doc_id, p.page_number, s.title, s.start_page FROM {PAGES} p JOIN sections s ON p.doc_id = s.doc_id AND p.page_number BETWEEN s.start_page AND s.end_page")
def c05(spark, d) -> DataFrame:
    pages = _pages(spark, d)
    return pages.join(chunking.sections(pages), "doc_id").filter("page_number BETWEEN start_page AND end_page").select("doc_id", "page_number", "title", "start_page")


@BOOK.add("C06_budget_windows")
def c06(spark, d) -> DataFrame:
    p = chunking.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    return chunking.budget_windows(p, ["doc_id"], "paragraph_no", 256, 64)


@BOOK.add("C07_routed_chunks")
def c07(spark, d) -> DataFrame:
    return chunking.routed_chunks(table(spark, d, "doc_records"), _pages(spark, d))


@BOOK.add("C08_chunk_ids", "SELECT doc_id, chunk_index, doc_id || '_chunk_' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id, min(page_start) || '-' || max(page_end) AS page_range FROM chunks GROUP BY doc_id, chunk_index")
def c08(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").groupBy("doc_id", "chunk_index").agg(F.min("page_start").alias("a"), F.max("page_end").alias("b"))
    return c.select("doc_id", "chunk_index", F.format_string("%s_chunk_%05d", "doc_id", "chunk_index").alias("chunk_id"), F.concat_ws("-", "a", "b").alias("page_range"))


@BOOK.add("C09_char_windows", """SELECT doc_id, k AS window_no, start, trim(substr(text, (start + 1)::BIGINT, 1200)) AS content FROM (
  SELECT doc_id, text, generate_subscripts(s, 1) AS k, unnest(s) AS start FROM (SELECT doc_id, text, CASE WHEN length(text) <= 1200 THEN [0::BIGINT] ELSE range(0, greatest(length(text) - 180, 1), 1020) END AS s FROM documents WHERE length(trim(text)) > 0))
  WHERE length(trim(substr(text, (start + 1)::BIGINT, 1200))) >= 80 OR length(text) <= 1200""")
def c09(spark, d) -> DataFrame:
    w = chunking.char_windows(table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.col("start").cast("long").alias("start"), "content")


@BOOK.add("C10_page_windows", f"""SELECT doc_id || '#page=' || page_number || '#chunk=' || k AS source, trim(substr(text, (start + 1)::BIGINT, 800)) AS content FROM (
  SELECT doc_id, page_number, text, generate_subscripts(s, 1) AS k, unnest(s) AS start FROM (SELECT doc_id, page_number, text, CASE WHEN length(text) <= 800 THEN [0::BIGINT] ELSE range(0, greatest(length(text) - 140, 1), 660) END AS s FROM {PAGES} WHERE length(trim(text)) > 0))
  WHERE length(trim(substr(text, (start + 1)::BIGINT, 800))) >= 80 OR length(text) <= 800""")
def c10(spark, d) -> DataFrame:
    p = _pages(spark, d).withColumn("key", F.concat_ws("#page=", "doc_id", "page_number"))
    w = chunking.char_windows(p, "key", "text", 800, 140)
    return w.select(F.concat_ws("#chunk=", "key", "window_no").alias("source"), "content")


@BOOK.add("C11_sentences")
def c11(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentence_split(F.col("text"))).alias("k", "sentence"))
    return s.select("doc_id", (F.col("k") + 1).alias("sentence_no"), "sentence")


@BOOK.add("C12_stratified_sample", """SELECT doc_id, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5(chunk_id || '42'), chunk_id) AS r FROM (SELECT DISTINCT doc_id, chunk_id, chunk_index FROM chunks) WHERE chunk_index > 1) WHERE r <= 3""")
def c12(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").select("doc_id", "chunk_id", "chunk_index").distinct().filter("chunk_index > 1")
    w = Window.partitionBy("doc_id").orderBy(F.md5(F.concat("chunk_id", F.lit("42"))), "chunk_id")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("doc_id", "chunk_id")


@BOOK.add("C13_compressed_texts", "SELECT doc_id, CASE WHEN length(text) * 0.25 > 200 THEN left(text, 400) || ' [...] ' || right(text, 400) ELSE text END AS text FROM documents")
def c13(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.compressed(F.col("text"), 200).alias("text"))


@BOOK.add("C14_evidence_budget", """SELECT doc_id, chunk_id, CASE WHEN before + n <= 2000 THEN n ELSE 2000 - before END AS kept FROM (
  SELECT doc_id, chunk_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT DISTINCT doc_id, chunk_id, chunk_index, text FROM chunks)) WHERE before + n <= 2000 OR 2000 - before >= 80""")
def c14(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").select("doc_id", "chunk_id", "chunk_index", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("h")).distinct()
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return c.filter("before + n <= 2000 OR 2000 - before >= 80").select("doc_id", "chunk_id", F.when(F.col("before") + F.col("n") <= 2000, F.col("n")).otherwise(2000 - F.col("before")).alias("kept"))


