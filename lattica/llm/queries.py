"""Queries pN_... of the numbered problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.common import table
from lattica.llm import canonical, digest, groups, langid, leaks, mixing, pages, pairs, spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "chunks"), table(spark, d, "results"))


@query("p3_record_languages")
def p3_record_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(table(spark, d, "chunks"), table(spark, d, "results"))


@query("p3_segments")
def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.record_segments(table(spark, d, "chunks"), table(spark, d, "results"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "results"), table(spark, d, "chunks"))


@query("p1_tag_coverage")
def p1_tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the tags over each response; of rows of one result that differ, the one with the smallest shares, in order."""
    got = pairs.tag(table(spark, d, "results"), table(spark, d, "chunks"))
    one = got.groupBy("result_id").agg(F.min(F.struct(*[c for c in got.columns if c != "result_id"])).alias("r"))
    return one.select("result_id", "r.*")


P4_REACH = """
WITH RECURSIVE e AS (
  SELECT DISTINCT left_group AS u, right_group AS v FROM match_pairs
  WHERE same_entity AND left_group <> right_group
    AND left_group IN (SELECT entity_id FROM registry) AND right_group IN (SELECT entity_id FROM registry)),
a AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(s, t) AS (SELECT u, v FROM a UNION SELECT r.s, a.v FROM r JOIN a ON r.t = a.u)
"""


@query("p4_found", P4_REACH + "SELECT s AS entity_id, least(s, min(t)) AS group_id FROM r GROUP BY s")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.entity_groups(table(spark, d, "match_pairs"), table(spark, d, "registry"))


@query("p4_group_sizes", P4_REACH + ", g AS (SELECT s AS entity_id, least(s, min(t)) AS group_id FROM r GROUP BY s) SELECT group_id, count(*) AS n_records FROM g GROUP BY group_id")
def p4_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_records"))


P2_CLEAN = """
WITH one AS (SELECT result_id, min({s: strategy, d: started_at, l: latency_ms}) AS r FROM results GROUP BY result_id),
v AS (SELECT regexp_replace(lower(trim(r.s)), '[\\s-]+', '_', 'g') AS strategy, r.l AS v FROM one WHERE r.l IS NOT NULL AND NOT isnan(r.l) AND r.l >= 0 AND NOT isinf(r.l)),
n AS (SELECT strategy, count(*) AS n FROM v GROUP BY strategy),
q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q)
"""


@query("p2_percentiles")
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    got = digest.days_and_whole(table(spark, d, "results"))
    return got.select("strategy", "day", "q", "n", F.round("estimate", 6).alias("estimate"), "below", "upto", F.round("rank_error", 8).alias("rank_error"), F.greatest(F.lit(digest.RANK_ERROR), 1 / F.col("n")).alias("error_bound"), "certified")


@query("p2_certificates", P2_CLEAN + "SELECT strategy, q, n, true AS certified FROM n CROSS JOIN q")
def p2_certificates(spark: SparkSession, d: str) -> DataFrame:
    return digest.whole_period(table(spark, d, "results")).select("strategy", "q", "n", "certified")


@query("p5_found", canonical.found_sql())
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "triples"), table(spark, d, "relation_vocab"))


@query("p5_unmatched_values", f"SELECT predicate, count(*) AS n_triples FROM ({canonical.found_sql()}) f JOIN triples t USING (triple_id) WHERE canonical = 'UNMATCHED' GROUP BY predicate")
def p5_unmatched_values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples")
    none = p5_found(spark, d).filter("canonical = 'UNMATCHED'")
    return none.join(t.select("triple_id", "predicate"), "triple_id").groupBy("predicate").agg(F.count(F.lit(1)).alias("n_triples"))


P7_SQL = r"""
WITH f AS (SELECT item_id, unnest([question, canonical_answer, passage]) AS t FROM eval_items),
i AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM f WHERE t IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:(k + 24)], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 23)) AS k FROM i)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:(k + 24)], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS k FROM d))
SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (run)
"""


@query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p7_near")
def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of windows of 25 words within two word edits, and of whole shorter fields within edits in proportion."""
    return leaks.near(table(spark, d, "documents"), table(spark, d, "eval_items"))


P9_SQL = """
WITH w AS (SELECT doc_id, p, md5(substr(text, p + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM w WHERE h IN (SELECT h FROM s)),
g AS (SELECT doc_id, p, sum((b IS NULL OR p > b + 200)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m)
SELECT doc_id, min(p) AS span_start, max(p) + 200 AS span_end FROM g GROUP BY doc_id, k
"""


@query("p9_found", P9_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, "documents"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.found(table(spark, d, "page_chunks"))


@query("p6_paragraphs")
def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.paragraphs(table(spark, d, "page_chunks"))


@query("p6_document_paragraphs")
def p6_document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of whole documents: each block between blank lines of markdown_text is taken as a page."""
    docs = table(spark, d, "doc_records").groupBy("doc_id").agg(F.max("markdown_text").alias("t"))
    blocks = docs.select("doc_id", F.posexplode(F.split("t", r"\n\s*\n")).alias("k", "text"))
    return pages.paragraphs(blocks.select("doc_id", (F.col("k") + 1).alias("page_number"), "text"))


@query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@query("p8_temperature_report")
def p8_temperature_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.temperature_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), by="repeats"))


@query("p8_entropy_report")
def p8_entropy_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.temperature_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), by="entropy"))
