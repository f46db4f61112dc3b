"""Queries of artefacts that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.common import materialize, table
from lattica.functions import text as T
from lattica.plans.base import Book
from lattica.sources import io

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql


@BOOK.add("S06_K01_stage_artifacts", """SELECT 'chunks' AS stage, count(*) AS rows, count(*) AS read_rows, 0::BIGINT AS different FROM chunks UNION ALL SELECT 'triples', count(*), count(*), 0 FROM triples UNION ALL SELECT 'documents', count(*), count(*), 0 FROM doc_records""")
def s06(spark, d) -> DataFrame:
    """Stage artefacts written as JSON and read back under their schema; rows that differ are counted as multisets."""
    out = None
    for stage, name in (("chunks", "chunks"), ("triples", "triples"), ("documents", "doc_records")):
        t = table(spark, d, name)
        path = io.scratch(spark, "stage")
        t.write.option("ignoreNullFields", "false").json(path)
        text = lambda df: df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        got = io.same_rows(text(t), text(spark.read.schema(t.schema).json(path)))
        one = got.select(F.lit(stage).alias("stage"), F.col("left_rows").alias("rows"), F.col("right_rows").alias("read_rows"), "different")
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.add("S09_S10_run_directories", "SELECT run, count(*) AS rows, min(result_id) AS first_result FROM (SELECT DISTINCT result_id, 'run_' || (metadata['run_index']) AS run FROM results WHERE metadata['run_index'] IS NOT NULL) GROUP BY run")
def s09(spark, d) -> DataFrame:
    """Runs written to a folder each; the folders are discovered by their path, and each is summed up."""
    path = io.scratch(spark, "runs")
    r = table(spark, d, "results").select("result_id", F.concat(F.lit("run_"), F.col("metadata")["run_index"]).alias("run")).filter("run IS NOT NULL").distinct()
    r.withColumn("folder", F.col("run")).write.partitionBy("folder").json(path)
    seen = spark.read.schema("result_id long").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"folder=([^/]+)/[^/]+$", 1)
    return seen.select("result_id", run.alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.min("result_id").alias("first_result"))


GOLD = "struct<item_id: bigint, question: string, canonical_answer: string, question_type: string>"
PER_FILE = 1000


@BOOK.add("S12_gold_json", """WITH r AS (SELECT item_id, question, question_type FROM eval_items), n AS (SELECT item_id, count(*) AS copies FROM r GROUP BY item_id) SELECT DISTINCT item_id, question, coalesce(question_type, 'none') AS question_type, copies > 1 AS repeated FROM r JOIN n USING (item_id)""")
def s12(spark, d) -> DataFrame:
    """Gold files, a JSON object with a list `queries` in each, read back; repeated ids are marked, unreadable files dropped."""
    e = table(spark, d, "eval_items").select("item_id", "question", "canonical_answer", "question_type")
    files = max(1, -(-e.count() // PER_FILE))
    lists = e.withColumn("file", F.pmod(F.xxhash64("item_id"), F.lit(files))).groupBy("file").agg(F.collect_list(F.struct("item_id", "question", "canonical_answer", "question_type")).alias("queries"))
    path = io.scratch(spark, "gold")
    lists.select(F.to_json(F.struct("queries")).alias("value")).unionByName(spark.createDataFrame([('{"queries": [{"item_id"',)], "value string")).write.text(path)
    read = spark.read.text(path).select(F.from_json("value", f"queries array<{GOLD}>").alias("r")).select(F.explode("r.queries").alias("q")).select("q.*").filter("item_id IS NOT NULL")
    read = materialize(read, "gold")
    n = read.groupBy("item_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return read.join(n, "item_id").select("item_id", "question", F.coalesce("question_type", F.lit("none")).alias("question_type"), "repeated").distinct()


@BOOK.add("S13_question_file", r"""SELECT query_id, question FROM (SELECT query_id, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question, row_number() OVER (PARTITION BY query_id ORDER BY trim(regexp_replace(question, '\s+', ' ', 'g'))) AS r FROM results WHERE query_id IS NOT NULL AND question IS NOT NULL AND trim(regexp_replace(question, '\s+', ' ', 'g')) <> '') WHERE r = 1""")
def s13(spark, d) -> DataFrame:
    """Question files of lines `id<TAB>text`: blanks collapsed, of a repeated id the first text in order."""
    q = table(spark, d, "results").filter("query_id IS NOT NULL AND question IS NOT NULL").select("query_id", F.trim(F.regexp_replace("question", r"\s+", " ")).alias("question")).filter("question <> ''").distinct()
    path = io.scratch(spark, "questions")
    q.select(F.concat_ws("\t", "query_id", "question").alias("value")).write.text(path)
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter("value <> ''").select(parts[0].alias("query_id"), parts[1].alias("question")).groupBy("query_id").agg(F.min("question").alias("question"))


@BOOK.add("S22_whitelisted_documents", r"SELECT DISTINCT doc_id FROM doc_records WHERE lower(regexp_extract(filename, '([^/\\]+)$', 1)) IN (SELECT lower(regexp_extract(relationship_properties['source_doc'], '([^/\\]+)$', 1)) FROM triples WHERE relationship_properties['source_doc'] IS NOT NULL)")
def s22(spark, d) -> DataFrame:
    """Documents on a whitelist file of names, with comments and blank lines between them."""
    path = io.scratch(spark, "whitelist")
    names = table(spark, d, "triples").select(F.col("relationship_properties")["source_doc"].alias("value")).filter("value IS NOT NULL").distinct()
    names.unionByName(spark.createDataFrame([("# names of documents",), ("",)], "value string")).write.text(path)
    listed = io.read_lines(spark, path).distinct()
    docs = table(spark, d, "doc_records").select("doc_id", F.lower(F.regexp_extract("filename", r"([^/\\]+)$", 1)).alias("name"))
    return docs.join(listed, "name", "left_semi").select("doc_id").distinct()


@BOOK.add("S23_reviewed_triples", """WITH r AS (SELECT triple_id, predicate, CASE WHEN relationship_properties['confidence'] IS NULL THEN '' WHEN TRY_CAST(relationship_properties['confidence'] AS DOUBLE) >= 0.8 THEN 'Yes' WHEN TRY_CAST(relationship_properties['confidence'] AS DOUBLE) >= 0.6 THEN '1' ELSE 'no' END AS keep FROM triples)
SELECT coalesce(predicate, '') AS predicate, count(*) FILTER (WHERE lower(trim(keep)) IN ('1', 'true', 'yes', 'y', 'x', 'keep')) AS kept, count(*) AS reviewed FROM r GROUP BY 1""")
def s23(spark, d) -> DataFrame:
    """A review sheet of all triples as CSV; kept are those whose mark is one of the truthy ones."""
    c = F.col("relationship_properties")["confidence"].try_cast("double")
    keep = F.when(F.col("relationship_properties")["confidence"].isNull(), "").when(c >= 0.8, "Yes").when(c >= 0.6, "1").otherwise("no")
    path = io.scratch(spark, "review")
    io.write_csv(table(spark, d, "triples").select("triple_id", "predicate", keep.alias("keep")), path)
    schema = StructType([StructField("triple_id", StringType()), StructField("predicate", StringType()), StructField("keep", StringType())])
    r = io.read_csv(spark, path, schema)
    hit = F.lower(F.trim("keep")).isin("1", "true", "yes", "y", "x", "keep")
    return r.groupBy(F.coalesce("predicate", F.lit("")).alias("predicate")).agg(F.count_if(hit).alias("kept"), F.count(F.lit(1)).alias("reviewed"))


@BOOK.add("K06_S26_dataset_csv", "SELECT DISTINCT result_id, metadata['model_id'] AS model_id, metadata['run_index']::INT AS run_index, length(question) AS question_chars FROM results WHERE question IS NOT NULL AND question <> ''")
def k06(spark, d) -> DataFrame:
    """The evaluation rows as CSV, nested columns as JSON in it, and back."""
    path = io.scratch(spark, "dataset")
    io.write_csv(table(spark, d, "results").filter("question IS NOT NULL AND question <> ''").select("result_id", "question", "metadata"), path)
    schema = StructType([StructField("result_id", StringType()), StructField("question", StringType()), StructField("metadata_json", StringType())])
    r = io.read_csv(spark, path, schema).withColumn("m", F.from_json("metadata_json", "map<string,string>"))
    return r.select(F.col("result_id").cast("long").alias("result_id"), F.col("m")["model_id"].alias("model_id"), F.col("m")["run_index"].cast("int").alias("run_index"), F.length("question").cast("long").alias("question_chars")).distinct()


@BOOK.add("K03_alias_edges", """WITH a AS (SELECT trim(regexp_replace(lower(alias), '\\s+', ' ', 'g')) AS src, trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS dst, entity_id FROM (SELECT entity_id, canonical_name, unnest(aliases) AS alias FROM registry WHERE canonical_name IS NOT NULL) WHERE alias IS NOT NULL)
SELECT src, 'ALIAS_OF' AS type, dst, count(*) AS n, min(entity_id) AS first_entity FROM a WHERE src <> '' AND src <> dst GROUP BY src, dst""".replace("\\\\", "\\"))
def k03(spark, d) -> DataFrame:
    """Generic import: pairs of names under one constant type, merged by both ends."""
    a = table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", "canonical_name", F.explode("aliases").alias("alias")).filter("alias IS NOT NULL")
    a = a.select("entity_id", T.triple_key(F.col("alias")).alias("src"), T.triple_key(F.col("canonical_name")).alias("dst")).filter("src <> '' AND src <> dst")
    return a.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_entity")).select("src", F.lit("ALIAS_OF").alias("type"), "dst", "n", "first_entity")
