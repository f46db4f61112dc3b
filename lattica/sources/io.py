"""Readers and writers of the artefacts: JSON lines, CSV, text, whole files, snapshots, rejects.

Schemas are explicit; malformed lines are kept apart with a count instead of failing or vanishing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.common import shared_dir

CORRUPT = "_corrupt"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"lattica-{label}-{uuid.uuid4().hex}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that could not be read; blank lines are skipped."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = rows.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.filter(~bad).select("r.*").drop(CORRUPT), parsed.filter(bad).select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text in columns with the suffix _json."""
    flat = [F.to_json(c).alias(f"{c}_json") if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', quote='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md,markdown,rst,log,csv}") -> DataFrame:
    """(path, text): whole text files under a folder, with collapsed blanks."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content): files for a parser plug-in, which turns them into pages with mapInPandas."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name): lower-case base names of the lines of a whitelist, without comments and blank lines."""
    v = F.lower(F.trim("value"))
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.regexp_extract(v, r"([^/\\]+)$", 1).alias("name"))


def split_valid(df: DataFrame, error) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the rejected rows with theirs. error: a Column that is empty for good rows."""
    marked = df.withColumn("error", error)
    return marked.filter("error = ''").drop("error"), marked.filter("error <> ''")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, the newest by `order` for each key; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    value = [c for c in old.columns if c not in keys]
    best = F.max_by(F.struct(*value), F.struct(order, "__new")).alias("__v")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in value])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each, and how many stand in one of them only, as multisets."""
    cols = a.columns
    ha = a.select(F.xxhash64(*cols).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hb = b.select(*cols).select(F.xxhash64(*cols).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    j = ha.join(hb, "h", "full").fillna(0, ["n", "m"])
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("right_rows"), F.coalesce(F.sum(F.abs(F.col("n") - F.col("m"))), F.lit(0)).alias("different"))
