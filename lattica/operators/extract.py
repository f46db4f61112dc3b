"""Model-free defaults of mention and relation extraction, and the grouping of mentions into entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded
from lattica.functions import text as T

def phrases(df: DataFrame, key: str, text: str, heads: DataFrame) -> DataFrame:
    """(key, at, n, phrase): runs of words from each place where a name may begin, as long as the names that begin so.

    heads: (head, longest), the first words of the names and the words of their longest name. Places without
    such a word are dropped before any run is made.
    """
    w = df.select(key, T.words(F.col(text)).alias("w"))
    w = w.select(key, "w", F.posexplode_outer("w").alias("i", "head")).filter("head IS NOT NULL")
    w = w.join(bounded(heads), "head").select(key, (F.col("i") + 1).alias("at"), F.expr("slice(w, i + 1, longest)").alias("w"))
    w = w.select(key, "at", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    return w.select(key, "at", "n", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"))


def gazetteer_mentions(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, at, n, phrase): places at which a name of any length stands as whole words. names: (phrase), words
    with one blank between them."""
    names = names.select("phrase").filter("phrase <> ''").distinct()
    words = F.split("phrase", " ")
    heads = names.groupBy(F.get(words, F.lit(0)).alias("head")).agg(F.max(F.size(words)).alias("longest"))
    return phrases(texts, key, text, heads).join(names, "phrase", "left_semi")


def longest_mentions(mentions: DataFrame, key: str) -> DataFrame:
    """Of mentions at one place the longest."""
    w = Window.partitionBy(key, "at").orderBy(F.desc("n"))
    return mentions.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def neighbour_relations(mentions: DataFrame, key: str) -> DataFrame:
    """(subject, object, n): names that follow each other in a text; only neighbours, never all pairs of a text."""
    nxt = F.lead("phrase").over(Window.partitionBy(key).orderBy("at"))
    pairs = mentions.select(key, F.col("phrase").alias("subject"), nxt.alias("object")).filter("object IS NOT NULL AND object <> subject")
    return pairs.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"))


def initial_groups(triples: DataFrame) -> DataFrame:
    """(label, norm, predicate, n, names): mentions that are one entity from the start.

    A mention carries one predicate, so first-fit clustering by predicate overlap is a plain grouping.
    """
    lab = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("Concept"))
    m = triples.select(F.col("subject").alias("name"), lab("subject_labels").alias("label"), "predicate").unionByName(triples.select(F.col("object").alias("name"), lab("object_labels").alias("label"), "predicate"))
    m = m.filter("name IS NOT NULL AND predicate IS NOT NULL").withColumn("norm", T.alnum_key(F.col("name")))
    return m.groupBy("label", "norm", "predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))
