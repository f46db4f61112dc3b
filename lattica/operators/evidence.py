"""Evidence of answers: quotes, references, definitions, expected entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded, materialize
from lattica.functions import text as T

LEAD = 4
QUOTE = r"[\"“«]([^\"“”«»\n]{25,400})[\"”»]"
# Openers of questions that ask for a definition or for a list, and words that point back.
DEFINITION = r"(?i)^\s*(?:what (?:is|are)|define|che cos'è|cos'è|cosa sono|che cosa sono|definisci)\s+(?:the |a |an |il |lo |la |l'|i |gli |le |un |una )?(.+?)\s*\?*\s*$"
ENUMERATION = r"(?i)^\s*(?:how many|list|which|name|quali|quanti|quante|elenca|cita)\b"
DEICTIC = r"(?i)^(?:this|that|it|these|those|they|questo|questa|quello|quella|ciò)\b"
FOLLOW_UP = r"(?i)^\s*(?:and|but|so|then|also|what about|how about|e|ed|ma|anche|invece|allora|e per)\b"
POINTING = r"(?i)\b(?:it|its|they|them|this|that|these|those|lo|la|li|questo|questa|questi|queste|quello|quella|ciò)\b"


def quotes(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, quote): the quoted passages of at least 25 characters, as their words."""
    q = answers.select(key, F.explode(F.regexp_extract_all(text, F.lit(QUOTE), 1)).alias("raw"))
    return q.select(key, F.array_join(T.words(F.col("raw")), " ").alias("quote")).filter(F.length("quote") >= 25).distinct()


def verbatim(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(quote): those of the wanted word sequences that stand word for word in one of the texts.

    Sequences and texts meet on LEAD words, so nothing is searched in every text.
    """
    w = wanted.select("quote", F.split("quote", " ").alias("qw")).filter(F.size("qw") >= LEAD)
    w = w.select("quote", F.size("qw").alias("n"), F.array_join(F.slice("qw", 1, LEAD), " ").alias("lead")).distinct()
    t = texts.select(T.words(F.col(text)).alias("w")).select("w", F.posexplode_outer("w").alias("i", "one")).filter("one IS NOT NULL")
    t = t.withColumn("lead", F.array_join(F.slice("w", F.col("i") + 1, LEAD), " "))
    return t.join(bounded(w), "lead").filter(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ") == F.col("quote")).select("quote").distinct()


def definitional_term(question: Column) -> Column:
    """The term whose definition a question asks for: at most six words and 60 characters, none that points back; else null."""
    term = F.regexp_extract(question, DEFINITION, 1)
    ok = (term != "") & (F.length(term) <= 60) & (F.size(F.split(term, r"\s+")) <= 6) & ~term.rlike(DEICTIC) & ~question.rlike(ENUMERATION)
    return F.when(ok, F.lower(term))


def definition_score(sentence: Column, words: Column, term: Column) -> Column:
    """How much a sentence defines a term: .5 for each occurrence, 2 for a copula after it, 3 for an acronym after it, 1 for a colon."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    hits = (F.length(padded) - F.length(F.replace(padded, F.concat(F.lit(" "), term, F.lit(" ")), F.lit("")))) / (F.length(term) + 2)
    after = F.split_part(padded, F.concat(F.lit(" "), term, F.lit(" ")), F.lit(-1))
    copula = F.when(after.rlike(r"^(is|are|means|è|sono|indica) "), 2.0).otherwise(0.0)
    acronym = F.when(F.lower(sentence).contains(F.concat(term, F.lit(" ("))), 3.0).otherwise(0.0)
    colon = F.when(F.lower(sentence).contains(F.concat(term, F.lit(":"))), 1.0).otherwise(0.0)
    return 0.5 * hits + copula + acronym + colon


def kept_first(items: DataFrame, similar: DataFrame) -> DataFrame:
    """Of items (id) those that stay when each one is dropped that is similar (a < b) to an earlier one that stays.

    An item is settled once all earlier items similar to it are; each round settles the next of every chain.
    """
    open_ = materialize(items.select("id").distinct().withColumn("stays", F.lit(None).cast("boolean")), "items")
    pairs = materialize(similar.select("a", "b").distinct(), "pairs")
    while True:
        near = pairs.join(open_.select(F.col("id").alias("a"), F.coalesce(F.col("stays").cast("string"), F.lit("?")).alias("s")), "a")
        told = near.groupBy(F.col("b").alias("id")).agg(F.max(F.col("s") == "true").alias("hit"), F.max(F.col("s") == "?").alias("wait"))
        new = F.when(F.col("stays").isNotNull(), F.col("stays")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("wait", F.lit(False)), F.lit(True))
        open_ = materialize(open_.join(told, "id", "left").select("id", new.alias("stays")), "items")
        if not open_.filter("stays IS NULL").limit(1).count():
            return open_.filter("stays").select("id")


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs a < b of (id, words) with a Jaccard share of at least `least`, met on their rarest words only."""
    n = sets.withColumn("n", F.size("words")).filter("n > 0")
    df = n.select(F.explode_outer("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = n.select("id", "n", F.explode_outer("words").alias("w")).join(df, "w").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "w")))
    head = materialize(ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "n", "w"), "heads")
    b = head.select(F.col("id").alias("b"), F.col("n").alias("m"), "w")
    cand = head.withColumnRenamed("id", "a").join(b, "w").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m"))).select("a", "b").distinct()
    full = cand.join(sets.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return full.filter(F.size(F.array_intersect("x", "y")) >= least * F.size(F.array_union("x", "y"))).select("a", "b")
