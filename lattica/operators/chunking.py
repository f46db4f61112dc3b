"""Segmentation: paragraphs, sections, windows of characters and of tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T


def paragraphs(docs: DataFrame, key: str, text: str, delimiter: str = r"\n\s*\n") -> DataFrame:
    """(key, paragraph_no, paragraph): trimmed, empty ones dropped, numbered from 1 in order."""
    p = F.filter(F.transform(F.split(F.col(text), delimiter), F.trim), lambda x: x != "")
    return docs.select(key, F.posexplode(p).alias("k", "paragraph")).select(key, (F.col("k") + 1).alias("paragraph_no"), "paragraph")


def sections(pages: DataFrame) -> DataFrame:
    """Sections of paged documents: the first heading of each page, runs of one title as one, up to the next start."""
    head = F.regexp_extract("text", r"(?m)^(#{1,6})\s+(.+?)\s*$", 2)
    level = F.length(F.regexp_extract("text", r"(?m)^(#{1,6})\s+(.+?)\s*$", 1))
    h = pages.select("doc_id", "page_number", head.alias("title"), level.alias("level")).filter("title <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_number")
    starts = h.withColumn("prev", F.lag(F.lower("title")).over(w)).filter(F.col("prev").isNull() | (F.col("prev") != F.lower("title")))
    last = pages.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    nxt = F.lead("page_number").over(w) - 1
    found = starts.withColumn("next", nxt).join(last, "doc_id").select(
        "doc_id", "title", "level", F.col("page_number").alias("start_page"), F.greatest("page_number", F.coalesce("next", "last_page")).alias("end_page")
    )
    none = last.join(starts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("Full Document").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("start_page"), F.col("last_page").alias("end_page"))
    return found.unionByName(none)


def char_windows(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 180, least: int = 80) -> DataFrame:
    """(key, window_no, start, content): windows of `size` characters that step by size - overlap.

    A window under `least` characters is dropped, unless it is the whole text.
    """
    if not 0 <= overlap < size or least < 0:
        raise ValueError("size must be above overlap, and both not negative")
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    d = docs.filter(F.length(F.trim(text)) > 0).select(key, F.col(text).alias("t"), F.posexplode(starts).alias("k", "start"))
    d = d.withColumn("content", F.trim(F.expr(f"substring(t, start + 1, {size})")))
    return d.filter((F.length("content") >= least) | (F.length("t") <= size)).select(key, (F.col("k") + 1).alias("window_no"), "start", "content")


def compressed(text: Column, budget_tokens: int) -> Column:
    """Text over the budget (a token is taken as four characters) keeps its head and its tail, half the budget each."""
    half = budget_tokens * 2
    cut = F.concat(F.substring(text, 1, half), F.lit(" [...] "), F.right(text, F.lit(half)))
    return F.when(F.length(text) * 0.25 > budget_tokens, cut).otherwise(text)


def budget_windows(paragraphs_: DataFrame, group: list[str], order: str, max_tokens: int = 512, overlap_tokens: int = 128) -> DataFrame:
    """Windows of whole paragraphs up to max_tokens, stepping back by up to overlap_tokens, at least half a window onward.

    Filling a window depends on where the last one ended, so each group (a section of a document) is folded in
    order. Groups are sections, never a whole source.
    """
    schema = ", ".join(f"{g} {t}" for g, t in paragraphs_.select(*group).dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        n, texts = pdf.tokens.tolist(), pdf.paragraph.tolist()
        rows, i, k = [], 0, 1
        while i < len(n):
            j, total = i, 0
            while j < len(n) and (j == i or total + n[j] <= max_tokens):
                total += n[j]
                j += 1
            rows.append((*[pdf[g].iloc[0] for g in group], k, i + 1, j, total, "\n\n".join(texts[i:j])))
            if j >= len(n):
                break
            back, b = j, 0
            while back > i + max(1, (j - i + 1) // 2) and b + n[back - 1] <= overlap_tokens:
                back -= 1
                b += n[back]
            i, k = back, k + 1
        return pd.DataFrame(rows, columns=[*group, "window_no", "first_paragraph", "last_paragraph", "tokens", "content"])

    rows = paragraphs_.withColumn("tokens", T.token_count(F.col("paragraph")))
    return rows.groupBy(*group).applyInPandas(fold, f"{schema}, window_no int, first_paragraph int, last_paragraph int, tokens long, content string")


def sentence_split(text: Column) -> Column:
    """Sentences: at . ! ? before a blank and a capital, and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}\"«“¿¡])|\s*\n\s*"), F.trim), lambda s: s != "")


def routed_chunks(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks by size of document: up to 10 pages packed to 400 tokens, up to 80 by section 512/128, above 1024/256."""
    secs = sections(pages)
    paras = paragraphs(pages.withColumn("page_key", F.concat_ws("#", "doc_id", "page_number")), "page_key", "text").select(
        F.regexp_extract("page_key", r"^(.*)#(\d+)$", 1).alias("doc_id"), F.regexp_extract("page_key", r"^(.*)#(\d+)$", 2).cast("int").alias("page_number"), "paragraph_no", "paragraph"
    )
    placed = paras.join(secs, "doc_id").filter("page_number BETWEEN start_page AND end_page")
    sized = placed.join(docs.select("doc_id", "page_count").distinct(), "doc_id").withColumn("seq", F.col("page_number") * 100000 + F.col("paragraph_no"))
    small = budget_windows(sized.filter("page_count <= 10").withColumn("start_page", F.lit(1)), ["doc_id", "start_page"], "seq", 400, 0)
    middle = budget_windows(sized.filter("page_count > 10 AND page_count <= 80"), ["doc_id", "start_page"], "seq", 512, 128)
    large = budget_windows(sized.filter("page_count > 80"), ["doc_id", "start_page"], "seq", 1024, 256)
    w = Window.partitionBy("doc_id").orderBy("start_page", "window_no")
    out = small.unionByName(middle).unionByName(large).withColumn("chunk_index", F.row_number().over(w))
    return out.select("doc_id", "chunk_index", F.format_string("%s_chunk_%05d", "doc_id", "chunk_index").alias("chunk_id"), "tokens", "content")

