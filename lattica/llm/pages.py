"""Problem 6: text of scanned pages made into continuous, readable paragraphs.

Method: a hidden Markov model labels the lines of a page as header (running line), number (page number), body or
break, from layout features: the shape of the line, its place on the page, and on how many pages of the document
its skeleton stands. Paragraphs are put together from body lines up to a break; words broken at line ends are
joined, also over page ends; misread words are restored.

The model is fitted on a bounded sample of whole pages (`sample_pages` of at most `sample_lines` lines) by counting cue
labels and re-labelling twice. Words are judged by counts over all pages: a word is misread if undoing one usual
confusion gives a word that is far more frequent. Tokens are counted first; words, candidates and repairs are made for
the distinct tokens, and only the repaired tokens meet the lines again. Nothing is collected.

Defined results: null text has no line; repeats of a page count once; a page without neighbours keeps a broken
word as it stands; lines with a running text on one page only are body; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded, materialize

SAMPLE_PAGES = 2000
SAMPLE_LINES = 1000
STATES = ("header", "number", "body", "break")
HEADER, NUMBER, BODY, BREAK = range(4)
HYPHENS = "-‐¬­"

# Confusions of character recognition, as (true, read).
CONFUSIONS = (
    "o 0,i 1,l 1,s 5,g 9,b 6,e c,c e,t f,f t,n ri,ri n,m rn,rn m,in m,m in,d cl,cl d,u ii,ii u,h li,li h,O 0,I 1,S 5,B 8,Z 2,i l,l i,w vv,n u,u n,h b,b h,a o,o a"
)
PAIRS = tuple(tuple(p.split()) for p in CONFUSIONS.split(","))
# of these, the ones that make another plausible word too easily need a lower-case word and a higher ratio
WEAK = {("t", "f"), ("f", "t"), ("c", "e"), ("i", "l"), ("l", "i"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("a", "o"), ("o", "a"), ("ri", "n"), ("m", "in"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h")}

NUMBER_LINE = r"(?i)^\W*(?:(?:page|pag|p|seite|pagina|página|s)\b\W*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|di|von|de|sur|/)\s*\d{1,4})?[^\w.]*$"
WORD_PIECE = r"[\p{L}\p{N}]+"


def skeleton(line: Column) -> Column:
    """A line without page number, case and marks, and with characters that are read for each other as one.

    Single characters are folded first and pairs then, so a line and its misreading fold alike.
    """
    x = F.regexp_replace(F.trim(line), r"^(?:\W*\d{1,4}\W*\s+)|(?:\s+\W*\d{1,4}\W*)$", "")
    x = F.translate(F.lower(x), "1i0596cf82unb", "llosghethzhhh")
    for a, b in (("rh", "m"), ("lh", "m"), ("el", "d"), ("ll", "h"), ("rl", "h"), ("vv", "w")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, ls): each page once, with its lines that have text as (line_no, line, symbol).

    A page stays one row, so its lines are never sorted or put together again. Only the skeletons of its two outermost
    lines at each end are shuffled, to count the pages of the document on which they stand.
    """
    key = ["doc_id", "page_number"]

    def placed(texts: DataFrame) -> DataFrame:
        arr = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.rtrim(F.replace(x, F.lit("\r"), F.lit(""))).alias("line")))
        page = texts.select(*key, F.filter(arr, lambda s: F.trim(s["line"]) != "").alias("full")).withColumn("n", F.size("full"))
        return page.select(*key, F.transform("full", lambda s, i: F.struct(s["line_no"].alias("line_no"), s["line"].alias("line"), (i + 1).alias("place"), (F.col("n") - i).alias("from_end"))).alias("ls"))

    some = pages.select(*key, "text").filter(F.col("text").isNotNull())
    outer = F.filter("ls", lambda s: ((s["place"] <= 2) | (s["from_end"] <= 2)) & ~s["line"].startswith("#"))
    edge = placed(some).select(*key, F.explode(outer).alias("s")).select(*key, "s.place", skeleton(F.col("s.line")).alias("skeleton")).distinct()
    edge = materialize(edge, "edges").filter(F.length("skeleton") >= 6)
    seen = edge.groupBy("doc_id", "skeleton").agg(F.countDistinct("page_number").alias("repeats")).filter("repeats > 1")
    own = edge.join(seen, ["doc_id", "skeleton"]).groupBy(*key, "place").agg(F.max("repeats").alias("repeats"))
    own = own.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("place", "repeats"))).alias("own"))
    got = placed(some.groupBy(*key).agg(F.min("text").alias("text"))).join(own, key, "left")
    repeats = lambda s: F.coalesce(F.try_element_at("own", s["place"]), F.lit(0))
    return got.select(*key, F.transform("ls", lambda s: F.struct(s["line_no"].alias("line_no"), s["line"].alias("line"), symbol(s["line"], s["place"], s["from_end"], repeats(s)).alias("symbol"))).alias("ls"))


def symbol(line: Column, at: Column, from_end: Column, repeats: Column) -> Column:
    """The observation of a line: shape x place x repeats, as a number below N_SYMBOLS. at, from_end count from 1."""
    shape = (
        F.when(line.startswith("#"), 0)
        .when(line.rlike(NUMBER_LINE), 1)
        .when(F.length(line) < 30, 2)
        .when(line.rlike(r"[.!?][\"»”')\]]*$"), 3)
        .when(line.rlike(r"[-\x{2010}\x{00AC}\x{00AD}]$"), 4)
        .otherwise(5)
    )
    place = F.when(at == 1, 0).when(from_end == 1, 1).when(at == 2, 2).when(from_end == 2, 3).otherwise(4)
    rep = F.when(repeats >= 3, 2).when(repeats == 2, 1).otherwise(0)
    return shape * 15 + place * 3 + rep


N_SYMBOLS = 90


class Lines:
    """A hidden Markov model of the lines of a page."""

    def __init__(self) -> None:
        self.start = np.zeros(4)
        self.trans = np.zeros((4, 4))
        self.emit = np.zeros((4, N_SYMBOLS))

    def count(self, pages: list[tuple[list[int], list[int]]]) -> Lines:
        s, t, e = np.full(4, 0.5), np.full((4, 4), 0.5), np.full((4, N_SYMBOLS), 0.02)
        for obs, lab in pages:
            s[lab[0]] += 1
            for a, b in zip(lab, lab[1:]):
                t[a, b] += 1
            for o, x in zip(obs, lab):
                e[x, o] += 1
        self.start, self.trans, self.emit = np.log(s / s.sum()), np.log(t / t.sum(1, keepdims=True)), np.log(e / e.sum(1, keepdims=True))
        return self

    def decode(self, obs: list[int]) -> list[int]:
        best = self.start + self.emit[:, obs[0]]
        back = []
        for o in obs[1:]:
            c = best[:, None] + self.trans
            back.append(c.argmax(0))
            best = c.max(0) + self.emit[:, o]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def cue(o: int) -> int:
    """The first label of an observation, before the model is fitted."""
    shape, place, rep = o // 15, o % 15 // 3, o % 3
    if shape == 0:
        return BREAK
    if shape == 1 and place < 4:
        return NUMBER
    if rep and place < 4:
        return HEADER
    return BODY


def fit(lines: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Lines:
    """The model of a bounded sample of pages, chosen by a hash of their key."""
    some = lines.filter(F.size("ls").between(1, SAMPLE_LINES)).select("doc_id", "page_number", F.col("ls.symbol").alias("obs"))
    rows = some.orderBy(F.xxhash64("doc_id", "page_number"), "doc_id", "page_number").limit(sample_pages).collect()
    obs = [list(r.obs) for r in rows]
    model = Lines().count([(o, [cue(x) for x in o]) for o in obs])
    for _ in range(2):
        model.count([(o, model.decode(o)) for o in obs])
    return model


def labelled(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, ls, above, below): pages with lines (line_no, line, state), and the last line of text of the
    page before and the first one of the page after, each as (page_number, line_no, line, state).

    Over page ends only these two lines of each page are sorted, so a document with most of all lines is never
    brought into one task.
    """
    key = ["doc_id", "page_number"]
    lines = materialize(page_lines(pages), "pages")
    held = pages.sparkSession.sparkContext.broadcast(fit(lines))

    @F.pandas_udf("array<int>")
    def states(obs: pd.Series) -> pd.Series:
        model = held.value
        return pd.Series([model.decode(o.tolist()) if len(o) else [] for o in obs])

    st = lines.select(*key, "ls", states(F.col("ls.symbol")).alias("st"))
    name = lambda x: F.element_at(F.array(*[F.lit(s) for s in STATES]), x + 1)
    ls = F.zip_with("ls", "st", lambda s, x: F.struct(F.col("page_number").alias("page_number"), s["line_no"].alias("line_no"), s["line"].alias("line"), name(x).alias("state")))
    st = st.select(*key, ls.alias("ls"), "st")
    text = F.filter("ls", lambda s: s["state"].isin("body", "break"))
    ends = materialize(st.select(*key, "st", text.alias("t")).select(*key, "st", F.get("t", F.lit(0)).alias("head"), F.when(F.size("t") > 0, F.element_at("t", -1)).alias("foot")), "ends")
    doc = Window.partitionBy("doc_id").orderBy("page_number")
    ends = ends.filter("head IS NOT NULL").select(*key, F.lag("foot").over(doc).alias("above"), F.lead("head").over(doc).alias("below")).unionByName(
        ends.filter("head IS NULL").select(*key, F.lit(None).cast(ends.schema["foot"].dataType).alias("above"), F.lit(None).cast(ends.schema["head"].dataType).alias("below"))
    ).join(ends.select(*key, "st"), key)
    got = lines.join(ends, key).select(*key, ls.alias("ls"), "above", "below")
    return materialize(got, "labelled")


def stripped(token: Column) -> Column:
    """A token without surrounding punctuation."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def ends_broken(line: Column) -> Column:
    return line.rlike(r"\p{L}[-\x{2010}\x{00AC}\x{00AD}]$")


def readable(lab: DataFrame) -> DataFrame:
    """Body lines and headings with their neighbours and their words.

    prev: the line with text before (page_number, line_no, line: its last word, state), following: the first word of the
    line after, both also over page ends.
    """
    page = lab.select("doc_id", "page_number", "above", "below", F.filter("ls", lambda s: s["state"].isin("body", "break")).alias("t"))
    near = F.transform("t", lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get("t", i - 1), F.col("above")).alias("prev"), F.coalesce(F.get("t", i + 1), F.col("below")).alias("next")))
    text = page.select("doc_id", "page_number", F.explode(near).alias("x")).select("doc_id", "page_number", "x.s.line_no", "x.s.line", "x.s.state", "x.prev", "x.next")
    # of the neighbours only the ends that meet the line are kept
    prev = F.when(F.col("prev").isNotNull(), F.struct("prev.page_number", "prev.line_no", F.substring_index(F.rtrim("prev.line"), " ", -1).alias("line"), "prev.state"))
    nxt = F.when(F.col("next").isNotNull(), F.regexp_extract("next.line", r"^\s*(\S+)", 1))
    return materialize(text.select("doc_id", "page_number", "line_no", "line", "state", prev.alias("prev"), nxt.alias("following")), "readable")


def tokens_of(text: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, t): the words of the lines without the two parts of words broken at line ends."""
    skip = F.when(ends_broken(F.col("prev.line")), 1).otherwise(0)
    cut = F.when(ends_broken(F.col("line")), 1).otherwise(0)
    toks = text.select("doc_id", "page_number", "line_no", F.split(F.trim("line"), r"\s+").alias("toks"), skip.alias("skip"), cut.alias("cut"))
    return toks.select("doc_id", "page_number", "line_no", F.explode(F.expr("slice(toks, skip + 1, greatest(size(toks) - skip - cut, 0))")).alias("t"))


SUSPENDED = ("and", "or", "e", "ed", "o", "und", "oder", "et", "ou", "y", "u")


def fragments(line: Column, following: Column) -> tuple[Column, Column, Column, Column]:
    """Of a line and the one after it: whether a word is broken between them, its two parts, and the token taken from the second."""
    first = F.regexp_replace(F.regexp_extract(line, r"(\S+)[-\x{2010}\x{00AC}\x{00AD}]$", 1), r"^[^\p{L}\p{N}]+", "")
    raw = F.regexp_extract(following, r"^\s*(\S+)", 1)
    rest = F.regexp_replace(raw, r"[^\p{L}\p{N}]+$", "")
    broken = ends_broken(line) & following.rlike(r"^\s*[\p{L}\p{N}]") & (first != "") & (rest != "") & ~F.lower(rest).isin(*SUSPENDED)
    return F.coalesce(broken, F.lit(False)), first, rest, raw


def token_counts(text: DataFrame) -> DataFrame:
    """(t, token, c): the distinct tokens, without surrounding punctuation (token), and how often they stand."""
    counts = tokens_of(text).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return materialize(counts.withColumn("token", stripped(F.col("t"))).filter("token <> ''"), "tokens")


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n): counts of the tokens and of their pieces in lower case."""
    low = tokens.groupBy(F.lower("token").alias("w")).agg(F.sum("c").alias("n"))
    parts = low.select("n", F.explode(F.array_distinct(F.concat(F.array("w"), F.split("w", r"[^\p{L}\p{N}]+")))).alias("word"))
    return materialize(parts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")


HAS_DIGIT = re.compile(r"\d")
HAS_LETTER = re.compile(r"[^\W\d_]")
UNDO_DIGIT = {"0": "o", "1": "il", "5": "s", "9": "g", "6": "b", "8": "b", "2": "z"}


FEW_DIGITS = 3
MANY_ONES = 10


def restorations(word: str) -> list[tuple[str, bool, bool]]:
    """What a word may have been, as (word, weak, sure): one confusion undone once or throughout, or all digits inside letters.

    Words with up to three single digits are taken for misread whatever they were (sure); others, which may be codes,
    where they give a known word. A digit one is i or l; of more than ten in a word all are the same.
    """
    if HAS_DIGIT.search(word) and HAS_LETTER.search(word):
        sure = sum(map(str.isdigit, word)) <= FEW_DIGITS and not re.search(r"\d{2}", word)
        if word.count("1") > MANY_ONES:
            made = ["".join({**UNDO_DIGIT, "1": one}.get(c, c) for c in word) for one in "il"]
        else:
            made = ["".join(c) for c in itertools.product(*[UNDO_DIGIT.get(c, c) for c in word])]
        return [(w, False, sure) for w in dict.fromkeys(made) if not HAS_DIGIT.search(w)]
    out: dict[str, bool] = {}
    for true, read in PAIRS:
        if not true.islower() or read.isdigit():
            continue
        weak = (true, read) in WEAK
        i = word.find(read)
        while i >= 0:
            w = word[:i] + true + word[i + len(read) :]
            out[w] = out.get(w, True) and weak
            i = word.find(read, i + 1)
        if word.count(read) > 1:
            w = word.replace(read, true)
            out[w] = out.get(w, True) and weak
    return [(w, weak, False) for w, weak in out.items()]


def misread(counts: DataFrame) -> DataFrame:
    """(word, fixed): misread words in lower case and what they were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, n in zip(pdf.word, pdf.n):
                digit = bool(HAS_DIGIT.search(w))
                rows += [(w, n, c, weak, sure) for c, weak, sure in restorations(w) if digit or len(w) >= 3]
            yield pd.DataFrame(rows, columns=["word", "n", "cand", "weak", "sure"])

    made = counts.filter(F.length("word") >= 2).mapInPandas(run, "word string, n long, cand string, weak boolean, sure boolean")
    known = counts.filter(~F.col("word").rlike(r"\d")).select(F.col("word").alias("cand"), F.col("n").alias("m"))
    got = made.join(known, "cand", "left").fillna(0, ["m"])
    enough = F.when(F.col("sure"), F.lit(True)).when(F.col("weak"), (F.col("m") >= 30) & (F.col("m") >= 40 * F.col("n"))).otherwise((F.col("m") >= 3) & (F.col("m") >= 4 * F.col("n")))
    # of several, the most frequent; among unseen ones i stands between consonants, l elsewhere
    between = F.when(F.col("cand").rlike("[^aeiouàèéìòù]i[^aeiouàèéìòù]"), 1).otherwise(0)
    best = F.max(F.struct("m", between.alias("b"), "cand")).alias("x")
    return got.filter(enough).groupBy("word").agg(best).select("word", F.col("x.cand").alias("fixed"))


def recase(read: Column, fixed: Column) -> Column:
    """The fixed word in the case of the word read."""
    capital = F.substring(read, 1, 1).rlike(r"\p{Lu}") | (F.substring(read, 1, 1).rlike(r"\d") & F.substring(read, 2, 1).rlike(r"\p{Lu}"))
    upper = (F.upper(read) == read) & (F.length(F.regexp_replace(read, r"[^\p{Lu}]", "")) >= 2)
    return F.when(upper, F.upper(fixed)).when(capital, F.concat(F.upper(F.substring(fixed, 1, 1)), F.substring(fixed, 2, 1_000_000_000))).otherwise(fixed)


def broken_words(text: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, first, raw, repaired): words broken at the end of body lines."""
    broken, first, rest, raw = fragments(F.col("line"), F.col("following"))
    cut = text.filter(broken).select("doc_id", "page_number", "line_no", first.alias("first"), rest.alias("rest"), raw.alias("raw"))
    plain, kept = F.concat("first", "rest"), F.concat_ws("-", "first", "rest")
    cut = cut.withColumn("p", F.lower(plain)).withColumn("k", F.lower(kept))
    cut = cut.join(counts.select(F.col("word").alias("p"), F.col("n").alias("np")), "p", "left").join(counts.select(F.col("word").alias("k"), F.col("n").alias("nk")), "k", "left")
    np_, nk = F.coalesce("np", F.lit(0)), F.coalesce("nk", F.lit(0))
    return cut.select("doc_id", "page_number", "line_no", "first", "raw", F.when(nk > np_, kept).otherwise(plain).alias("repaired"))


def noise(pages: DataFrame, lab: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, line_no, noise, repaired), distinct. A running line is one case, also where a word of it is misread."""
    lab = labelled(pages) if lab is None else lab
    text = readable(lab)
    key = ["doc_id", "page_number", "line_no"]
    tokens = token_counts(text)
    counts = word_counts(tokens)
    layout = lab.select("doc_id", "page_number", F.explode(F.filter("ls", lambda s: s["state"].isin("header", "number"))).alias("s"))
    lines = layout.select("doc_id", "page_number", "s.line_no", "s.state").select(*key, F.when(F.col("state") == "header", "running_line").otherwise("page_number").alias("noise"), F.lit("").alias("repaired"))
    hyphen = broken_words(text, counts).select(*key, F.lit("hyphen").alias("noise"), "repaired")
    return lines.unionByName(hyphen).unionByName(misread_tokens(text, repaired_tokens(tokens, counts)).select(*key, F.lit("ocr").alias("noise"), "repaired")).distinct()


def repaired_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(t, repaired, whole): tokens of which a piece is misread, without and with their surrounding punctuation."""
    # codes such as KT-19910 and plain numbers are no words
    some = tokens.filter(~F.col("token").rlike(r"^[\p{Lu}]{2,4}-\d+$"))
    pieces = some.select("t", "token", F.posexplode(F.regexp_extract_all("token", F.lit(f"({WORD_PIECE})"), 1)).alias("i", "piece")).filter(F.col("piece").rlike(r"\p{L}"))
    hit = pieces.withColumn("word", F.lower("piece")).join(misread(counts), "word").withColumn("new", recase(F.col("piece"), F.col("fixed")))
    swaps = hit.groupBy("t", "token").agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("swaps"))
    # the pieces by their place, between what stands around them
    between = F.split("token", WORD_PIECE, -1)
    made = F.transform(F.regexp_extract_all("token", F.lit(f"({WORD_PIECE})"), 1), lambda x, i: F.coalesce(F.try_element_at("swaps", i), x))
    repaired = F.concat(F.array_join(F.transform(made, lambda x, i: F.concat(F.get(between, i), x)), ""), F.element_at(between, -1))
    done = swaps.withColumn("repaired", repaired)
    return done.select("t", "repaired", F.concat(F.expr("substr(t, 1, instr(t, token) - 1)"), "repaired", F.expr("substr(t, instr(t, token) + length(token))")).alias("whole"))


def misread_tokens(text: DataFrame, repairs: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, t, repaired, whole): tokens of the lines of which a piece is misread."""
    return tokens_of(text).join(bounded(repairs), "t").distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, first_page, text): the readable paragraphs of each document.

    A paragraph ends at a heading, and after a line that ends a sentence and is followed by a blank line or by the
    next page. Its lines are put together inside one small group for each paragraph, never for a whole document.
    """
    lab = labelled(pages)
    text = readable(lab)
    tokens = token_counts(text)
    counts = word_counts(tokens)
    fixes = misread_tokens(text, repaired_tokens(tokens, counts)).groupBy("doc_id", "page_number", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("t", "whole"))).alias("swaps"))
    key = ["doc_id", "page_number", "line_no"]
    cuts = broken_words(text, counts).select(*key, F.col("repaired").alias("joined"), "first", F.col("raw").alias("taken"))
    one = text.join(fixes, key, "left").join(cuts, key, "left")
    # whole tokens are replaced where they stand, never a part of another word
    swapped = F.array_join(F.transform(F.split(F.trim("line"), r"\s+"), lambda x: F.coalesce(F.try_element_at("swaps", x), x)), " ")
    fixed = F.when(F.col("swaps").isNull(), F.col("line")).otherwise(swapped)
    lost, _, _, raw = fragments(F.col("prev.line"), F.col("line"))
    one = one.withColumn("fixed", F.trim(fixed)).withColumn("lost", F.when(lost, raw))
    body = F.when(F.col("lost").isNotNull(), F.trim(F.expr("substr(fixed, length(lost) + 1)"))).otherwise(F.col("fixed"))
    tail = F.regexp_extract(F.col("taken"), r"([^\p{L}\p{N}]*)$", 1)
    one = one.withColumn("b", body).withColumn("tail", F.coalesce(tail, F.lit("")))
    whole = F.when(F.col("joined").isNotNull(), F.expr("substr(b, 1, greatest(length(b) - length(first) - 1, 0)) || joined || tail")).otherwise(F.col("b"))
    gap = (F.col("prev.page_number") != F.col("page_number")) | (F.col("line_no") - F.col("prev.line_no") > 1)
    ended = F.col("prev.line").rlike(r"[.!?:][\"»”')\]]*$") & gap
    new = F.when(F.col("prev").isNull() | (F.col("state") == "break") | (F.col("prev.state") == "break") | ended, 1).otherwise(0)
    one = one.withColumn("whole", whole).withColumn("new", new)
    # numbers run inside the pages first, then over one sum for each page
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = one.groupBy("doc_id", "page_number").agg(F.sum("new").alias("s"))
    doc = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("doc_id", "page_number", F.coalesce(F.sum("s").over(doc), F.lit(0)).alias("before"))
    one = one.withColumn("k", F.sum("new").over(page)).join(sums, ["doc_id", "page_number"]).withColumn("paragraph_no", F.col("before") + F.col("k"))
    got = one.groupBy("doc_id", "paragraph_no").agg(F.min("page_number").alias("first_page"), F.array_sort(F.collect_list(F.struct("page_number", "line_no", "whole"))).alias("ls"))
    return got.select("doc_id", "paragraph_no", "first_page", F.regexp_replace(F.concat_ws(" ", F.filter(F.transform("ls", lambda s: s["whole"]), lambda x: x != "")), r"\s+", " ").alias("text"))


def found(pages: DataFrame) -> DataFrame:
    """p6_found."""
    return noise(pages).select("doc_id", F.col("page_number"), F.col("line_no"), "noise", "repaired")
