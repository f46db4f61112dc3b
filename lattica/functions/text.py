"""Text normalisers and predicates as Column functions, so that they stay inside generated code.

Null in, null out, unless stated otherwise. The many normalisers differ on purpose: each join key needs its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"

# Question words and function words that carry no search term.
STOPWORDS_IT = (
    "chi che cos come cosa quando dove quale quali qual quanto quanta quanti quante perche perché sono hanno essere viene vengono puo può possono "
    "il lo la le gli un una uno di del della delle dei degli dello da dal dalla dalle dai dagli in nel nella nelle nei negli "
    "su sul sulla sulle sui sugli sullo al alla alle ai agli allo con per tra fra cui non anche ogni sia questo questa questi queste quello quella "
    "piu più meno senza dopo prima due tre ed"
)
STOPWORDS_EN = (
    "what when where which who whom whose how why does do did is are was were be been being will can could should would may might must shall has have had "
    "the a an this that these those in on at by to of and or but if as than then from with without within into over under between among through during "
    "before after about against per it its they their them there here we our you your not no nor also only both each every any some all such same other "
    "another more most two three four say says said according following"
)
STOPWORDS = tuple(dict.fromkeys((STOPWORDS_IT + " " + STOPWORDS_EN).split()))

# Phrases that decline for lack of evidence.
INSUFFICIENT = (
    "the provided context does not contain",
    "the context does not contain",
    "does not contain enough information",
    "does not contain information",
    "i don't have enough information",
    "i cannot find",
    "cannot answer",
    "unable to answer",
    "not enough information",
    "no information available",
    "no relevant information",
    "non ho informazioni",
    "non posso rispondere",
    "il contesto fornito non contiene",
    "il contesto non contiene",
    "context is insufficient",
    "too sparse to build a reliable answer",
    "troppo scarno per costruire una risposta",
)

# Titles of front and back matter.
FRONT_MATTER = (
    r"(references|bibliograph|acknowledg|table of contents|list of (figures|tables|acronyms)|copyright|colophon|editorial board"
    r"|scientific (board|committee)|bibliografia|sommario|ringraziament|colofone|comitato scientifico|indice delle)"
)


def collapse(c: Column) -> Column:
    """Trim, and one blank for each run of white space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alnum_key(c: Column) -> Column:
    """Lower case, only a-z and 0-9 (letters with marks vanish)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def triple_key(c: Column) -> Column:
    """Lower case, collapsed blanks."""
    return collapse(F.lower(c))


def name_key(c: Column) -> Column:
    """Lower case, without a leading article, other characters than a-z and 0-9 as one blank."""
    x = F.regexp_replace(collapse(F.lower(c)), r"^(the|a|an) ", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def relation_type(c: Column) -> Column:
    """Upper case with underscores, as types of edges are written."""
    x = F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def scoring_key(c: Column) -> Column:
    """Lower case, collapsed, without quotes and dashes around it or marks after it; brackets stay."""
    x = collapse(F.lower(c))
    x = F.regexp_replace(x, "^[\"'«»“”‘’`\\-–— ]+", "")
    return F.regexp_replace(x, "[\"'«»“”‘’`\\-–—.,;: ]+$", "")


def fold(c: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(c, MARKED, PLAIN)


def match_key(c: Column) -> Column:
    return fold(scoring_key(c))


def question_key(c: Column) -> Column:
    """Lower case, collapsed, without marks at the end and on letters."""
    return fold(F.regexp_replace(collapse(F.lower(c)), r"[?!.,;: ]+$", ""))


def scan_key(c: Column) -> Column:
    """Folded lower case, other characters than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Identifier of a document from its file name."""
    stem = F.regexp_replace(F.lower(c), r"\.[a-z0-9]{1,5}$", "")
    return F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def identifier(c: Column) -> Column:
    """A safe label or property name: other characters as one underscore, never a digit first."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def search_words(c: Column) -> Column:
    """Words of three or more characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def token_count(c: Column) -> Column:
    """Runs of word characters, and each other character that is no blank."""
    return F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1))


def squad_words(c: Column) -> Column:
    """Lower-case words without ASCII marks and without English and Italian articles."""
    bare = F.translate(F.lower(c), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    articles = ("a", "an", "the", "il", "lo", "la", "i", "gli", "le", "un", "uno", "una")
    return F.filter(F.split(collapse(bare), " "), lambda w: (w != "") & ~w.isin(*articles))


def insufficient(c: Column) -> Column:
    """Whether an answer abstains: blank, or a marker in an answer of at most 400 characters or in its first 30 %."""
    low = F.lower(c)
    at = F.least(*[F.nullif(F.instr(low, F.lit(m)), F.lit(0)) for m in INSUFFICIENT], F.lit(1 << 30))
    n = F.length(low)
    hit = (at < (1 << 30)) & ((n <= 400) | (at - 1 <= F.floor(n * 0.30)))
    return F.when(c.isNull() | ~c.rlike(r"\S"), True).otherwise(hit)


def is_front_matter(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)" + FRONT_MATTER)


def all_caps(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def contains_words(text: Column, part: Column) -> Column:
    """Whether `part` stands in `text` as whole words."""
    t = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return F.contains(t, F.concat(F.lit(" "), F.array_join(words(part), " "), F.lit(" "))) & (F.size(words(part)) > 0)


def language_it_en(c: Column) -> Column:
    """it or en by counts of marker words; a tie goes to letters with marks, then to en."""
    it = F.array(*[F.lit(w) for w in "il lo la gli di del della che per con una sono come quali perché è non nel".split()])
    en = F.array(*[F.lit(w) for w in "the of and to in is are what which how does for with why a that who from".split()])
    w = words(c)
    n_it = F.size(F.filter(w, lambda x: F.array_contains(it, x)))
    n_en = F.size(F.filter(w, lambda x: F.array_contains(en, x)))
    return F.when(n_it > n_en, "it").when(n_en > n_it, "en").when(c.rlike("[àèéìòù]"), "it").otherwise("en")


def mention_count(c: Column) -> Column:
    """A count of at least one; text that is no number counts as one."""
    return F.greatest(F.lit(1), F.coalesce(F.try_to_number(c, F.lit("999999999")).cast("int"), F.lit(1)))


def confidence(c: Column) -> Column:
    """A number between 0 and 1; none counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("double(0)") + c.try_cast("double"), F.lit(0.0))))


def judge_score(c: Column) -> Column:
    """A score of 0..1; larger values are read as marks of 1 to 5."""
    x = c.cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, (x - 1) / 4).otherwise(x)))


def page_spec(c: Column) -> Column:
    """The pages of "4-6, 9": reversed or very long ranges count as their first page."""
    parts = F.split(F.regexp_replace(c, "[–—]", "-"), ",")
    ends = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), 1))
    some = F.filter(ends, lambda e: F.size(e) > 0)
    pages = F.transform(some, lambda e: _span(e[0].cast("int"), F.element_at(e, -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def _span(a: Column, b: Column) -> Column:
    return F.when((b < a) | (b - a > 200), F.array(a)).otherwise(F.sequence(a, F.greatest(a, b)))


def rendered_triple(s: Column, p: Column, o: Column, source: Column, pages: Column, mentions: Column) -> Column:
    """(s, p, o) [source=..., pages=..., mentions=...]"""
    return F.format_string("(%s, %s, %s) [source=%s, pages=%s, mentions=%s]", s, p, o, source, pages, mentions.cast("string"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
