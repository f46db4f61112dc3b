"""Problem 5: freely entered values mapped to the entries of a reference list, the rest reported as unmatched.

Method: partition-based pigeonhole join, in SQL. Each reference wording is cut into k + 1 segments; a value
within k edits holds at least one of them unchanged, at a place shifted by at most k. Segments meet the
substrings of the values in an equality join; `levenshtein` verifies the pairs; an anti join gives the values
without a partner. k follows the length of the wording: 0 below 4 characters, 1 below 5, 2 below 9, else 4. Of these edits, one is
taken as it is below 9 characters, three below 14 and four beyond; up to k where the letters are the same in
another order, as after swaps of neighbours.

Values are cleaned alike on both sides: full-width letters, camel case, separators, wrapping marks, counters
and a leading auxiliary ("is", "was", "being", "to") are taken off; a wording stands also with its first word
as base form and as participle ("produces": "produce", "producing"). Only distinct cleaned values are joined,
so a value held by a third of all rows is compared once; the result meets the rows by the value itself.

Defined results: null values and values that are an entry character for character give no row in p5_found;
values without a letter or with no wording in reach are `UNMATCHED`; of several wordings in reach the one with
the fewest edits for its length wins, then the smallest vocab_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lattica.common import materialize

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def clean_sql(col: str, engine: str = "spark") -> str:
    """SQL that cleans a value: the same steps for Spark and for DuckDB."""
    g = "" if engine == "spark" else ", 'g'"
    esc = (lambda p: p.replace("\\", "\\\\")) if engine == "spark" else (lambda p: p)
    lit = lambda t: "'" + t.replace("\\", "\\\\" if engine == "spark" else "\\").replace("'", "\\'" if engine == "spark" else "''") + "'"

    def sub(x: str, pat: str, to: str) -> str:
        return f"regexp_replace({x}, '{esc(pat)}', '{to}'{g})"

    ref = "$1 $2" if engine == "spark" else "\\1 \\2"
    x = f"translate({col}, {lit(WIDE)}, {lit(NARROW)})"
    x = sub(x, "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}]", "")
    x = sub(x, "([a-z])([A-Z][a-z])", ref)
    x = f"lower({x})"
    x = sub(x, "\\([a-z0-9 ]*\\)[^\\p{L}\\p{N}]*$", "")
    x = sub(x, "^\\s*(rel|kg|pred|edge|onto|schema)\\s*[:/]", "")
    x = sub(x, "[^\\p{L}\\p{N}]+", " ")
    x = f"trim({x})"
    x = f"trim({sub(x, ' [0-9]+$', '')})"
    # braces are doubled for the formatter of spark.sql
    return x.replace("{", "{{").replace("}", "}}") if engine == "spark" else x


def key_sql(x: str, engine: str = "spark") -> str:
    """A cleaned value without its leading auxiliary."""
    return f"regexp_replace({x}, '^(is|was|are|were|being|been|be|to|has been|to be) ', '')"


# Each wording of an entry with the forms in which its first word may stand.
FORMS = """
WITH w AS (
  SELECT vocab_id, predicate, {clean} AS t FROM (
    SELECT vocab_id, predicate, predicate AS x FROM {vocab}
    UNION ALL SELECT vocab_id, predicate, label_it FROM {vocab} WHERE label_it IS NOT NULL
    UNION ALL SELECT vocab_id, predicate, {explode} FROM {vocab}) s),
p AS (SELECT vocab_id, predicate, t, regexp_extract(t, '^[^ ]+', 0) AS a, regexp_replace(t, '^[^ ]+', '') AS rest FROM w WHERE t <> ''),
b AS (SELECT vocab_id, predicate, a, rest,
        CASE WHEN length(a) > 3 AND a LIKE '%s' AND a NOT LIKE '%ss' THEN substr(a, 1, length(a) - 1) END AS base FROM p),
f AS (
  SELECT vocab_id, predicate, concat(a, rest) AS t FROM b
  UNION ALL SELECT vocab_id, predicate, {key} FROM b
  UNION ALL SELECT vocab_id, predicate, concat(base, rest) FROM b WHERE base IS NOT NULL
  UNION ALL SELECT vocab_id, predicate, concat(CASE WHEN base LIKE '%e' AND base NOT LIKE '%ee' THEN substr(base, 1, length(base) - 1) ELSE base END, 'ing', rest) FROM b WHERE base IS NOT NULL
  UNION ALL SELECT vocab_id, predicate, concat(substr(base, 1, length(base) - 1), rest) FROM b WHERE base LIKE '%_e' AND a LIKE '%shes'),
l AS (SELECT t, min(vocab_id) AS vocab_id, length(t) AS n,
        CASE WHEN length(t) < 4 THEN 0 WHEN length(t) < 5 THEN 1 WHEN length(t) < 9 THEN 2 ELSE 4 END AS k
      FROM f GROUP BY t)
SELECT l.t AS wording, l.vocab_id, v.predicate AS canonical, l.n, l.k FROM l JOIN {vocab} v ON l.vocab_id = v.vocab_id
"""

# Segments of the wordings: k + 1 pieces as equal as can be.
SEGMENTS = """
SELECT wording, vocab_id, canonical, n, k, i,
       CAST(floor(i * n / (k + 1)) AS INT) + 1 AS at,
       substr(wording, CAST(floor(i * n / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * n / (k + 1)) AS INT) - CAST(floor(i * n / (k + 1)) AS INT)) AS piece
FROM (SELECT *, explode(sequence(0, k)) AS i FROM {forms})
"""

# The places at which a piece of a wording of length n may lie in a value of length m, and the substrings there.
# A place is told by lengths alone, so there are at most some dozens for each length of a wording, however long the list.
CANDIDATES = """
WITH plan AS (SELECT n, k, at, len, explode(sequence(n - k, n + k)) AS m FROM (SELECT DISTINCT n, k, at, length(piece) AS len FROM {segments})),
sub AS (
  SELECT /*+ BROADCAST(p) */ v.value, p.n, p.k, p.at, substr(v.value, x.pos, p.len) AS piece
  FROM {values} v JOIN plan p ON length(v.value) = p.m
  LATERAL VIEW explode(sequence(greatest(1, p.at - p.k), greatest(1, p.at + p.k))) x AS pos
  WHERE x.pos + p.len - 1 <= length(v.value))
SELECT DISTINCT sub.value, s.wording, s.vocab_id, s.canonical, s.n, s.k
FROM sub JOIN {segments} s ON s.piece = sub.piece AND s.n = sub.n AND s.at = sub.at
"""

IN_REACH = "d <= CASE WHEN n < 9 THEN least(k, 1) WHEN n < 14 THEN 3 ELSE 4 END OR (d <= k AND n >= 5 AND length(value) = n AND {sorted_value} = {sorted_wording})"

# The best wording of each value in reach.
VERIFIED = """
WITH c AS (SELECT *, levenshtein(value, wording) AS d FROM {candidates}),
ok AS (SELECT * FROM c WHERE """ + IN_REACH.format(
    sorted_value="array_join(array_sort(split(value, '')), '')", sorted_wording="array_join(array_sort(split(wording, '')), '')"
) + """)
SELECT value, min(struct(d / n AS share, vocab_id, canonical)).canonical AS canonical FROM ok GROUP BY value
"""


def match_values(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """(value, canonical) for the distinct cleaned values of `values`; UNMATCHED where nothing is in reach.

    The wordings, their segments and the matches are written once: each is read at several places of the plan.
    """
    s = values.sparkSession
    forms = materialize(s.sql(FORMS.replace("{clean}", clean_sql("x")).replace("{key}", key_sql("concat(a, rest)")).replace("{explode}", "explode(aliases)"), vocab=vocab), "wordings")
    segments = materialize(s.sql(SEGMENTS, forms=forms), "segments")
    candidates = s.sql(CANDIDATES, segments=segments, values=values)
    best = materialize(s.sql(VERIFIED, candidates=candidates), "matches")
    rest = s.sql("SELECT v.value, 'UNMATCHED' AS canonical FROM {values} v LEFT ANTI JOIN {best} b ON v.value = b.value", values=values, best=best)
    return s.sql("SELECT value, canonical FROM {best} UNION ALL SELECT value, canonical FROM {rest}", best=best, rest=rest)


def map_column(rows: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """(raw, value, canonical) for each distinct raw spelling of the column."""
    s = rows.sparkSession
    raw = s.sql(f"SELECT DISTINCT `{column}` AS raw FROM {{rows}} WHERE `{column}` IS NOT NULL", rows=rows)
    cleaned = materialize(s.sql("SELECT raw, {key} AS value FROM (SELECT raw, {clean} AS c FROM {raw})".replace("{key}", key_sql("c")).replace("{clean}", clean_sql("raw")), raw=raw), "cleaned")
    values = materialize(s.sql("SELECT DISTINCT value FROM {cleaned}", cleaned=cleaned), "values")
    return s.sql("SELECT c.raw, c.value, m.canonical FROM {cleaned} c JOIN {matched} m ON c.value = m.value", cleaned=cleaned, matched=match_values(values, vocab))


def found(triples: DataFrame, vocab: DataFrame) -> DataFrame:
    """p5_found."""
    s = triples.sparkSession
    every = map_column(triples, "predicate", vocab)
    mapped = materialize(s.sql("SELECT m.raw, m.canonical FROM {every} m LEFT ANTI JOIN {vocab} v ON m.raw = v.predicate", every=every, vocab=vocab), "mapped")
    # the spellings that are entries already, the frequent ones, are gone; what is left is met by key
    return s.sql("SELECT DISTINCT t.triple_id, m.canonical FROM {triples} t JOIN {mapped} m ON t.predicate = m.raw", triples=triples.select("triple_id", "predicate"), mapped=mapped)


def found_sql() -> str:
    """The same mapping for DuckDB, comparing every distinct value with every wording instead of the join on pieces."""
    forms = FORMS.replace("{clean}", clean_sql("x", "duck")).replace("{key}", key_sql("concat(a, rest)")).replace("{explode}", "unnest(aliases)").replace("{vocab}", "relation_vocab")
    value = key_sql(clean_sql("predicate", "duck"))
    reach = IN_REACH.format(sorted_value="list_sort(string_split(value, ''))", sorted_wording="list_sort(string_split(wording, ''))")
    return f"""
WITH forms AS ({forms}),
raw AS (SELECT DISTINCT predicate, {value} AS value FROM triples WHERE predicate IS NOT NULL),
c AS (SELECT *, levenshtein(value, wording) AS d FROM (SELECT DISTINCT value FROM raw) v JOIN forms ON length(value) BETWEEN n - k AND n + k),
ok AS (SELECT * FROM c WHERE {reach}),
best AS (SELECT value, canonical FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY d / n, vocab_id) AS r FROM ok) WHERE r = 1)
SELECT DISTINCT t.triple_id, coalesce(b.canonical, 'UNMATCHED') AS canonical
FROM triples t JOIN raw r ON t.predicate = r.predicate LEFT JOIN best b ON r.value = b.value
WHERE t.predicate NOT IN (SELECT predicate FROM relation_vocab)
"""
