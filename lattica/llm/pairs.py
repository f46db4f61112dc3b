"""Problem 1: prompt and response pairs whose response is not a usable reply.

Method: a conditional random field tags each clause of a response as answer, refusal, echo, foreign or
unfinished; the coverage of the tags over the response gives the defect of the pair.

Training: a bounded sample of `sample_rows` responses. Their clauses get labels from plain cues, and made-up
pairs are added whose labels are known by construction: the question alone, a response to a question in
another language, a response cut off. The field then weighs the cues against each other and against the
neighbouring clauses. Sampled responses are whole; those over `sample_chars` characters are not sampled. All rows are
read and tagged. Whether the last item of a list is complete is told by all lists of all responses: an item that stands
with a line after it in several of them is a term, and the last items meet the frame of terms in a join.

Defined results: a null response, or one of blanks, marks, empty brackets or tags, a bare heading or a
placeholder, is `empty`; a null question has no language and no words, so neither `question_copy` nor
`wrong_language` is given; repeats of a result come out once; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.common import materialize
from lattica.llm import langid
from lattica.llm.crf import CRF, pad
from lattica.llm.langid import LANGS, Scorer

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
TERM_LEAST = 3
A, R, E, X, U = range(5)
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# Ways to write that there is no value, headings without a body.
PLACEHOLDERS = "null none nil nan n/a na n.a. n.d. nd undefined unknown empty tbd todo nessuno nulla ninguno aucun keine kein nenhum"
HEADINGS = "answer response reply final answer risposta réponse respuesta antwort resposta output result"

# Stems of phrases that decline or say that nothing can be said.
REFUSALS = (
    r"\bcan(?:no|')t (?:help|give|answer|provide|say|assist|determine|respond|be (?:determined|answered|established))|\bcannot\b|\bunable to\b|\bnot able to\b|\bdo(?:n't| not) know\b|\bdecline\b|\brather not\b|\btoo thin\b|\bno basis\b|\bno supporting\b"
    r"|\bdo(?:es)? not (?:mention|contain|allow|cover)\b|\bnothing in the\b|\bnot be appropriate\b|\bplease share\b|\bfurther material\b|\bam sorry\b|\bunfortunately\b|\binsufficient\b|\bnot enough (?:evidence|information)\b|\bwithout verified\b",
    r"\bnon (?:sono in grado|conosco|so |posso|risulta|citano|trovo|emerge|contien|è possibile|sarebbe)|\bpurtroppo\b|\bmi dispiace\b|\bastener|\btroppo scarse\b|\bse mi invii\b|\bnon azzardare\b|\bimpossibile\b|\binsufficient|\bpreferisco non\b|\bnessuna base\b|\bcondividi altri\b",
    r"\bne (?:peux|sais|puis|connais|trouve|mention|permet|figure|contien|serait)|\bn'(?:ai|est|offre|apport|y a|indiqu)\w* pas|\bmalheureusement\b|\bdésolé|\bm'abstenir\b|\btrop (?:maigres|minces|faibles|rares)\b|\baucun(?:e)? (?:base|élément|fait|passage|information)|\bje préfère ne\b|\bimpossible de\b|\bne pas me prononcer",
    r"\bno (?:puedo|sé|conozco|encuentro|mencionan|aparece|dispongo|hay (?:base|datos|hechos)|contien|es posible|sería|me es)|\blamentablemente\b|\bdesgraciadamente\b|\blo siento\b|\babstener|\bdemasiado escas|\bprefiero no\b|\bimposible\b|\bninguna base\b|\bsi me env",
    r"\bnicht (?:beantworten|helfen|bekannt|sagen|angeben|möglich|beurteilen|erwähn|weiterhelfen)|\bkenne ich\b.*\bnicht\b|\bweiß (?:ich )?(?:es )?nicht\b|\bleider\b|\btut mir leid\b|\bkeine (?:grundlage|angaben|antwort|belege|auskunft|hinweise|information)|\bzu dünn\b|\bzu schwach\b|\bkann ich\b.*\bnicht\b|\bkann\b.*\bnicht\b.*\b(?:geben|beantworten|helfen)|\blieber nicht\b|\bnichts\b.*\b(?:über|zu)\b",
    r"\bnão (?:posso|sei|conheço|encontr|mencionam|consigo|há (?:base|dados|factos)|contém|é possível|seria)|\binfelizmente\b|\blamento\b|\babster|\bdemasiado escass|\bprefiro não\b|\bimpossível\b|\bnenhuma base\b",
)
REFUSAL = re.compile("|".join(REFUSALS))
# Each phrase above has one of these words, so the others need no search.
REFUSAL_WORDS = set(
    "can cannot unable able know decline rather thin basis supporting not nothing appropriate share further sorry unfortunately insufficient enough without don doesn"
    " non purtroppo dispiace astenermi astenersi astenerci scarse invii azzardare impossibile insufficiente insufficienti preferisco nessuna condividi"
    " ne n malheureusement désolé désolée abstenir maigres minces faibles rares aucun aucune impossible"
    " no lamentablemente desgraciadamente siento abstenerme abstenernos escasas escasos escasa prefiero imposible ninguna env envía envías envíe"
    " nicht leider leid keine dünn schwach nichts"
    " não infelizmente lamento abster abstenho escassas escassos escassa prefiro impossível nenhuma".split()
)

TAG_OR_WORD = re.compile(r"<[^<>]{0,40}>|([^\W_]+)")
WORDS = re.compile(r"[^\W_]+")
CITATION = re.compile(r"(?:\s*(?:\[\d+\]|\((?:[A-Z]{1,6}-\d+)\)))+\s*$")
BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
BARE_BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s*$")
TERMINAL = re.compile(r"[.!?:。][\"»”’')\]*_`]*$")
DANGLING = re.compile(r"(?:…|\.\.\.|[\w]-|[,;(\[{\"“«*]|\*\*|[-–])$")
CLAUSE = langid.SENTENCE_END


def is_empty(text: str | None) -> bool:
    """Whether a response has no content at all."""
    if text is None:
        return True
    bare = list(itertools.islice((m[1] for m in TAG_OR_WORD.finditer(text) if m[1]), 4))
    if not bare:
        return True
    if len(bare) > 3:
        return False
    low = " ".join(bare).lower()
    stripped = text.strip(" \t\r\n*_#`\"'()[]{}<>.").lower()
    if stripped in PLACEHOLDERS.split() or low in PLACEHOLDERS.split():
        return True
    heading = text.strip().rstrip("*_ ").endswith(":") or text.lstrip().startswith("#")
    return heading and low in {h for h in [*HEADINGS.split(), "final answer"]}


def clauses(text: str) -> list[str]:
    """The sentences and lines of a response; closing citations belong to the clause before them."""
    out: list[str] = []
    for s in CLAUSE.split(text.strip()):
        if not s or s.isspace():
            continue
        if out and s[0] in "[(" and not WORDS.search(CITATION.sub("", " " + s)):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


FEATURES = 24
LEAD_IN = 5


def features(parts: list[str], best: list[float], gaps: list[float], question_words: set[str], term: bool) -> list[list[float]]:
    """Features of the clauses of one response; gaps are best score less that of the question's language; term: whether
    its last list item is a term."""
    n = len(parts)
    out = []
    nq = len(question_words)
    for i, p in enumerate(parts):
        row = [0.0] * FEATURES
        row[0] = 1.0
        last = i == n - 1
        low = p.lower()
        ws = set(WORDS.findall(low))
        if nq and ws:
            hit = len(question_words & ws)
            if hit > 0.6 * len(ws):
                over, back = hit / len(ws), hit / nq
                row[1], row[2], row[3] = float(back > 0.8), float(back > 0.85), float(over > 0.85 and back > 0.7)
            elif hit > 0.85 * nq:
                row[2] = 1.0
            row[4] = float(p.rstrip(" \"'*»”)_`").endswith("?"))
        gap = gaps[i]
        if gap == gap:
            row[5], row[6], row[7] = float(gap > 6), float(2.5 < gap <= 6), float(gap <= 0)
            row[8] = float(best[i] < 1.5)
        if not ws.isdisjoint(REFUSAL_WORDS) and REFUSAL.search(low):
            row[9] = 1.0
            row[10] = float(i == 0)
            row[11] = float(len(ws) < 22)
        listed = p.lstrip()[:1] in "-*•–0123456789" and bool(BULLET.match(p))
        row[13] = float(listed)
        if last:
            row[12] = 1.0
            body = p.rstrip()
            if body[-1] in "])":
                body = CITATION.sub("", p).rstrip()
            done = bool(TERMINAL.search(body)) and not body.endswith("...")
            quote = body.count('"') % 2 == 1 or body.count("«") > body.count("»")
            row[14] = float(not done)
            row[15] = float(bool(DANGLING.search(body)) and not (done and not body.endswith("...")))
            bare = n == 1 and len(ws) <= 5 and not listed
            inlist = listed or BARE_BULLET.match(body) is not None
            row[16] = float(bare and not done)
            row[17] = float(inlist and (term or done))
            row[18] = float(inlist and not (term or done))
            row[19] = float(not done and not inlist and not bare)
            row[20] = float(quote and not done)
            row[21] = float(body.endswith(":"))
            row[22] = float(bare and bool(DANGLING.search(body)))
        else:
            row[23] = 1.0
        out.append(row)
    return out


def batch_features(questions: list[str | None], answers: list[str], scorer: Scorer, terms: list[bool]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    parts = [clauses(a) for a in answers]
    flat = [langid.tokens(p) for ps in parts for p in ps]
    scores = scorer.score(flat)
    known: dict[str | None, tuple[set[str], int]] = {}
    for q in set(questions):
        if q is None or not q.strip():
            known[q] = (set(), -1)
        else:
            s = scorer.score([langid.tokens(q)])[0]
            known[q] = (set(WORDS.findall(q.lower())), int(s.argmax()) if s.max() > 0 else -1)
    lens = np.array([len(p) for p in parts], dtype=np.int64)
    lang = np.repeat(np.array([known[q][1] for q in questions], dtype=np.int64), lens)
    best = scores.max(axis=1) if len(scores) else np.zeros(0)
    gap = np.where(lang >= 0, best - scores[np.arange(len(scores)), lang], np.nan)
    best_list, gap_list = best.tolist(), gap.tolist()
    rows: list[list[float]] = []
    at = 0
    for q, ps, term in zip(questions, parts, terms):
        rows += features(ps, best_list[at : at + len(ps)], gap_list[at : at + len(ps)], known[q][0], term)
        at += len(ps)
    return np.array(rows).reshape(-1, FEATURES), lens, parts


def cue_labels(f: np.ndarray) -> list[int]:
    """First labels of the clauses of a response, from single cues."""
    out = []
    for r in f:
        if r[3] or (r[1] or r[2]) and r[4]:
            out.append(E)  # also where the question's mark is gone
        elif r[14] and (r[15] or r[18] or r[19] or r[20]) and not r[16] or r[21] and r[12]:
            out.append(U)
        elif r[9]:
            out.append(R)
        elif r[5]:
            out.append(X)
        else:
            out.append(A)
    # a response in which most is refusal is refusal throughout
    if R in out and A in out and out.count(R) >= out.count(A) and out[0] == R:
        out = [R if y == A else y for y in out]
    return out


def copied(q: str, k: int) -> str:
    """A question as responses repeat it: as it is, with a lead-in or marks, without its mark, or with a word lost."""
    ws = q.split()
    return (q, f"The question is: {q}", f'"{q}"', f"**{q}**", q.rstrip("?"), " ".join(ws[: len(ws) // 2] + ws[len(ws) // 2 + 1 :]), q.upper(), f"> {q}")[k % 8]


def train(rows: list[tuple[str | None, str | None, bool]], model: langid.Backoff) -> CRF:
    """Fit the field on sampled (question, answer, whether its last list item is a term) and on pairs made from them."""
    scorer = Scorer(model)
    rows = [r for r in rows if not is_empty(r[1])]
    qs = [q for q, _, _ in rows if q and q.strip()]
    lang = {q: int(scorer.score([langid.tokens(q)])[0].argmax()) for q in set(qs)}
    made: list[tuple[str | None, str, str, bool]] = [(q, a, "", term) for q, a, term in rows]
    for i, (q, a, term) in enumerate(rows):
        if i % 6 == 0 and q and q.strip():
            made.append((q, copied(q.strip(), i // 6), "echo", False))
        if i % 6 == 1 and len(a) > 90 and not BULLET.search(a):
            cut = a[: 60 + (i * 37) % (len(a) - 70)].rstrip(" .!?\"»”)")
            made.append((q, cut + ("", "...", "…", "-", "")[i % 5], "cut", False))
        if i % 6 == 2 and q in lang and qs:
            other = qs[(i * 7919) % len(qs)]
            if lang[other] != lang[q]:
                made.append((other, a, "foreign", term))
    x, lens, _ = batch_features([m[0] for m in made], [m[1] for m in made], scorer, [m[3] for m in made])
    seqs, labels, at = [], [], 0
    for (q, a, kind, _), n in zip(made, lens):
        f = x[at : at + n]
        at += n
        if not n:
            continue
        y = cue_labels(f)
        if kind == "echo":
            y = [E] * n
        elif kind == "cut":
            y[-1] = U
        elif kind == "foreign":
            y = [X if v == A and f[j][5] else v for j, v in enumerate(y)]
        seqs.append(f)
        labels.append(y)
    field = CRF(FEATURES, len(TAGS))
    return field.fit(*pad(seqs, labels)) if seqs else field


def defect(tags: list[int], parts: list[str]) -> str | None:
    """The defect of a pair, from the share of the response that each tag covers."""
    cover = [0] * len(TAGS)
    echo = tags.index(E) if E in tags else 0
    for i, (t, p) in enumerate(zip(tags, parts)):
        if i < echo and len(WORDS.findall(p)) <= LEAD_IN:
            continue  # a few words before the question, such as a greeting, are no reply
        cover[t] += max(1, len(p))
    if tags[-1] == U:
        return "truncated"
    if cover[A]:
        return None
    if cover[R] and not cover[X]:
        return "refusal"
    if cover[X]:
        return "refusal" if cover[R] > cover[X] else "wrong_language"
    return "question_copy" if cover[E] else None


ITEM = r"^\s*([-*•–]|\d+[.)])\s+"
CITED = r"(\s*(\[\d+\]|\([A-Z]{1,6}-\d+\)))+\s*$"


def list_item(line: Column) -> Column:
    """The item of a line of a list, null for other lines."""
    item = F.lower(F.trim(F.translate(F.regexp_replace(F.regexp_replace(line, ITEM, ""), CITED, ""), "*_", "  ")))
    return F.when(line.rlike(ITEM + r"\S"), item)


def complete_terms(results: DataFrame) -> DataFrame:
    """(item): list items that stand complete, with a line after them, TERM_LEAST times or more."""
    lines = F.split(F.rtrim("answer"), "\n")
    items = results.filter(F.col("answer").contains("\n")).select(F.explode(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    items = items.select(list_item(F.col("line")).alias("item")).filter("item <> ''")
    return items.groupBy("item").count().filter(F.col("count") >= TERM_LEAST).select("item")


def with_terms(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(result_id, question, answer, term): whether the last item of the response is a term. Only responses that end
    in a list meet the frame of terms."""
    cols = ["result_id", "question", "answer"]
    r = pairs.select(*cols, list_item(F.element_at(F.split(F.rtrim("answer"), "\n"), -1)).alias("item"))
    ends = r.filter("item IS NOT NULL").join(terms.withColumn("term", F.lit(True)), "item", "left").select(*cols, F.coalesce("term", F.lit(False)).alias("term"))
    return r.filter("item IS NULL").select(*cols, F.lit(False).alias("term")).unionByName(ends)


def sample_pairs(results: DataFrame, terms: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str | None, str | None, bool]]:
    """At most `rows` whole pairs, chosen by a hash of the id; half of them responses marked insufficient, where there are such."""
    def take(df: DataFrame, n: int) -> list:
        top = df.select(F.xxhash64("result_id").alias("h"), "result_id").distinct().orderBy("h").limit(n)
        return with_terms(df.join(F.broadcast(top.select("result_id")), "result_id"), terms).distinct().collect()

    short = results.filter(F.length("answer") <= SAMPLE_CHARS)
    marked = F.coalesce(F.col("insufficient_answer"), F.lit(False))
    got = take(short.filter(marked), rows // 2) + take(short.filter(~marked), rows - rows // 2)
    return [(r.question, r.answer, r.term) for r in sorted(got, key=lambda r: (r.result_id, r.answer or ""))]


def tag(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each result with its defect (null where sound) and the share of the response that each tag covers."""
    model = langid.fit_on(chunks)
    terms = materialize(complete_terms(results), "terms")
    field = train(sample_pairs(results, terms), model)
    held = results.sparkSession.sparkContext.broadcast((model, field))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, field = held.value
        scorer = Scorer(model)
        for pdf in batches:
            ids, qs, ans, terms = pdf.result_id.tolist(), pdf.question.tolist(), pdf.answer.tolist(), pdf.term.tolist()
            out = [(i, "empty", 0.0, 0.0, 0.0, 0.0, 0.0) for i, a in zip(ids, ans) if is_empty(a)]
            full = [k for k, a in enumerate(ans) if not is_empty(a)]
            x, lens, parts = batch_features([qs[k] for k in full], [ans[k] for k in full], scorer, [terms[k] for k in full])
            tags = field.decode(x, lens).tolist()
            at = 0
            for k, ps in zip(full, parts):
                ts = tags[at : at + len(ps)]
                at += len(ps)
                cover = [0.0] * len(TAGS)
                total = sum(map(len, ps)) or 1
                for t, p in zip(ts, ps):
                    cover[t] += len(p) / total
                out.append((ids[k], defect(ts, ps) if ps else "empty", *(round(c, 6) for c in cover)))
            yield pd.DataFrame(out, columns=["result_id", "defect", *TAGS])

    cols = ", ".join(f"{t} double" for t in TAGS)
    return with_terms(results, terms).mapInPandas(run, f"result_id long, defect string, {cols}")


def found(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """p1_found."""
    return tag(results, chunks).filter(F.col("defect").isNotNull()).select("result_id", "defect").groupBy("result_id").agg(F.min("defect").alias("defect"))
