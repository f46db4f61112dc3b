"""Problem 3: language of documents and of the stretches in one language inside them.

Method: word-first backoff. A word that the model knows scores by its log frequency in each language;
an unseen word falls back to character n-grams, five characters first and then ever shorter ones.
Sentences are the unit; a record's sentences are decoded together with a cost for changing language, so a
sentence without evidence (a code, a citation, a name) takes the language around it.

Words that begin with a capital inside a sentence are skipped: names of firms and places tell nothing.
The model is fitted on a bounded sample of labelled rows (`per_language` whole texts of each language, chosen by
hash among those of 40 to `sample_chars` characters); every row is then read and labelled.

Defined results: every record comes out. A record without text or without any evidence has one row without
language, of confidence 0 (segment_no 0); p3_found leaves out texts of under five words, as its definition says.
Exact repeats of a record yield its segments once; extra columns are ignored. The confidence of a stretch is the
chance of its language against the next best one, were the words' log frequencies independent.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "it", "fr", "es", "de", "pt")
PER_LANGUAGE = 800
SAMPLE_CHARS = 20_000
MIN_WORDS = 5
SWITCH_COST = 7.0
KNOWN_LIMIT = 400_000

# Frequent function words of each language, the prior of the model.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as on by from at which are was this be or not have has it its their an been who what how would could than more after before between around",
    "it": "il lo la i gli le di a da in con su per tra del della dei delle dell al alla nel nella che e un una non si come è sono ha hanno più dopo ogni questo anche mentre secondo circa chi",
    "fr": "le la les de des du et à en un une est que pour dans par sur avec qui au aux ne pas se ce cette plus sont ont a été après chaque aussi tandis selon environ chez leur comment",
    "es": "el la los las de del y a en un una es que para por con no se su al lo como más son ha han fue después cada este esta también mientras según cerca desde hasta quién cómo entre",
    "de": "der die das und in zu den von mit ist des im für auf nicht ein eine dem sich auch als an es werden aus er hat dass nach bei wird oder um war über wie kann man einen einer während etwa wer",
    "pt": "o a os as de do da dos das e em um uma é que para por com não se na no nas nos ao mais como foi são tem após cada este esta também enquanto segundo cerca desde até quem entre pelo pela",
}

# The ways a language is written as a label.
LABEL_NAMES = {
    "en": "en eng english",
    "it": "it ita italian",
    "fr": "fr fra fre french",
    "es": "es spa spanish",
    "de": "de deu ger german",
    "pt": "pt por portuguese",
}
NO_LABEL = ("", "und", "unknown")

WORD = re.compile(r"(?<![^\W_])[a-zß-öø-ÿœ][^\W\d_]*")
FIRST = re.compile(r"[^\W\d_]+")
ANY_WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"»”’)\]*])\s+|\s*\n\s*")


def clean_label(col: Column) -> Column:
    """A label in any of its spellings as two letters; null where there is none; other codes stay as they are."""
    head = F.regexp_extract(F.lower(F.trim(col)), r"^([^-_]*)", 1)
    out = F.when(head.isin(*NO_LABEL), F.lit(None).cast("string"))
    for lang, names in LABEL_NAMES.items():
        out = out.when(head.isin(*names.split()), F.lit(lang))
    return out.otherwise(head)


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s and not s.isspace()]


def tokens(sentence: str) -> list[str]:
    """The words that count as evidence: those in lower case, and the first word of the sentence."""
    out = WORD.findall(sentence)
    m = FIRST.search(sentence)
    if m and not m[0][0].islower():
        out.append(m[0].lower())
    return out


class Backoff:
    """Known words and character n-grams with centred log frequencies of each language."""

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray], longest: int):
        self.words, self.grams, self.longest = words, grams, longest

    def unseen(self, word: str) -> np.ndarray:
        w = f"^{word}$"
        for n in range(self.longest, 1, -1):
            hits = [self.grams[g] for i in range(len(w) - n + 1) if (g := w[i : i + n]) in self.grams]
            if hits:
                return np.mean(hits, axis=0) * (0.25 * n / self.longest + 0.25)
        return np.zeros(len(LANGS))


def centred(counts: dict[str, np.ndarray], smooth: float, clip: float) -> dict[str, np.ndarray]:
    if not counts:
        return {}
    keys = list(counts)
    c = np.array([counts[k] for k in keys], dtype=float)
    total = c.sum(axis=0) + smooth * len(keys)
    lp = np.log(c + smooth) - np.log(total)
    lp -= lp.mean(axis=1, keepdims=True)
    return dict(zip(keys, np.clip(lp, -clip, clip)))


def count_model(pairs: list[tuple[int, list[str]]], longest: int = 5) -> Backoff:
    """The model of (language index, words) pairs and the function words."""
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    by = [Counter() for _ in LANGS]
    for k, ws in pairs:
        by[k].update(ws)
    for k, lang in enumerate(LANGS):
        by[k].update({w: 5 for w in FUNCTION_WORDS[lang].split()})
        for w, n in by[k].items():
            words[w][k] += n
    # languages of unequal sample size count alike
    size = np.array([sum(c.values()) for c in by], dtype=float)
    weight = size.max() / np.maximum(size, 200)
    words = {w: v * weight for w, v in words.items()}
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    for w, v in words.items():
        p = f"^{w}$"
        for n in range(2, longest + 1):
            for i in range(len(p) - n + 1):
                grams[p[i : i + n]] += np.sqrt(v)
    return Backoff(centred(words, 0.5, 4.0), centred(grams, 0.5, 2.0), longest)


def fit(labelled: list[tuple[str, str]]) -> Backoff:
    """Fit on (label, text) pairs: records first, then their sentences as the first model reads them."""
    index = {lang: k for k, lang in enumerate(LANGS)}
    split = [(index[lang], [tokens(s) for s in sentences(t)]) for lang, t in labelled if lang in index and t]
    model = count_model([(k, ws) for k, ss in split for ws in ss])
    for _ in range(2):
        scorer = Scorer(model)
        flat = [(k, ws) for k, ss in split for ws in ss]
        scores = scorer.score([ws for _, ws in flat])
        again = []
        for (k, ws), s in zip(flat, scores):
            best = int(s.argmax())
            again.append((best if s[best] - s[k] > 3 else k, ws))
        model = count_model(again)
    return model


class Scorer(dict):
    """Word to row of a score matrix; unseen words are scored once and kept, up to a limit."""

    def __init__(self, model: Backoff):
        super().__init__({w: i for i, w in enumerate(model.words)})
        self.model, self.base = model, len(model.words)
        self.m = np.zeros((self.base + 1024, len(LANGS)), dtype=np.float32)
        if self.base:
            self.m[: self.base] = np.array(list(model.words.values()))
        self.n = self.base

    def __missing__(self, word: str) -> int:
        if self.n >= len(self.m):
            self.m = np.vstack([self.m, np.zeros_like(self.m)])
        self.m[self.n] = self.model.unseen(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def trim(self) -> None:
        if self.n > KNOWN_LIMIT + self.base:
            for w in [w for w, i in self.items() if i >= self.base]:
                del self[w]
            self.n = self.base

    def score(self, token_lists: list[list[str]]) -> np.ndarray:
        """A row of language scores for each token list."""
        self.trim()
        lens = np.fromiter((len(t) for t in token_lists), dtype=np.int64, count=len(token_lists))
        ids = np.fromiter((self[w] for t in token_lists for w in t), dtype=np.int64, count=int(lens.sum()))
        out = np.zeros((len(token_lists), len(LANGS)))
        if len(ids):
            some = lens > 0
            starts = (np.cumsum(lens) - lens)[some]
            out[some] = np.add.reduceat(self.m[ids], starts, axis=0)
        return out


def decode(scores: np.ndarray, cost: float = SWITCH_COST) -> list[int]:
    """The best language of each sentence, where a change of language costs `cost`."""
    n = len(scores)
    best, back = scores[0].copy(), []
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - cost
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - cost) + scores[i]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def segments_of(texts: list[str | None], scorer: Scorer, min_words: int = MIN_WORDS) -> list[list[tuple[int, float, int, int]]]:
    """For each text its runs as (language index, confidence, sentences, characters)."""
    split, flat = [], []
    for t in texts:
        ss = sentences(t) if t and len(ANY_WORD.findall(t)) >= min_words else []
        split.append(ss)
        flat += ss
    scores = scorer.score([tokens(s) for s in flat])
    top = scores.argmax(axis=1) if len(scores) else np.zeros(0, dtype=int)
    out, at = [], 0
    for ss in split:
        n = len(ss)
        s, b = scores[at : at + n], top[at : at + n]
        at += n
        if not n or not np.abs(s).sum() > 0:
            out.append([])
            continue
        path = [int(b[0])] * n if (b == b[0]).all() else decode(s)
        runs: list[tuple[int, float, int, int]] = []
        i = 0
        while i < n:
            j = i
            while j + 1 < n and path[j + 1] == path[i]:
                j += 1
            total = np.sort(s[i : j + 1].sum(axis=0))
            runs.append((path[i], float(1 / (1 + np.exp(-min(30.0, total[-1] - total[-2])))), j - i + 1, sum(map(len, ss[i : j + 1]))))
            i = j + 1
        out.append(runs)
    return out


def sample_labelled(df: DataFrame, key: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most `per_language` labelled texts of each language, chosen by a hash of the key; texts are whole, and of at most SAMPLE_CHARS."""
    d = df.select(clean_label(F.col(label)).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h")).filter(F.col("lang").isin(*LANGS) & F.length("text").between(40, SAMPLE_CHARS))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= per_language)
    return d.select("lang", "text")


def fit_on(chunks: DataFrame, per_language: int = PER_LANGUAGE) -> Backoff:
    """The model of a bounded sample of labelled chunks."""
    return fit(sorted((r.lang, r.text) for r in sample_labelled(chunks, "chunk_id", "text", "lang", per_language).collect()))


def segment(records: DataFrame, model: Backoff, min_words: int = 1) -> DataFrame:
    """Segments of `records` (record_kind, record_id, label, text): one row for each stretch in one language, and one
    row with segment_no 0 and no language for a record of fewer than min_words words or without evidence.

    Columns: record_kind, record_id, label, segment_no, lang, confidence, n_segments, n_sentences, n_chars.
    """
    held = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for pdf in batches:
            rows = []
            for kind, rid, label, runs in zip(pdf.record_kind, pdf.record_id, pdf.label, segments_of(pdf.text.tolist(), scorer, min_words)):
                if not runs:
                    rows.append((kind, rid, label, 0, None, 0.0, 0, 0, 0))
                for k, (lang, conf, ns, nc) in enumerate(runs, 1):
                    rows.append((kind, rid, label, k, LANGS[lang], conf, len(runs), ns, nc))
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "label", "segment_no", "lang", "confidence", "n_segments", "n_sentences", "n_chars"])

    return records.select("record_kind", "record_id", "label", "text").mapInPandas(
        run, "record_kind string, record_id string, label string, segment_no int, lang string, confidence double, n_segments int, n_sentences int, n_chars int"
    )


def records(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks and answers as one frame of labelled texts."""
    c = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), clean_label(F.col("lang")).alias("label"), "text")
    a = results.select(F.lit("answer").alias("record_kind"), F.col("result_id").cast("string").alias("record_id"), clean_label(F.col("answer_lang")).alias("label"), F.col("answer").alias("text"))
    return c.unionByName(a)


def cases(segs: DataFrame) -> DataFrame:
    """Segments of the records whose label is missing or wrong, or which mix languages."""
    first = F.when(F.col("segment_no") == 1, F.col("lang"))
    segs = segs.filter("segment_no > 0")
    wrong = F.col("label").isNull() | (F.col("n_segments") > 1)
    # only a record of one segment can have a wrong label and nothing else, so each row decides alone
    hit = wrong | (first != F.col("label"))
    return segs.filter(hit).dropDuplicates(["record_kind", "record_id", "segment_no"])


def found(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """p3_found."""
    segs = segment(records(chunks, results), fit_on(chunks), MIN_WORDS)
    return cases(segs).select("record_kind", "record_id", F.col("segment_no"), "lang")


def record_segments(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Every record with its stretches in one language, each with a confidence; repeats of a record once."""
    segs = segment(records(chunks, results), fit_on(chunks)).dropDuplicates(["record_kind", "record_id", "segment_no"])
    return segs.select("record_kind", "record_id", "label", "segment_no", "lang", F.round("confidence", 6).alias("confidence"), "n_sentences", "n_chars")


def document_languages(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """One row for every record: main language (most characters), confidence and number of segments."""
    segs = segment(records(chunks, results), fit_on(chunks))
    main = F.max(F.struct("n_chars", (-F.col("segment_no")).alias("o"), "lang", "confidence", "label", "n_segments")).alias("m")
    one = segs.groupBy("record_kind", "record_id").agg(main)
    return one.select("record_kind", "record_id", "m.label", F.col("m.lang").alias("lang"), F.round("m.confidence", 6).alias("confidence"), "m.n_segments")
