"""Problem 7: held-out test material inside training text.

Method: windows of the size of an item's field are embedded by the CGK random walk, which maps edit distance to
Hamming distance: the walk reads a word, writes its hash, and steps on or stays as a random bit of that word and step
says. Each repetition samples positions of the embedding; two windows that agree there meet in an equality
join. The number of repetitions follows from the target recall and the edits allowed. Every candidate is then
verified exactly.

Sizes: a field of at least 25 words leaks if a window of 25 of its words stands in the document; a shorter one is a
window itself and must stand there whole. Edits are in proportion, two for 25 words: so the near search has windows of
25, 13 and 8 words within 2, 1 and 0 edits (NEAR), the exact one windows of 25 (EXACT). Fields of fewer than
8 words are never near leaks. One walk serves the windows of all sizes that begin at a word.

Both sides take every window of every text. A bitmap of the item keys, sized by their counted number (see sieve), drops
document windows that meet no item; it can only let too many pass. Where it would pass BROADCAST_BYTES, the
keys of the documents meet those of the items in a shuffled join instead.

Defined results: null and short texts have no window; repeated items or documents count once; an item field
below the smallest window leaks nothing; extra columns are ignored. Words are longest runs of letters and digits in
lower case. A text that a third of all documents quotes gives its pairs (they are the result), each found once
for each document because the keys of a document are made distinct before the join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.common import materialize
from lattica.llm import sieve


class Size(NamedTuple):
    """Windows of `words` words within `edits` edits, met on `sampled` positions of their embedding."""

    words: int
    edits: int
    sampled: int


WINDOW = 25
# without edits every position may be sampled at no loss, which keeps texts of one template apart
EXACT = (Size(25, 0, 32),)
NEAR = (Size(25, 2, 12), Size(13, 1, 8), Size(8, 0, 12))
RECALL = 0.95
CELLS_EACH = (16.0, 8.0, 4.0)
SLICE_WORDS = 1 << 18
WORDS = re.compile(r"[^\W_]+")
KNOWN_LIMIT = 1_000_000


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Hashes(dict):
    """Word to 64-bit hash, kept up to a limit."""

    def __missing__(self, w: str) -> int:
        if len(self) > KNOWN_LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def repetitions(size: Size, recall: float = RECALL) -> int:
    """Repetitions after which a window within the edits meets its partner with probability `recall`.

    One edit costs the walk a few positions of its 3 x window steps until both walks meet again (four here).
    """
    if size.edits == 0:
        return 1
    same = max(0.05, 1 - 4.0 * size.edits / (2 * size.words)) ** size.sampled
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def embedding_keys(h: np.ndarray, starts: np.ndarray, rep: int, sizes: list[Size]) -> list[np.ndarray]:
    """The keys of the windows of each size: sampled positions of their CGK embeddings. h: word hashes, starts: first words."""
    # the walk is at word j/2 on average after j steps; positions beyond a window's end are padding
    want = [set(np.random.default_rng(1000 + 100 * s.words + rep).choice(2 * s.words, size=s.sampled, replace=False).tolist()) for s in sizes]
    bits = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (rep + 1) % (1 << 64)))
    bits2 = mix(bits + np.uint64(1))
    last = len(h)
    padded = np.r_[h, np.zeros(1, np.uint64)]
    pos = starts.astype(np.int64)
    keys = [np.full(len(starts), s.words, np.uint64) for s in sizes]
    for j in range(max(map(max, want)) + 1):
        for k, (s, w) in enumerate(zip(sizes, want)):
            if j in w:
                c = padded.take(np.where(pos < starts + s.words, pos, last), mode="clip")
                key = (keys[k] ^ c) * np.uint64(0x9DDFEA08EB382D69)
                keys[k] = key ^ (key >> np.uint64(29))
        step = ((bits if j < 64 else bits2) >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64)
        pos += step.take(pos, mode="clip")
    # keys of different repetitions never meet
    return [mix(k + np.uint64(rep)) for k in keys]


def parities(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64 parities of the words of each window, by the last bits of their hashes; an edit changes two of them at most."""
    run = np.r_[np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (h & np.uint64(63)))] if len(h) else np.zeros(1, np.uint64)
    return (run.take(starts + n, mode="clip") ^ run.take(starts, mode="clip")).view(np.int64)


def slices(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose word counts add up to about `limit`."""
    i = 0
    ends = np.cumsum(counts)
    while i < len(counts):
        base = ends[i - 1] if i else 0
        j = int(np.searchsorted(ends, base + limit, side="right"))
        yield i, max(i + 1, j)
        i = max(i + 1, j)


def window_starts(lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside the texts laid end to end, and the text that each is in."""
    n = np.maximum(lens - window + 1, 0)
    text = np.repeat(np.arange(len(lens)), n)
    first = np.cumsum(lens) - lens
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[text] + within, text


def item_fields(items: DataFrame) -> DataFrame:
    """(item_id, field, text) of the items' three fields."""
    parts = [items.select("item_id", F.lit(k).alias("field"), F.col(f).alias("text")) for k, f in enumerate(("question", "canonical_answer", "passage"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("text").isNotNull()).distinct()


def fitting(n_words: int, sizes: tuple[Size, ...]) -> int:
    """Which of the sizes, largest first, serves a field of so many words; -1 if none."""
    return next((k for k, s in enumerate(sizes) if n_words >= s.words), -1)


def edits_of(n_words: int, sizes: tuple[Size, ...]) -> int:
    """Word edits allowed in a window of n_words, in proportion to those of the largest size."""
    return sizes[0].edits * n_words // sizes[0].words


def item_keys(fields: DataFrame, sizes: tuple[Size, ...], recall: float = RECALL) -> DataFrame:
    """(key, item_id, field, start, parity, most), distinct: the keys of every window of every field, in the largest size that fits it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            ws = [words(t) for t in pdf.text]
            kind = np.array([fitting(len(w), sizes) for w in ws], dtype=np.int64)
            for k, size in enumerate(sizes):
                own = np.flatnonzero(kind == k)
                lens = np.array([len(ws[i]) for i in own], dtype=np.int64)
                ids, fs = pdf.item_id.to_numpy()[own], pdf.field.to_numpy()[own]
                for a, b in slices(lens, SLICE_WORDS):
                    h = np.array([hashes[w] for i in own[a:b] for w in ws[i]], dtype=np.uint64)
                    starts, text = window_starts(lens[a:b], size.words)
                    first = np.cumsum(lens[a:b]) - lens[a:b]
                    parity = parities(h, starts, size.words)
                    for rep in range(repetitions(size, recall)):
                        key = embedding_keys(h, starts, rep, [size])[0]
                        yield pd.DataFrame({"key": key.view(np.int64), "item_id": ids[a + text], "field": fs[a + text], "start": starts - first[text], "parity": parity, "most": 2 * size.edits})

    return fields.mapInPandas(run, "key long, item_id long, field int, start long, parity long, most int").distinct()


def document_windows(documents: DataFrame, sizes: tuple[Size, ...], recall: float, take, schema: str) -> DataFrame:
    """Rows that `take` makes of the windows of a slice of documents.

    take(ids, marks, words, lens, starts, text, keys): documents of the slice and their marks, all words laid end to
    end, words of each document, first word and document of each window, and for each repetition and size the keys with
    the windows that have them, and their parities.
    """
    reps = [repetitions(s, recall) for s in sizes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            ids, texts, marks = pdf.doc_id.to_numpy(), pdf.text.tolist(), pdf.marks.tolist()
            chars = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
            for a, b in slices(chars, SLICE_WORDS * 6):
                ws = [words(t) for t in texts[a:b]]
                lens = np.array([len(w) for w in ws], dtype=np.int64)
                flat = [w for t in ws for w in t]
                h = np.fromiter(map(hashes.__getitem__, flat), dtype=np.uint64, count=len(flat))
                starts, text = window_starts(lens, sizes[-1].words)
                if not len(starts):
                    continue
                room = np.cumsum(lens)[text] - starts
                fits = [None if k == len(sizes) - 1 else np.flatnonzero(room >= s.words) for k, s in enumerate(sizes)]

                parity = [parities(h, starts, s.words) for s in sizes]

                def keys() -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
                    for rep in range(max(reps)):
                        on = [k for k in range(len(sizes)) if rep < reps[k]]
                        for k, key in zip(on, embedding_keys(h, starts, rep, [sizes[k] for k in on])):
                            yield (key, None, parity[k]) if fits[k] is None else (key[fits[k]], fits[k], parity[k][fits[k]])

                yield from take(ids[a:b], marks[a:b], flat, lens, starts, text, keys())

    if "marks" not in documents.columns:
        documents = documents.select("doc_id", "text", F.lit(None).cast("array<long>").alias("marks"))
    return documents.select("doc_id", "text", "marks").mapInPandas(run, schema)


def stretches(documents: DataFrame, sizes: tuple[Size, ...], recall: float, held=None, blocks: int = 0) -> DataFrame:
    """(doc_id, stretch, keys, ats, parities, text): runs of document windows that may meet an item, with their words.

    ats: the first words of the windows of the keys, counted in text.

    Windows are kept by the bitmap `held`, or where it is None by the column `marks` (their places in the document).
    """
    # a field may be longer than its window, up to the largest size
    slack = sizes[0].edits + (sizes[0].words if len(sizes) > 1 else 0)

    def take(ids, marks, flat, lens, starts, text, keys):
        first = np.cumsum(lens) - lens
        if held is None:
            some = [np.sort(np.asarray(m, dtype=np.int64)) + f for m, f in zip(marks, first)]
            marked = np.isin(starts, np.concatenate(some))
        bits = None if held is None else held.value
        win, key, par = [], [], []
        for k, at, parity in keys:
            ok = np.flatnonzero(sieve.passes(k, bits, blocks) if bits is not None else (marked if at is None else marked[at]))
            win.append(ok if at is None else at[ok])
            key.append(k[ok])
            par.append(parity[ok])
        win, key, par = np.concatenate(win), np.concatenate(key), np.concatenate(par)
        if not len(win):
            return
        order = np.argsort(win, kind="stable")
        win, key, par = win[order], key[order], par[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(starts[win]) > 1) | (np.diff(text[win]) > 0)])
        rows = []
        for c, e in zip(cut.tolist(), [*cut[1:].tolist(), len(win)]):
            t = int(text[win[c]])
            lo = max(int(starts[win[c]]) - slack, int(first[t]))
            hi = min(int(starts[win[e - 1]]) + sizes[0].words + slack, int(first[t] + lens[t]))
            rows.append((ids[t], int(starts[win[c]] - first[t]), key[c:e].view(np.int64).tolist(), (starts[win[c:e]] - lo).tolist(), par[c:e].tolist(), " ".join(flat[lo:hi])))
        yield pd.DataFrame(rows, columns=["doc_id", "stretch", "keys", "ats", "parities", "text"])

    return document_windows(documents, sizes, recall, take, "doc_id long, stretch long, keys array<long>, ats array<long>, parities array<long>, text string")


def met_by_shuffle(documents: DataFrame, keys: DataFrame, sizes: tuple[Size, ...], recall: float) -> DataFrame:
    """documents with `marks`, the windows whose key an item has, where the bitmap of the items is too large to send."""

    def take(ids, marks, flat, lens, starts, text, keys):
        first = np.cumsum(lens) - lens
        for k, at, _ in keys:
            t = text if at is None else text[at]
            yield pd.DataFrame({"key": k.view(np.int64), "doc_id": ids[t], "at": (starts if at is None else starts[at]) - first[t]})

    every = document_windows(documents, sizes, recall, take, "key long, doc_id long, at long")
    hit = every.join(keys.select("key").distinct(), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("marks"))
    return documents.select("doc_id", "text").join(hit, "doc_id")


def within(seg: np.ndarray, n: np.ndarray, edits: np.ndarray, region: np.ndarray, most: int) -> np.ndarray:
    """Whether the first n words of each row of seg are within `edits` edits of a stretch of its region.

    Word i of seg stands against word i + most of the region, give or take `most`. reach[e, d] is the number of words
    of seg, up to the last one read, that an alignment with e edits covers and that ends on diagonal d.
    """
    rows = len(seg)
    reach = np.zeros((most + 1, 2 * most + 1, rows), np.int16)
    out = np.zeros(rows, bool)
    for i in range(int(n.max()) if rows else 0):
        new = np.zeros_like(reach)
        for e in range(most + 1):
            for d in range(2 * most + 1):
                best = np.where(seg[:, i] == region[:, i + d], reach[e, d] + 1, 0)
                if e:
                    best = np.maximum(best, reach[e - 1, d] + 1)  # another word
                    if d < 2 * most:
                        best = np.maximum(best, reach[e - 1, d + 1] + 1)  # a word lost
                    if d:
                        best = np.maximum(best, new[e - 1, d - 1])  # a word more
                new[e, d] = best
        reach = new
        full = reach.max(axis=1) > i
        out |= (n == i + 1) & full[np.minimum(edits, most), np.arange(rows)]
    return out


def verified(items: list[list[str]], docs: list[list[str]], starts: list, ats: list, sizes: tuple[Size, ...]) -> np.ndarray:
    """For each pair of an item field and a stretch, met at the windows starts and ats, whether one of them holds."""
    longest, most = sizes[0].words, sizes[0].edits
    if not most:
        # windows that met are nearly always equal, so the first comparison settles a pair
        return np.array([any(i[s : s + longest] == d[q : q + longest] for s, q in zip(ss, qs)) for i, d, ss, qs in zip(items, docs, starts, ats)], dtype=bool)
    owner, seg, region, size = [], [], [], []
    for k, (item, doc, ss, qs) in enumerate(zip(items, docs, starts, ats)):
        code: dict[str, int] = {}
        x = np.array([code.setdefault(w, len(code)) for w in item], dtype=np.int32)
        y = np.full(len(doc) + 2 * (longest + most), -1, np.int32)
        y[longest + most : longest + most + len(doc)] = [code.get(w, -1) for w in doc]
        ss, qs = np.asarray(ss, dtype=np.int64), np.asarray(qs, dtype=np.int64)
        n = min(len(item), longest)
        if len(item) < longest:
            qs = np.unique(qs - ss)  # the whole field, wherever its windows were met
            ss = np.zeros(len(qs), np.int64)
        ok = (qs >= -longest) & (qs <= len(doc))
        ss, qs = ss[ok], qs[ok]
        part = np.full((len(ss), longest), -2, np.int32)
        part[:, :n] = x[ss[:, None] + np.arange(n)]
        seg.append(part)
        region.append(y[qs[:, None] + longest + np.arange(longest + 2 * most)])
        owner.append(np.full(len(ss), k))
        size.append(np.full(len(ss), n))
    out = np.zeros(len(items), bool)
    if owner:
        o, n = np.concatenate(owner), np.concatenate(size)
        edits = np.array([edits_of(k, sizes) for k in range(longest + 1)])[n]
        out[o[within(np.concatenate(seg), n, edits, np.concatenate(region), most)]] = True
    return out


def find(documents: DataFrame, items: DataFrame, sizes: tuple[Size, ...] = EXACT, recall: float = RECALL) -> DataFrame:
    """(item_id, doc_id, field): each item field of which the document holds a window, within the edits of its size."""
    fields = materialize(item_fields(items), "fields")
    keys = materialize(item_keys(fields, sizes, recall), "itemkeys")
    n = keys.count()
    blocks = next((b for c in CELLS_EACH if sieve.size_of(b := sieve.blocks_for(n, c)) <= sieve.BROADCAST_BYTES), 0)
    if blocks:
        parts = sieve.parts_of(keys.select("key"), lambda pdf: iter([pdf["key"].to_numpy().view(np.uint64)]), blocks)
        some = stretches(documents, sizes, recall, documents.sparkSession.sparkContext.broadcast(sieve.merged(parts, blocks, 1)), blocks)
    else:
        some = stretches(met_by_shuffle(documents, keys, sizes, recall), sizes, recall)
    some = materialize(some, "stretches")
    met = some.select("doc_id", "stretch", F.explode(F.arrays_zip("keys", "ats", "parities")).alias("z")).select("doc_id", "stretch", F.col("z.keys").alias("key"), F.col("z.ats").alias("at"), F.col("z.parities").alias("p"))
    # windows that meet in several repetitions, and the windows of one diagonal of a short field, count once
    # parities tell apart, before anything is compared, windows that differ in more than the edits
    near_enough = met.join(keys, "key").filter(F.bit_count(F.col("p").bitwiseXOR(F.col("parity"))) <= F.col("most"))
    meet = near_enough.groupBy("doc_id", "stretch", "item_id", "field").agg(F.collect_set(F.struct("start", "at")).alias("met"))
    pairs = meet.join(some.select("doc_id", "stretch", "text"), ["doc_id", "stretch"]).join(fields.withColumnRenamed("text", "item_text"), ["item_id", "field"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                known = {t: words(t) for t in set(part.item_text)}
                ok = verified([known[t] for t in part.item_text], [t.split(" ") for t in part.text], part.starts.tolist(), part.ats.tolist(), sizes)
                yield part.loc[ok, ["item_id", "doc_id", "field"]]

    pairs = pairs.select("item_id", "doc_id", "field", "item_text", "text", F.col("met.start").alias("starts"), F.col("met.at").alias("ats"))
    return pairs.mapInPandas(verify, "item_id long, doc_id long, field int").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found."""
    return find(documents, items).select("item_id", "doc_id").distinct()


def near(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_near: (item_id, doc_id, field) within the edits of NEAR."""
    return find(documents, items, NEAR)
