"""Problem 9: long spans that occur word for word in more than one document.

Method: count-min prefilter and exact grouping. A window of `window` characters stands for its anchor, the
smallest hash among the `gram`-character pieces inside it; equal windows have equal anchors, so the count of an
anchor is at least that of every window it stands for. Each partition counts its anchors (once for each document);
the merged sketch overestimates, never under. A second pass keeps only stretches of windows whose anchor the sketch
counts twice or more, and groups them exactly:

* a stretch (all neighbouring windows with one anchor) whose whole text occurs in two documents is shared;
* of the other stretches of an anchor, single windows are grouped by their text; a stretch text seen in many
  documents goes into that once, so a line copied into a third of all documents costs its contexts only.

The sketch follows the counted characters of the table (CELLS_EACH cells a row for each anchor to be expected), so
that a few per cent of the anchors pass that occur in one document only, whatever the size. Up to BROADCAST_BYTES
(see sieve) it is sent to the tasks, which drop the other stretches at once; beyond, its blocks stay where they are,
and the stretches meet the repeated anchors in a shuffled join.

No pairs are built, nothing is sampled or capped. Texts are compared by 128-bit hashes of the exact characters.

Defined results: null texts and texts shorter than a window have no span; repeats of a row (equal doc_id) are one
document; a text that repeats inside one document only is not shared; extra columns are ignored. Positions
count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize
from lattica.llm import sieve
from lattica.llm.sieve import mix

WINDOW = 200
GRAM = 100
CELLS_EACH = 4.0
SLICE_CHARS = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240901)
LETTERS = _RNG.integers(1, 1 << 63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any piece follows: see piece_hash."""
    up, _ = POWERS.get(len(codes) + 1)
    v = LETTERS[codes & np.uint32(0xFFFF)] ^ (codes >> np.uint32(16)).astype(np.uint64)
    return np.r_[np.uint64(0), np.cumsum(v * up[: len(codes)], dtype=np.uint64)]


def piece_hash(sums: np.ndarray, at: np.ndarray | None, n: np.ndarray | int) -> np.ndarray:
    """Hashes of pieces of n code points at places `at` (all places if None), equal for equal text anywhere."""
    _, down = POWERS.get(len(sums))
    if at is None:
        k = max(0, len(sums) - n)
        return mix((sums[n:] - sums[:k]) * down[:k])
    return mix((sums[at + n] - sums[at]) * down[at])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.r_[x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n], pre[w - 1 : w - 1 + n])


def pieces(ids: np.ndarray, texts: list[str | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """The texts in slices laid end to end: (document of each text part, its offset in the document, its start, joined text).

    A long text is cut into parts that overlap by window - 1, so each of its windows lies in one part.
    """
    docs, offs, parts, size = [], [], [], 0
    step = max(SLICE_CHARS, 4 * window)
    for i, t in zip(ids, texts):
        if not t or len(t) < window:
            continue
        for o in range(0, len(t) - window + 1, step):
            part = t[o : o + step + window - 1] if len(t) > step + window - 1 else t
            docs.append(i)
            offs.append(o)
            parts.append(part)
            size += len(part)
            if size >= step:
                yield _laid(docs, offs, parts)
                docs, offs, parts, size = [], [], [], 0
            if part is t:
                break
    if parts:
        yield _laid(docs, offs, parts)


def _laid(docs: list, offs: list, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    lens = np.array([len(p) for p in parts], dtype=np.int64)
    return np.array(docs), np.array(offs, dtype=np.int64), np.r_[0, np.cumsum(lens)], "".join(parts)


def anchored(starts: np.ndarray, text: str, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: (anchor, first window, windows, part), and the prefix sums."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sums = prefix_sums(codes)
    low = sliding_min(piece_hash(sums, None, gram), window - gram + 1)
    part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(low)]
    # a window must end inside its part
    ok = np.arange(len(low)) + window <= starts[part + 1]
    at = np.flatnonzero(ok)
    a = low[at]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (np.diff(at) > 1)])
    first = at[cut]
    n = np.diff(np.r_[cut, len(at)])
    return a[cut], first, n, part[first], sums


def anchors_of(pdf: pd.DataFrame, window: int, gram: int) -> Iterator[np.ndarray]:
    """The anchors of the documents of a batch, once for each document."""
    for docs, _, starts, text in pieces(pdf.doc_id.to_numpy(), pdf.text.tolist(), window):
        anchor, _, _, part, _ = anchored(starts, text, window, gram)
        order = np.lexsort((anchor, docs[part]))
        a, d = anchor[order], docs[part][order]
        yield a[np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])][: len(a)]]


def expected_anchors(documents: DataFrame, window: int, gram: int) -> int:
    """Anchors to be expected from the counted windows: the smallest of m hashes changes about twice in m + 1 steps."""
    n = documents.agg(F.sum(F.length("text") - (window - 1))).first()[0] or 0
    return int(n * 2 / (window - gram + 2)) + 1


def stretch_rows(pdf: pd.DataFrame, window: int, gram: int, keep_if) -> Iterator[pd.DataFrame]:
    """(anchor, h1, h2, n, doc_id, at) of the stretches of a batch; h1, h2: 128-bit hash of the text."""
    for docs, offs, starts, text in pieces(pdf.doc_id.to_numpy(), pdf.text.tolist(), window):
        anchor, first, n, part, sums = anchored(starts, text, window, gram)
        keep = keep_if(anchor)
        if not keep.any():
            continue
        anchor, first, n, part = anchor[keep], first[keep], n[keep], part[keep]
        h1, h2 = text_hash(sums, first, n + window - 1)
        yield pd.DataFrame({"anchor": anchor.view(np.int64), "h1": h1, "h2": h2, "n": n.astype(np.int32), "doc_id": docs[part], "at": offs[part] + first - starts[part]})


def text_hash(sums: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of pieces, as two longs."""
    half = size // 2
    h2 = mix(piece_hash(sums, at, half) * np.uint64(3) + piece_hash(sums, at + half, size - half))
    return piece_hash(sums, at, size).view(np.int64), h2.view(np.int64)


STRETCH = "anchor long, h1 long, h2 long, n int, doc_id long, at long"


def candidates(documents: DataFrame, window: int, gram: int, cells_each: float = CELLS_EACH) -> DataFrame:
    """(anchor, h1, h2, n, doc_id, at): stretches whose anchor the sketch counts twice or more."""
    blocks = sieve.blocks_for(expected_anchors(documents, window, gram), cells_each)
    parts = sieve.parts_of(documents, lambda pdf: anchors_of(pdf, window, gram), blocks)
    if sieve.size_of(blocks) > sieve.BROADCAST_BYTES:
        every = documents.mapInPandas(lambda batches: (x for pdf in batches for x in stretch_rows(pdf, window, gram, lambda a: np.ones(len(a), bool))), STRETCH)
        return every.join(sieve.repeated_keys(parts).withColumnRenamed("key", "anchor"), "anchor", "left_semi")
    held = documents.sparkSession.sparkContext.broadcast(sieve.merged(parts, blocks, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for pdf in batches:
            yield from stretch_rows(pdf, window, gram, lambda a: sieve.passes(a, bits, blocks))

    return documents.mapInPandas(run, STRETCH)


SLICE_WINDOWS = 1 << 20
REP = ("at", "n", "h1", "h2", "lo", "hi")


WINDOW_KINDS = {"w1": np.int64, "w2": np.int64, "h1": np.int64, "h2": np.int64, "lo": np.int64, "hi": np.int64, "i": np.int32}


def windows_of(pdf: pd.DataFrame, window: int) -> Iterator[pd.DataFrame]:
    """The windows of the stretches of a batch of texts; short texts share a frame, since each frame has a cost of its own."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for text, *own in zip(pdf.text, *(pdf[k] for k in REP)):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sums = prefix_sums(codes)
        at, n, h1, h2, lo, hi = (np.asarray(x, dtype=np.int64) for x in own)
        ends = np.cumsum(n)
        for s in range(0, int(ends[-1]), SLICE_WINDOWS):
            w = np.arange(s, min(s + SLICE_WINDOWS, int(ends[-1])))
            row = np.searchsorted(ends, w, side="right")
            i = w - (ends - n)[row]
            held.append((*text_hash(sums, at[row] + i, window), h1[row], h2[row], lo[row], hi[row], i))
            size += len(w)
            if size >= SLICE_WINDOWS // 8:
                yield _framed(held)
                held, size = [], 0
    if held:
        yield _framed(held)


def _framed(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate(x).astype(t, copy=False) for (k, t), x in zip(WINDOW_KINDS.items(), zip(*held))})


def single_windows(texts: DataFrame, window: int) -> DataFrame:
    """(w1, w2, h1, h2, lo, hi, i): the windows of the stretches `reps` of each text, with a 128-bit hash of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from windows_of(pdf, window)

    return texts.select("text", *[F.col("reps")[k].alias(k) for k in REP]).mapInPandas(run, "w1 long, w2 long, h1 long, h2 long, lo long, hi long, i int")


def shared_intervals(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, cells_each: float = CELLS_EACH) -> DataFrame:
    """(doc_id, s, e): intervals of windows that occur in another document; they may overlap."""
    docs = documents.select("doc_id", "text").filter(F.length("text") >= window)
    cand = materialize(candidates(docs, window, gram, cells_each), "stretches")
    # one row for each text, with the first place where it stands; equal texts have equal anchors
    key = ["h1", "h2"]
    texts = cand.groupBy("anchor", *key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("n").alias("n"), F.min(F.struct("doc_id", "at")).alias("p"))
    texts = materialize(texts.select("anchor", *key, "lo", "hi", "n", F.col("p.doc_id").alias("doc_id"), F.col("p.at").alias("at")), "texts")
    # texts of an anchor that only one text holds, or only one document, share nothing more
    per = texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("a"), F.max("hi").alias("b"), F.max((F.col("lo") == F.col("hi")).cast("int")).alias("single"))
    reps = texts.join(per.filter("c > 1 AND a <> b AND single = 1").select("anchor"), "anchor", "left_semi")
    own = reps.groupBy("doc_id").agg(F.collect_list(F.struct(*REP)).alias("reps"))
    wins = materialize(single_windows(docs.join(own, "doc_id"), window), "windows")
    many = wins.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).filter("l <> u").select("w1", "w2")
    hit = wins.filter("lo = hi").join(many, ["w1", "w2"], "left_semi").select(*key, "i").distinct()
    runs = hit.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i")))
    some = runs.groupBy(*key, "g").agg(F.min("i").alias("a"), F.max("i").alias("b")).select(*key, "a", "b")
    # a text in two documents is shared whole; of one that stands in a single document, the windows found
    whole = texts.filter("lo <> hi").select(*key, F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    got = cand.select(*key, "doc_id", "at").join(whole.unionByName(some), key)
    return got.select("doc_id", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b") + window).alias("e"))


def stretches(intervals: DataFrame) -> DataFrame:
    """Maximal stretches (doc_id, span_start, span_end): overlapping or touching intervals of a document as one."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.distinct().withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    marked = marked.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("doc_id", "k").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("k")


def found(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """p9_found."""
    return stretches(shared_intervals(documents, window, gram)).select("doc_id", "span_start", "span_end")


def shares(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document its characters, how many of them are shared, in how many stretches, and the share."""
    own = found(documents, window).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    every = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    got = every.join(own, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return got.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
