"""Problem 8: a training mix in which each source contributes its target share of all tokens.

Method: temperature mixing. Weights are w ~ t * (q / t)^(1 - a), from the natural shares q of the sources (a = 0) to
the target shares t (a = 1). The exponent a is bisected to the largest value at which no source passes its
repetition limit on the way to its target. One common exponent would hold all sources near their natural shares for the sake of
one small source, so the source that stops it is held at its limit and the exponent goes on for the others, until it reaches one
or every source is held: what remains keeps the proportions of the targets. The report states the exponent of each source.
temperature_mix has no targets to keep: w ~ q^a, with a bisected to a target
entropy or to the smallest value that keeps every source within its limit. All weights are realised as
budgeted block permutations: each source takes whole passes over its documents, and for the rest its blocks in a
hashed order up to the budget; only the block at the budget's edge is cut, document by document.

Tokens are counted with a public byte-pair vocabulary (`vocabulary` is the path of its ranks). Totals of sources
are frames of as many rows as there are targets, whose number is checked (MAX_SOURCES) before it is collected.

Defined results: documents without text have no tokens and are never drawn; sources without a target, and null
sources, are left out; targets without documents are reported with nothing reached; repeats of a doc_id count once.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize

MAX_SOURCES = 100_000
BLOCK_DOCS = 500
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 17


def vocabulary_path() -> str:
    """The default vocabulary file: LATTICA_TOKENIZER, or the public one of the machine."""
    return os.environ.get("LATTICA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), one row for each document."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": n})

    got = documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens long")
    return got.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def entropy(w: np.ndarray) -> float:
    p = w[w > 0]
    return float(-(p * np.log(p)).sum())


def bisect(ok, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent in [lo, hi] at which ok holds, where it holds from some point on."""
    if ok(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def tempered(q: np.ndarray, a: float) -> np.ndarray:
    """Shares q to the power of a, as shares."""
    w = np.where(q > 0, np.power(np.maximum(q, 1e-300), a), 0.0)
    return w / w.sum() if w.sum() else w


def exponent_for_entropy(q: np.ndarray, target: float) -> float:
    """The exponent whose weights have the target entropy (0 is uniform, 1 natural)."""
    return bisect(lambda a: entropy(tempered(q, a)) <= target)


def exponent_for_repeats(q: np.ndarray, budget: float, sizes: np.ndarray, repeats: np.ndarray) -> float:
    """The smallest exponent at which no source is drawn more often than its limit."""
    return bisect(lambda a: bool((tempered(q, a) * budget <= sizes * repeats + 1e-6).all()))


def towards(target: np.ndarray, q: np.ndarray, a: float) -> np.ndarray:
    """Weights between the natural shares q (a = 0) and the target shares (a = 1), as shares."""
    on = (target > 0) & (q > 0)
    w = np.zeros(len(q))
    w[on] = target[on] * np.power(q[on] / target[on], 1 - a)
    return w / w.sum() if w.sum() else w


def planned_tokens(target: np.ndarray, sizes: np.ndarray, repeats: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to draw from each source, and the exponent up to which its weight went towards the target."""
    cap = np.where(target > 0, sizes * repeats, 0.0)
    free = cap > 0
    give, exponent, at = np.zeros(len(sizes)), np.zeros(len(sizes)), 0.0
    while free.any():
        left = max(0.0, budget - cap[~free].sum())
        t, q = np.where(free, target, 0.0), np.where(free, sizes, 0.0)
        t, q = t / t.sum(), q / q.sum()
        give = np.where(free, t * left, cap)
        short = free & (give > cap * (1 + 1e-9))
        if not short.any():
            exponent[free] = 1.0
            break
        # the largest exponent that fits is one less the smallest distance from the targets that does
        at = 1 - bisect(lambda b: bool((towards(t, q, 1 - b) * left <= cap * (1 + 1e-9))[short].all()), 0.0, 1 - at)  # noqa: B023
        stop = short & (towards(t, q, at + 1e-6 * (1 - at)) * left >= cap * (1 - 1e-4))
        if not stop.any():
            stop = short
        exponent[stop] = at
        free &= ~stop
    return np.where(free, give, cap), exponent


def draw(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies): whole passes, and blocks in a hashed order for the rest of the budget.

    plan: (source, give, available). The order of blocks is settled on their totals, a small frame; a document's
    place inside the block at the edge by a window over that block alone, so no source is ever sorted whole.
    """
    t = tokens.filter("n_tokens > 0").join(F.broadcast(plan.filter("available > 0")), "source")
    t = t.withColumn("passes", F.floor(F.col("give") / F.col("available"))).withColumn("rest", F.col("give") - F.col("passes") * F.col("available"))
    t = t.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("blocks")))
    totals = t.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(SEED + 1)), "block")
    totals = totals.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.join(totals, ["source", "block"])
    whole = t.filter("upto <= rest").withColumn("extra", F.lit(1))
    none = t.filter("upto - size >= rest").withColumn("extra", F.lit(0))
    edge = t.filter("upto > rest AND upto - size < rest")
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(SEED + 2)), "doc_id")
    run = F.col("upto") - F.col("size") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the document over the edge is taken where that comes closer to the budget and its limit allows it
    edge = edge.withColumn("run", run).withColumn("extra", F.when((F.col("run") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("passes") < F.col("max_repeats")), 1).otherwise(0)).drop("run")
    got = whole.unionByName(none).unionByName(edge)
    return got.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).cast("int").alias("copies")).filter("copies > 0")


def source_sizes(tokens: DataFrame, targets: DataFrame) -> list:
    """Targets with the tokens and documents of their sources; their number is checked before they are collected."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    rows = t.join(sizes, "source", "left").fillna(0, ["available", "docs"]).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return rows


PLAN = "source string, target_share double, max_repeats int, available long, give double, natural_share double, blocks long, exponent double"


def planned(tokens: DataFrame, targets: DataFrame, budget: float | None = None, tempered_by: str | None = None) -> DataFrame:
    """The plan of each target source, with the tokens to draw from it (give).

    tempered_by: None for the given targets; "entropy" for w ~ q^a of the entropy of the targets; "repeats" for the
    flattest w ~ q^a within the repetition limits.
    """
    rows = source_sizes(tokens, targets)
    target = np.array([r.target_share or 0.0 for r in rows])
    target = target / target.sum() if target.sum() else target
    size = np.array([float(r.available) for r in rows])
    rep = np.array([float(r.max_repeats or 0) for r in rows])
    q = size / size.sum() if size.sum() else size
    total = min(float(budget if budget is not None else size[target > 0].sum()), float((size * rep)[target > 0].sum()))
    if tempered_by:
        total = min(float(budget if budget is not None else size.sum()), float((size * rep).sum()))
        a = exponent_for_entropy(q, entropy(target)) if tempered_by == "entropy" else exponent_for_repeats(q, total, size, rep)
        target = tempered(q, a)
        give, exponent = planned_tokens(target, size, rep, total)[0], np.full(len(rows), a)
    else:
        give, exponent = planned_tokens(target, size, rep, total)
    out = [(r.source, float(t), int(r.max_repeats or 0), int(r.available), float(g), float(w), max(1, math.ceil(r.docs / BLOCK_DOCS)), float(a)) for r, g, w, t, a in zip(rows, give, q, target, exponent)]
    return tokens.sparkSession.createDataFrame(out, PLAN)


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies) and its plan. budget: tokens of the mix, by default those of all target sources."""
    tokens = materialize(token_counts(documents, vocabulary), "tokens")
    plan = planned(tokens, targets, budget)
    return draw(tokens, plan), plan


def temperature_mix(documents: DataFrame, targets: DataFrame, by: str = "repeats", budget: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As mix, with the weights of a bisected exponent instead of given shares."""
    tokens = materialize(token_counts(documents, vocabulary), "tokens")
    plan = planned(tokens, targets, budget, by)
    return draw(tokens, plan), plan


def report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """For each target source: what it has, its plan, the exponent of its weight, tokens and share reached, most repeats,
    and whether the target is met: `met`, `below` or `above` by more than 0.001, `limited by repeats`, `no documents`."""
    own = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("documents_used"))
    got = plan.join(own, "source", "left").fillna(0, ["tokens", "most_copies", "documents_used"])
    one = Window.partitionBy(F.lit(1))  # one row for each source
    share = lambda c: F.when(F.sum(c).over(one) > 0, F.col(c) / F.sum(c).over(one)).otherwise(0.0)
    got = got.withColumn("reached_share", share("tokens")).withColumn("planned_share", share("give"))
    miss = F.col("reached_share") - F.col("target_share")
    limited = (F.col("give") >= F.col("available") * F.col("max_repeats") - 1) & (miss < -0.001)
    state = F.when(F.col("available") == 0, "no documents").when(limited, "limited by repeats").when(miss < -0.001, "below").when(miss > 0.001, "above").otherwise("met")
    shares = [F.round(c, 6).alias(c) for c in ("target_share", "natural_share", "planned_share", "reached_share", "exponent")]
    return got.select("source", *shares, "available", "tokens", "documents_used", "most_copies", "max_repeats", state.alias("status"))
