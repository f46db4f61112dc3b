"""Evaluation metrics, statistics and report aggregates as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % interval of a share, null without cases."""
    p, z2 = ratio(hits, n), Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query precision, recall, hit, nDCG, reciprocal rank and average precision of ranked (query, key, rank).

    The ideal of nDCG is cut at what was retrieved; AP counts all ranks; queries without relevant keys get zeros.
    """
    j = ranked.join(relevant.select("query", "key").distinct().withColumn("rel", F.lit(1)), ["query", "key"], "left").fillna(0, ["rel"])
    w = Window.partitionBy("query").orderBy("rank")
    j = j.withColumn("hits", F.sum("rel").over(w))
    n_rel = relevant.groupBy("query").agg(F.countDistinct("key").alias("n_rel"))
    top = F.col("rank") <= k
    got = j.groupBy("query").agg(
        F.sum(top.cast("int")).alias("n_top"),
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("top_hits"),
        F.sum(F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    got = got.join(n_rel, "query", "left").fillna(0, ["n_rel"])
    m = F.least("n_rel", "n_top")
    ideal = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return got.select(
        "query",
        zero(ratio(F.col("top_hits"), F.col("n_top"))).alias("precision"),
        zero(ratio(F.col("top_hits"), F.col("n_rel"))).alias("recall"),
        F.when(F.col("top_hits") > 0, 1).otherwise(0).alias("hit"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
        zero(1 / F.col("first")).alias("rr"),
        zero(ratio(F.col("ap_sum"), F.col("n_rel"))).alias("ap"),
    )


def token_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds precision, recall and F1 of the token multisets of array columns a and b, without leaving generated code."""
    distinct = F.array_distinct(F.col(a))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.aggregate(distinct, F.lit(0), lambda s, x: s + F.least(count(F.col(a), x), count(F.col(b), x)))
    p, r = ratio(common, F.size(a)), ratio(common, F.size(b))
    d = pairs.withColumn("common", common)
    return d.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0))).withColumn("f1", F.coalesce(harmonic(F.col("precision"), F.col("recall")), F.lit(0.0)))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int64)
    codes: dict[str, int] = {}
    y = np.array([codes.setdefault(w, len(codes)) for w in b])
    for x in a:
        if x not in codes:
            continue
        cand = np.where(y == codes[x], row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(cand, row[1:]))
    return int(row[-1])


def rouge_bleu(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """(key, rouge_l, bleu) of word arrays: dynamic programs that no built-in function has, in Arrow batches."""

    def bleu(c: list[str], r: list[str]) -> float:
        if not c or not r:
            return 0.0
        logs, orders = 0.0, min(4, len(c), len(r))
        for n in range(1, orders + 1):
            have: dict[tuple, int] = {}
            for i in range(len(r) - n + 1):
                g = tuple(r[i : i + n])
                have[g] = have.get(g, 0) + 1
            hit = 0
            for i in range(len(c) - n + 1):
                g = tuple(c[i : i + n])
                if have.get(g, 0) > 0:
                    have[g] -= 1
                    hit += 1
            if not hit:
                return 0.0
            logs += np.log(hit / (len(c) - n + 1))
        return float(min(1.0, np.exp(1 - len(r) / len(c))) * np.exp(logs / orders))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, c, r in zip(pdf[key], pdf[candidate], pdf[reference]):
                c, r = list(c) if c is not None else [], list(r) if r is not None else []
                n = lcs(c, r)
                p, q = (n / len(c) if c else 0.0), (n / len(r) if r else 0.0)
                rows.append((k, round(2 * p * q / (p + q), 6) if p + q else 0.0, round(bleu(c, r), 6)))
            yield pd.DataFrame(rows, columns=[key, "rouge_l", "bleu"])

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, candidate, reference).mapInPandas(run, f"{key} {kind}, rouge_l double, bleu double")


def resampled(values: DataFrame, key: str, value: str, groups: list[str], resamples: int = 100) -> DataFrame:
    """(groups, r, m): means of bootstrap resamples, with Poisson weights drawn from a hash of row and resample.

    Weights of different rows are independent, so each task adds up its own rows and only sums are shuffled: the
    resampling needs no group in one place. Both engines can draw the same weights.
    """
    r = values.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    sums = r.withColumn("w", weight).groupBy(*groups, "r").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.sum("w").alias("n")).filter("n > 0")
    return sums.select(*groups, "r", (F.col("s") / F.col("n")).alias("m"))


def hashed_bootstrap(values: DataFrame, group: str, key: str, value: str, resamples: int = 100) -> DataFrame:
    """(group, mean, lo, hi, n): 95 % bootstrap interval of the mean; see resampled."""
    v = values.filter(F.col(value).isNotNull()).select(group, key, value)
    ci = resampled(v, key, value, [group], resamples).groupBy(group).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    base = v.groupBy(group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return base.join(ci, base[group].eqNullSafe(ci[group])).select(base[group], "mean", "lo", "hi", "n")


def contrasts(values: DataFrame, unit: str, arm: str, value: str, base: str, resamples: int = 100) -> DataFrame:
    """(arm, effect, lo, hi, p): least squares effect of each arm against `base`, units as fixed effects, with a bootstrap
    of whole units.

    Cells of unit and arm are added up first. Each unit gives its share of the normal equations, weighted in each resample
    by a Poisson draw from a hash of the unit; the sums are as small as the square of the number of arms. Arms that
    share no unit with the others are left out; rows with a null anywhere are ignored.
    """
    v = values.select(F.col(unit).cast("string").alias("u"), F.col(arm).alias("a"), F.col(value).cast("double").alias("y")).dropna()
    cells = v.groupBy("u", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    own = cells.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("a", "n", "s"))).alias("c"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    left = own.select("u", F.col("n").alias("nu"), F.col("s").alias("su"), "c", F.explode("c").alias("x"))
    pairs = left.select("u", "nu", "su", "x", F.explode("c").alias("z"))
    # the equations of demeaned dummies: diag(n) - n n' / n_u on the left, s - n s_u / n_u on the right
    lhs = F.when(F.col("x.a") == F.col("z.a"), F.col("x.n")).otherwise(0) - F.col("x.n") * F.col("z.n") / F.col("nu")
    rhs = F.when(F.col("x.a") == F.col("z.a"), F.col("x.s") - F.col("x.n") * F.col("su") / F.col("nu")).otherwise(0.0)
    eq = pairs.select("u", F.col("x.a").alias("i"), F.col("z.a").alias("j"), lhs.alias("l"), rhs.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(resamples))).alias("r"))
    draw = F.pmod(F.xxhash64("u", "r"), F.lit(1 << 30)) / float(1 << 30)
    weight = F.when(F.col("r") == 0, 1).when(draw < 0.36787944, 0).when(draw < 0.73575888, 1).when(draw < 0.91969860, 2).when(draw < 0.98101184, 3).when(draw < 0.99634015, 4).otherwise(5)
    sums = eq.withColumn("w", weight).groupBy("r", "i", "j").agg(F.sum(F.col("w") * F.col("l")).alias("l"), F.sum(F.col("w") * F.col("b")).alias("b"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        arms = sorted(set(pdf.i))
        at = {a: k for k, a in enumerate(arms)}
        m, y = np.zeros((len(arms), len(arms))), np.zeros(len(arms))
        i, j = pdf.i.map(at).to_numpy(), pdf.j.map(at).to_numpy()
        m[i, j] = pdf.l
        np.add.at(y, i, pdf.b.to_numpy())
        if base not in at:
            return pd.DataFrame({"r": [], "arm": [], "effect": []})
        rest = [k for k in range(len(arms)) if k != at[base]]
        beta = np.linalg.lstsq(m[np.ix_(rest, rest)], y[rest], rcond=None)[0]
        return pd.DataFrame({"r": int(pdf.r.iloc[0]), "arm": [arms[k] for k in rest], "effect": beta})

    got = sums.groupBy("r").applyInPandas(solve, "r int, arm string, effect double")
    boot = F.col("r") > 0
    above = F.avg(F.when(boot, (F.col("effect") > 0).cast("int")))
    return got.groupBy("arm").agg(
        F.max(F.when(~boot, F.col("effect"))).alias("effect"),
        F.percentile(F.when(boot, F.col("effect")), 0.025).alias("lo"),
        F.percentile(F.when(boot, F.col("effect")), 0.975).alias("hi"),
        (2 * F.least(above, 1 - above)).alias("p"),
    )
