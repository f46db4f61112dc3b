"""Problem 2: percentiles of very large numeric columns, with a stated and certified rank error.

Method: merging centroid digests. Sorted values are cut into clusters by a size function of the quantile
(k(q) = delta / (2 pi) * asin(2 q - 1): small clusters at the tails, large ones in the middle); digests are
merged by clustering their centroids again, so those of partitions or days combine into those of longer
periods. A second pass over the values counts how many lie below each estimate and certifies its rank error.

Digests are rows (group columns, mean, weight): each task makes one for every group that it sees, and they are
merged in two levels, so a group with a third of all rows never meets in one task. Estimates whose counted
error exceeds the bound are made again from digests of twice the size; `certified` states the outcome.

Defined results: null, NaN, infinite and negative values are ignored; a group without values gives no row;
equal values are one plateau of ranks, and any rank in the plateau is right for it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
RANK_ERROR = 0.002
DELTA = 400
FAN_IN = 16
HELD_ROWS = 500_000
MAX_GROUPS = 100_000


def cluster(code: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the weighted values of each group (by code) into clusters whose size follows the quantile; all groups at once."""
    if not len(mean):
        return code, mean, weight
    order = np.lexsort((mean, code))
    g, m, w = code[order], mean[order], weight[order]
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[heads, len(g)])
    total = np.add.reduceat(w, heads)
    run = np.cumsum(w)
    before = np.repeat(run[heads] - w[heads], sizes)
    q = (run - before - w / 2) / np.repeat(total, sizes)
    k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)) + delta / 4).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    ws = np.add.reduceat(w, starts)
    return g[starts], np.add.reduceat(m * w, starts) / ws, ws


def merge_in_task(parts: DataFrame, groups: list[str], delta: int) -> DataFrame:
    """One digest for each group of each task, from rows (groups, mean, weight)."""
    schema = ", ".join(f"`{g}` {t}" for g, t in parts.select(*groups).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[tuple, int] = {}
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for pdf in batches:
            at = pdf.groupby(groups, dropna=False, sort=False)
            number = at.ngroup().to_numpy()
            heads = pdf.iloc[np.unique(number, return_index=True)[1]][groups]
            own = [codes.setdefault(tuple(None if pd.isna(v) else v for v in key), len(codes)) for key in heads.itertuples(index=False)]
            new = (np.array(own, dtype=np.int64)[number], pdf["mean"].to_numpy(dtype=float), pdf["weight"].to_numpy(dtype=float))
            held = tuple(np.concatenate(x) for x in zip(held, new))
            if len(held[0]) > HELD_ROWS:
                held = cluster(*held, delta)
        c, m, w = cluster(*held, delta)
        keys = list(codes)
        out = pd.DataFrame({g: pd.Series([keys[i][k] for i in c], dtype=object) for k, g in enumerate(groups)})
        yield out.assign(mean=m, weight=w)

    return parts.select(*groups, "mean", "weight").mapInPandas(run, f"{schema}, mean double, weight double")


def valid(value: str) -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))


def digests(values: DataFrame, groups: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """Digests of the groups: rows (groups, mean, weight), at most about `delta` for each group."""
    rows = values.filter(valid(value)).select(*groups, F.col(value).cast("double").alias("mean"), F.lit(1.0).alias("weight"))
    return combine(merge_in_task(rows, groups, delta), groups, delta)


def combine(parts: DataFrame, groups: list[str], delta: int = DELTA) -> DataFrame:
    """Digests of a longer period from those of its days or partitions; `groups` are the columns that stay.

    The parts of a group are merged in FAN_IN heaps first, then the heaps.
    """
    salted = parts.repartition(*groups, F.spark_partition_id() % FAN_IN)
    once = merge_in_task(salted, groups, delta)
    return merge_in_task(once.repartition(*groups), groups, delta)


def estimates(parts: DataFrame, groups: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(groups, q, estimate): values at the quantiles, between the centres of neighbouring clusters."""
    schema = ", ".join(f"`{g}` {t}" for g, t in parts.select(*groups).dtypes)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        _, m, w = cluster(np.zeros(len(pdf), np.int64), pdf["mean"].to_numpy(), pdf["weight"].to_numpy(), 1 << 30)
        centre = (np.cumsum(w) - w / 2) / w.sum()
        head = pdf.iloc[:1][groups]
        return pd.concat([head] * len(qs), ignore_index=True).assign(q=list(qs), estimate=np.interp(qs, centre, m))[[*groups, "q", "estimate"]]

    return parts.groupBy(*groups).applyInPandas(read, f"{schema}, q double, estimate double")


def certify(values: DataFrame, est: DataFrame, groups: list[str], value: str, bound: float = RANK_ERROR) -> DataFrame:
    """Count the values below and at each estimate, and compare the ranks with the quantile.

    Each row meets only its place among its group's estimates: the rows of a group and place are counted map-side,
    and the few counts are added up by a running sum. Adds n, below, upto, rank_error and certified.
    """
    null_safe = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"k{i}") for i, g in enumerate(groups)]
    keys = [f"k{i}" for i in range(len(groups))]
    lists = est.groupBy(*null_safe).agg(F.array_sort(F.collect_list("estimate")).alias("marks"))
    v = values.filter(valid(value)).select(*null_safe, F.col(value).alias("v"))
    if est.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS:
        lists = F.broadcast(lists)  # its size was just checked
    placed = v.join(lists, keys).select(
        *keys,
        F.size(F.filter("marks", lambda m: m < F.col("v"))).alias("lt"),
        F.size(F.filter("marks", lambda m: m <= F.col("v"))).alias("le"),
    )
    counts = placed.groupBy(*keys, "lt", "le").agg(F.count(F.lit(1)).alias("c"))
    e = est.select("*", *null_safe).withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy("estimate")))
    # v < mark number p exactly when fewer than p marks are <= v; v <= mark number p when fewer than p are < v
    c = counts.withColumnRenamed("lt", "n_lt").withColumnRenamed("le", "n_le")
    got = e.join(c, keys).groupBy(*groups, "q", "estimate").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("n_le") < F.col("place"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("n_lt") < F.col("place"), F.col("c")).otherwise(0)).alias("upto"),
    )
    target = F.col("q") * F.col("n")
    err = F.greatest(F.lit(0.0), F.col("below") - target, target - F.col("upto")) / F.col("n")
    return got.withColumn("rank_error", err).withColumn("certified", F.col("rank_error") <= F.greatest(F.lit(bound), 1.0 / F.col("n")))


def percentiles(values: DataFrame, groups: list[str], value: str, qs: tuple[float, ...] = QUANTILES, bound: float = RANK_ERROR, parts: DataFrame | None = None, tries: int = 3) -> DataFrame:
    """Certified percentiles of each group; groups that miss the bound are done again with larger digests."""
    delta, out, todo = DELTA, None, values
    for k in range(tries):
        parts = parts if parts is not None else digests(todo, groups, value, delta)
        got = materialize(certify(todo, materialize(estimates(parts, groups, qs), "estimates"), groups, value, bound), "certified")
        missed = got.filter(~F.col("certified")).select(*groups).distinct()
        if k == tries - 1 or not missed.limit(1).count():
            return got if out is None else out.unionByName(got)
        same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        done = got.alias("a").join(missed.alias("b"), same, "left_anti")
        out = done if out is None else out.unionByName(done)
        todo = todo.alias("a").join(missed.alias("b"), same, "left_semi")
        delta, parts = delta * 2, None
    return out


def preset(col: Column) -> Column:
    """The strategy preset meant by a spelling of its name."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def latencies(results: DataFrame) -> DataFrame:
    """One row for each result: strategy preset, day of start, latency."""
    one = results.select("result_id", "strategy", "started_at", "latency_ms").groupBy("result_id").agg(F.min(F.struct("strategy", "started_at", "latency_ms")).alias("r"))
    return one.select(preset(F.col("r.strategy")).alias("strategy"), F.to_date("r.started_at").alias("day"), F.col("r.latency_ms").alias("latency_ms"))


def whole_period(results: DataFrame) -> DataFrame:
    """Percentiles of each strategy over all days, from the combined digests of single days."""
    v = materialize(latencies(results), "latencies")
    daily = materialize(digests(v, ["strategy", "day"], "latency_ms"), "daily")
    return percentiles(v, ["strategy"], "latency_ms", parts=combine(daily, ["strategy"]))


def days_and_whole(results: DataFrame) -> DataFrame:
    """Percentiles of each strategy by day, and over all days (day null) from the combined digests of the days."""
    v = materialize(latencies(results), "latencies")
    daily = materialize(digests(v, ["strategy", "day"], "latency_ms"), "daily")
    whole = percentiles(v, ["strategy"], "latency_ms", parts=combine(daily, ["strategy"])).withColumn("day", F.lit(None).cast("date"))
    return percentiles(v, ["strategy", "day"], "latency_ms", parts=daily).unionByName(whole)
