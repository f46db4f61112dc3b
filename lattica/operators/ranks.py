"""Ranks, running totals and exact quantiles of large groups, without bringing a group into one task.

Rows are cut into ranges of the sort order; each range is summed on its own, and the ranges of a group meet as one
row each. Equal values are counted before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import materialize

BEFORE = Window.unboundedPreceding, -1


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys that may be null; the keys come out once, from a."""
    held = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    if not keys:
        return a.crossJoin(F.broadcast(held))  # b has one row
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(held, on, how).drop(*[f"__{k}" for k in keys])


def running(rows: DataFrame, groups: list[str], by: list[str], amount: str = "n") -> DataFrame:
    """rows with `before`, the sum of amount over the rows of the group that sort earlier. Sort keys are distinct in a group."""
    cut = materialize(rows.repartitionByRange(*groups, *by).withColumn("range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*groups, "range").agg(F.sum(amount).alias("total"))
    order = Window.partitionBy(*groups or [F.lit(1)]).orderBy("range").rowsBetween(*BEFORE)
    totals = totals.select(*groups, "range", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("start"))
    own = Window.partitionBy(*groups, "range").orderBy(*by).rowsBetween(*BEFORE)
    cut = cut.withColumn("own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return same(cut, totals, [*groups, "range"]).withColumn("before", F.col("start") + F.col("own")).drop("range", "own", "start")


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n, before, total): how often each value stands, how many are smaller, how many there are."""
    counts = running(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), groups, [value])
    return same(counts, counts.groupBy(*groups).agg(F.sum("n").alias("total")), groups)


def quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(groups, a column for each of qs): exact quantiles, between neighbouring values where they fall between two."""
    c = value_counts(df, groups, value)

    def at(k):
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))

    def quantile(q: float):
        pos = (F.col("total") - 1) * F.lit(q)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        return lo + (hi - lo) * F.max(pos - F.floor(pos))

    return c.groupBy(*groups).agg(*[quantile(q).alias(name) for name, q in qs.items()])


def tie_ranks(df: DataFrame, value: str, out: str, groups: list[str]) -> DataFrame:
    """df with the average rank of each row's value in its group, as Spearman needs it; null values have none."""
    c = value_counts(df, groups, value).select(*groups, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return same(df, c, [*groups, value], "left")


def numbered(df: DataFrame, groups: list[str], by: list[str], out: str) -> DataFrame:
    """df with the number of each row in its group, from 1; the sort keys are distinct in a group."""
    return running(df.withColumn("__one", F.lit(1)), groups, by, "__one").withColumn(out, F.col("before") + 1).drop("before", "__one")
