"""Session, table and materialisation helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lattica", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) a temporary folder is made and set.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


_written: list[str] = []


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, unlike a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"lattica-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete what this session has materialised; results that still read it must be written before."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(df: DataFrame, key: str, fraction: float = 0.002) -> DataFrame:
    """Keys holding at least `fraction` of the rows: at most 1/fraction of them, so always small."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("__n") >= F.greatest(F.col("__t") * fraction, F.lit(2000))).select(key)


def lookup_join(df: DataFrame, unique: DataFrame, key: str, how: str = "inner", fraction: float = 0.002) -> DataFrame:
    """Join df with a frame that has one row per key, where some keys may hold a third of df's rows.

    Rows of hot keys (at most 1/fraction keys, a proven bound) meet a broadcast slice of `unique`;
    the others take an ordinary shuffled join.
    """
    hot = hot_keys(df, key, fraction).withColumn("__hot", F.lit(True))
    marked = df.join(F.broadcast(hot), key, "left")
    some = unique.join(F.broadcast(hot.select(key)), key, "left_semi")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(unique, key, how)
    warm = marked.filter(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(some), key, how)
    return cold.unionByName(warm)
