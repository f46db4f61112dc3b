"""Structured Streaming forms: windowed telemetry, deduplicated deliveries, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.io import scratch


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's folder as a file stream, with the schema of the table."""
    path = f"{sf_dir}/{name}.parquet"
    # the pattern takes a single file as well as a folder of parts
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path}*")


def run_available(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now; each batch goes to `write`. The checkpoint lies in the shared folder."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", scratch(df.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def collected(df: DataFrame, mode: str) -> DataFrame:
    """The rows that a stream has put out once all input is read; in complete mode those of the last batch."""
    out = scratch(df.sparkSession, "out")
    spark, schema = df.sparkSession, df.schema

    def write(batch: DataFrame, n: int) -> None:
        # the batch number makes a repeated batch overwrite itself
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    run_available(df, mode, write)
    return spark.read.schema(schema).parquet(out).select(*df.columns)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and totals by window and type; later events than the watermark allows are dropped in append mode."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    g = e.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def first_deliveries(results: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Each result once, however often it is delivered within the horizon."""
    return results.withWatermark("ingested_at", horizon).dropDuplicatesWithinWatermark(["result_id"])
