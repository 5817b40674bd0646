"""Streams of messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.session import ship


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_counts(events: DataFrame, ts: str, late: str = "2 days") -> DataFrame:
    """``day, n`` of a stream; rows that come later than ``late`` are dropped and the state of a day with them."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def busy_minutes(events: DataFrame, key: str, ts: str, most: int, late: str = "10 minutes") -> DataFrame:
    """``key, minute, n``: minutes in which a key has more than ``most`` rows."""
    at = F.col(ts).cast("timestamp")
    counted = events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > most).select(key, F.col("w.start").alias("minute"), "n")


def visits(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, began, ended, n``: stretches of activity without a longer gap."""
    at = F.col(ts).cast("timestamp")
    counted = events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def ingest(documents: DataFrame, build, out: str, checkpoint: str):
    """Run ``build`` (documents to children with a ``collection``) on each micro-batch and append its result; returns the query.

    A batch that is repeated after a failure replaces its own folder, so nothing is stored twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
