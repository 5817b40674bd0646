"""Counts, daily series and usage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def spine(spark: SparkSession, as_of: dt.date, days: int = 30) -> DataFrame:
    """``day``: the last days up to and with ``as_of``, oldest first."""
    first = as_of - dt.timedelta(days=days - 1)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day"))


def daily(rows: DataFrame, ts: str, as_of: dt.date, days: int = 30) -> DataFrame:
    """``day, n``: rows of each day, days without rows are 0."""
    in_range = rows.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine(rows.sparkSession, as_of, days).join(in_range, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def usage(rows: DataFrame, ts: str, prompt: str, completion: str) -> DataFrame:
    """``day, prompt_tokens, completion_tokens, requests``: days and, with a null day, the whole, in one pass; rows without tokens don't count."""
    used = rows.filter((F.coalesce(prompt, F.lit(0)) != 0) | (F.coalesce(completion, F.lit(0)) != 0)).filter(F.col(ts).isNotNull())
    return (
        used.withColumn("day", F.to_date(ts))
        .rollup("day")
        .agg(F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.count(F.lit(1)).alias("requests"))
    )


def recorded_days(usage_rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` recorded days."""
    return usage_rows.filter("day is not null").orderBy(F.desc("day")).limit(n)


def rating_counts(feedback: DataFrame) -> DataFrame:
    """``up, down, total, positive_rate``: the rate in whole percent, null without feedback."""
    return feedback.agg(
        F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.count(F.lit(1)).alias("total")
    ).withColumn("positive_rate", F.round(100 * F.col("up") / F.nullif(F.col("total"), F.lit(0))).cast("bigint"))


def busy_minutes(rows: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """``key, minute, n``: minutes in which a key has more than ``most`` rows."""
    counted = rows.groupBy(key, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > most)


def stale_lookups(rows: DataFrame, key: str, ts: str, order: str, seconds: int = 300) -> DataFrame:
    """Adds ``fresh``: whether the key was looked up within the lifetime of a cache before this row.

    Neighbours are compared within a key and day; the last lookup of the day before is joined, so a hot key is spread over days.
    """
    day = F.to_date(ts)
    at = F.col(ts).cast("timestamp").cast("double")
    rows = rows.withColumns({"_day": day, "_at": at})
    within = rows.withColumn("_before", F.lag("_at").over(W.partitionBy(key, "_day").orderBy("_at", order)))
    last = rows.groupBy(key, "_day").agg(F.max("_at").alias("_last")).withColumn("_day", F.date_add("_day", 1))
    both = within.join(last, [key, "_day"], "left")
    before = F.coalesce("_before", "_last")
    return both.withColumn("fresh", F.coalesce(F.col("_at") - before <= seconds, F.lit(False))).drop("_day", "_at", "_before", "_last")


def any_positive(value: str = "n") -> Column:
    """Whether a series shows anything."""
    return F.coalesce(F.bool_or(F.col(value) > 0), F.lit(False))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n``: distinct ids of each table."""
    counted = [df.agg(F.lit(name).alias("name"), F.countDistinct("id").alias("n")) for name, df in tables.items()]
    whole = counted[0]
    for one in counted[1:]:
        whole = whole.unionByName(one)
    return whole


def per_source(rows: DataFrame) -> DataFrame:
    """``source, n``; rows without a source are ``Unknown``."""
    return rows.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def collections(documents: DataFrame) -> DataFrame:
    """``collection, sources, rows`` of each collection."""
    return documents.groupBy("collection").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("rows"))
