"""The engine's tables, one Parquet file or folder each."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.session import ship, stamps

#: Tables kept at most, and for how many seconds.
KEPT, LIFETIME = 32, 300


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table of ``folder``; columns and filters are pruned by the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cached_table(spark: SparkSession, folder: str, name: str, now: float | None = None) -> DataFrame:
    """``table`` kept in memory and on disk of the executors for ``LIFETIME`` seconds; a changed file is read again, and of more than ``KEPT`` tables the oldest goes."""
    now = time.time() if now is None else now
    known: dict = spark.sparkContext.__dict__.setdefault("_millrace_tables", {})
    key = (folder, name, tuple(stamps(spark, f"{folder}/{name}.parquet")))
    for old in [k for k, (at, _) in known.items() if now - at > LIFETIME or (k[:2] == key[:2] and k != key)]:
        known.pop(old)[1].unpersist()
    if key not in known:
        while len(known) >= KEPT:
            known.pop(min(known, key=lambda k: known[k][0]))[1].unpersist()
        known[key] = now, table(spark, folder, name).persist()
    return known[key][1]
