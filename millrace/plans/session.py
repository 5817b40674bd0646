"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only.

    A cluster has to name its folder in that setting; a machine-local folder is used
    only when the master is ``local[...]``, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_millrace_scratch", None) != path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        spark.sparkContext._millrace_scratch = path
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage like ``checkpoint()`` but keeps columns compressed and prunable,
    survives the loss of executors, and every later reader scans the file instead of
    recomputing the plan. The table is deleted with the ``scratch`` in which it was written, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for written in getattr(spark.sparkContext, "_millrace_scopes", []):
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables written within; results that read them have to be written out before."""
    context, written = spark.sparkContext, []
    context._millrace_scopes = [*getattr(context, "_millrace_scopes", []), written]
    try:
        yield
    finally:
        context._millrace_scopes = [w for w in context._millrace_scopes if w is not written]
        for path in written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stamps(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of each file below some paths."""
    found = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


#: Keys that ``lookup`` takes out of the shuffle.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each key and in ``weight`` about how many of ``rows`` have it.

    The ``HOT`` heaviest keys, however many rows they hold, are answered from a broadcast of ``HOT`` rows of ``table`` (its columns should be
    small); their rows then go into the join by a hash of ``spread`` that meets nothing. Every other key holds less than one in ``HOT`` of the
    weight, so no task of the join gets a large group. ``weight`` isn't in the result. Null keys meet nothing and are spread likewise.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    hot = table.orderBy(F.desc(weight), *keys).limit(HOT).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*values).alias("_hot"))
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    away = F.col("_hot").isNotNull() | F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)).cast("boolean")
    salted = met.withColumn("_at", F.when(away, F.struct(F.lit(True).alias("away"), F.xxhash64(*spread).alias("h"))).otherwise(F.struct(F.lit(False).alias("away"), F.xxhash64(*keys).alias("h"))))
    cold = table.select(*[F.col(k).alias(f"_cold_{k}") for k in keys], F.struct(*values).alias("_cold")).withColumn("_cold_at", F.struct(F.lit(False).alias("away"), F.xxhash64(*[f"_cold_{k}" for k in keys]).alias("h")))
    same = F.col("_at") == F.col("_cold_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_cold_{k}"))
    found = F.coalesce("_hot", "_cold")
    return salted.join(cold, same, "left").select(*rows.columns, *[found[v].alias(v) for v in values])


def ship(spark: SparkSession) -> None:
    """Give the library to the Python workers of all executors, once per application.

    The archive is made in Spark's own folder of the driver and fetched from there by the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(context._temp_dir, "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("millrace", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._millrace_shipped = True
