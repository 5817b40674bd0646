"""JSON side files and the sinks of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = "timestamp string, question string, answer string, rating string, comment string, session_id string, feedbackComment string, feedback_comment string"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of feedback; a broken file has no rows; other spellings of the comment count."""
    rows = spark.read.schema(FEEDBACK + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    kept = rows.filter("_corrupt is null and (question is not null or answer is not null)")
    return kept.withColumn("comment", F.coalesce("comment", "feedback_comment", "feedbackComment")).drop("_corrupt", "feedback_comment", "feedbackComment")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """``day, prompt_tokens, completion_tokens, requests`` of a usage file; a broken file has no rows."""
    day = "struct<prompt_tokens:bigint,completion_tokens:bigint,requests:bigint>"
    rows = spark.read.schema(f"daily map<string,{day}>").option("multiLine", "true").json(path)
    return rows.select(F.explode("daily").alias("day", "u")).select(F.to_date("day").alias("day"), "u.*")


def write_by_collection(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write children or parents, a folder for each collection; appended files have ids that don't depend on the order of files."""
    rows.write.mode(mode).partitionBy("collection").option("compression", "zstd").parquet(path)


def child_ids(children: DataFrame) -> DataFrame:
    """Adds ``child_id``: a hash of what identifies a child, so ingesting a file again gives the same ids."""
    return children.withColumn("child_id", F.left(F.sha2(F.concat_ws("\u0001", "collection", "source", "parent_id", F.col("chunk_index").cast("string")), 256), F.lit(16)))


def check_vector_size(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """The same rows; a vector of another size fails the job instead of changing the table."""
    return vectors.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("vector size "), F.size(column).cast("string"), F.lit(f", wanted {size}")))))


def coerced(rows: DataFrame, keep: tuple[str, ...] = ("string", "int", "bigint", "double", "float", "boolean"), copy: str = "parent_content", limit: int = 30_000) -> DataFrame:
    """Rows as a vector store takes them: columns of other types as text, a null as ``None``, the parent's copy cut after ``limit`` characters."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.col(c) if kinds[c] in keep else F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    out = rows.select(*[F.coalesce(text(c), F.lit("None")).alias(c) if kinds[c] not in keep or kinds[c] == "string" else F.col(c) for c in rows.columns])
    if copy in kinds:
        out = out.withColumn(copy, F.when(F.length(copy) > limit, F.concat(F.left(copy, F.lit(limit)), F.lit("..."))).otherwise(F.col(copy)))
    return out


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Write ``token, idx``; a merged vocabulary goes to a new path, since it reads the old one."""
    vocabulary.select("token", F.col("idx").cast("int").alias("idx")).write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, idx`` of a written vocabulary; without one there are no tokens."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else spark.createDataFrame([], "token string, idx int")
