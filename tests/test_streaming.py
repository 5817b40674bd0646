import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import chunking
from millrace.streaming import activity


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(seconds=20 * i), "a" if i % 3 else "b") for i in range(12)] + [(t + dt.timedelta(days=5), "z")]
    schema = "ts timestamp, who string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: activity.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    days = {str(r.day): r.n for r in finish(activity.daily_counts(read(), "ts"), "days", "complete").collect()}
    assert days == {"2024-01-01": 12, "2024-01-06": 1}
    busy = finish(activity.busy_minutes(read(), "who", "ts", 1), "busy")
    assert {(r.who, r.n) for r in busy.collect()} == {("a", 2)} and busy.count() == 4
    visits = finish(activity.visits(read(), "who", "ts"), "visits")
    assert {(r.who, r.n) for r in visits.collect()} == {("a", 8), ("b", 4)}


def test_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "One. Two."), (2, None)], schema).write.parquet(str(tmp_path / "docs"))
    docs = activity.stream(spark, str(tmp_path / "docs"), spark.createDataFrame([], schema).schema)
    build = lambda b: chunking.build_children(chunking.build_parents(b, "doc_id")).withColumn("collection", F.lit("c"))
    activity.ingest(docs, build, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["One. Two."]
