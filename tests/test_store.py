import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import analytics, context, store


def test_latest_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c")], "k int, v int, t string")
    assert sorted((r.k, r.v, r.t) for r in store.latest(df, ["k"], ["v"]).collect()) == [(1, 2, "b"), (2, None, "c")]
    new = spark.createDataFrame([(2, 9, "n"), (3, 9, "n")], "k int, v int, t string")
    assert sorted(r.k for r in store.merged(df, new, ["k"]).collect()) == [1, 1, 1, 2, 3]


def test_upsert(spark):
    schema = "id string, user_id string, title string, created_at int, updated_at int"
    old = spark.createDataFrame([("a", "u", "t", 1, 1), ("b", "u", "t", 1, 1)], schema)
    new = spark.createDataFrame([("a", "u", "x", 5, 5), ("b", "other", "x", 5, 5), ("c", "u", "x", 5, 5)], schema)
    got = {r.id: tuple(r)[1:] for r in store.upsert_sessions(old, new).collect()}
    assert got == {"a": ("u", "t", 1, 5), "b": ("u", "t", 1, 1), "c": ("u", "x", 5, 5)}


def test_deletes_keep_null(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "source string, k int")
    assert sorted(r.k for r in store.without_source(df, "x").collect()) == [2, 3]
    assert sorted(r.k for r in store.without(df, spark.createDataFrame([("y",), (None,)], "id string"), "source").collect()) == [1, 2]
    assert [r.k for r in store.set_where(df, "k", F.lit(0), F.col("source") == "x").orderBy("k").collect()] == [0, 2, 3]


def test_histories(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", f"m{i}" if i != 8 else "") for i in range(1, 10)] + [("t", 1, "user", "only"), ("t", 2, "system", "no")]
    df = spark.createDataFrame(rows, "session_id string, seq int, role string, content string")
    got = {r.session_id: r.history.split("\n") for r in context.rendered_history(df, "session_id", ["seq"]).collect()}
    assert got["s"] == ["Trợ lý: m4", "Người dùng: m5", "Trợ lý: m6", "Người dùng: m7", "Người dùng: m9"]
    assert got["t"] == ["Người dùng: only"]


def test_usage_json(spark):
    rows = ['{"usage_metadata": {"input_tokens": 3, "output_tokens": 4}}', '{"token_usage": {"prompt_tokens": 5}}', "broken", None]
    got = [tuple(r.u) for r in spark.createDataFrame([(x,) for x in rows], "j string").select(context.usage_of(F.col("j")).alias("u")).collect()]
    assert got == [(3, 4), (5, 0), (0, 0), (0, 0)]


def test_series(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 30, 1),), (dt.datetime(2024, 1, 30, 2),), (dt.datetime(2023, 1, 1),), (None,)], "ts timestamp")
    got = {r.day: r.n for r in analytics.daily(df, "ts", dt.date(2024, 1, 30)).collect()}
    assert len(got) == 30 and got[dt.date(2024, 1, 30)] == 2 and sum(got.values()) == 2
    empty = analytics.rating_counts(spark.createDataFrame([], "rating string")).first()
    assert (empty.total, empty.positive_rate) == (0, None)
