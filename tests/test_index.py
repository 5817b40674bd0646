"""The index, composed rounds, token windows and settings."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import context, models, search, store
from millrace.plans.settings import Settings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PASSAGES = [("a" if i % 3 else "b", f"p{i}", f"The dose of drug{i} is {i % 7} spoons a day, taken with water {'and milk' * (i % 2)}") for i in range(60)]


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "collection", "passage_id", "score", "rank").collect()))


def test_index_appended(spark, tmp_path):
    """An index that grew finds the same as one built at once; appending what it has changes nothing."""
    passages = spark.createDataFrame(PASSAGES, "collection string, passage_id string, text string")
    asked = spark.createDataFrame([(1, "What is the dose of drug7?", None), (2, "drug12 with milk", "drug13\ndrug14"), (3, "", None)], "query_id int, question string, response string")
    whole = search.build_index(passages, str(tmp_path / "whole"))
    grown = search.build_index(passages.limit(20), str(tmp_path / "grown"))
    search.append_to_index(grown, passages)
    search.append_to_index(grown, passages)
    told = rows_of(search.retrieve(asked, passages))
    assert told and rows_of(search.retrieve_from(whole, asked)) == told == rows_of(search.retrieve_from(grown, asked))
    assert grown.table(spark, "passages").count() == len(PASSAGES)


def test_index_of_changed_files(spark, tmp_path):
    path = str(tmp_path / "passages")
    passages = spark.createDataFrame(PASSAGES, "collection string, passage_id string, text string")
    passages.write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = search.index_of(read(), read)
    assert search.index_of(read(), read) == first
    spark.createDataFrame([("a", "more", "x")], passages.schema).write.mode("append").parquet(path)
    second = search.index_of(read(), read)
    assert second != first and second.table(spark, "passages").count() == len(PASSAGES) + 1


def test_terms_beyond_the_broadcast(spark, monkeypatch):
    passages = spark.createDataFrame(PASSAGES, "collection string, passage_id string, text string")
    postings = search.term_weights(passages, ["passage_id"], "text")
    terms = search.term_weights(spark.createDataFrame([(1, "dose of milk"), (2, "water water")], "query_id int, text string"), ["query_id"], "text")
    found = sorted(map(tuple, search.sparse_search(terms, postings, ["passage_id"]).collect()))
    monkeypatch.setattr(search, "TERMS", 0)
    assert sorted(map(tuple, search.sparse_search(terms, postings, ["passage_id"]).collect())) == found


def test_near_names_by_brute_force(spark):
    names = ["Zalor Plus", "zalor", "Zal", "Zalorin Forte", "a b", "b", "Plus", "", "  ", "Xyz Zalo", "orin"]
    q = spark.createDataFrame([(n.lower(),) for n in names], "query string").distinct()
    n = spark.createDataFrame([(n,) for n in names], "name string")
    told = q.crossJoin(n).filter(X.is_near_name(F.col("query"), F.col("name")))
    assert sorted(map(tuple, search.near_names(q, n).collect())) == sorted(map(tuple, told.select("query", "name").collect()))


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_token_windows(spark):
    text = "Uống hai viên mỗi ngày, sau bữa ăn. Take two tablets a day! 123 " * 12
    df = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "t string")
    for make in (lambda: models.VocabularyTokenizer(VOCABULARY), models.WordTokenizer):
        own = make()
        got = [r[0] for r in df.select(models.token_windows(F.col("t"), make, 50, 10)).collect()]
        ids = own.encode(text)
        told, start = [], 0
        while start < len(ids):
            end = min(start + 50, len(ids))
            told.append(own.decode(ids[start:end]))
            start = end - 10 if end < len(ids) else len(ids)
        assert got == [told, ["short"], [], []] and len(told) > 2
    with pytest.raises(ValueError):
        models.token_windows(F.col("t"), models.WordTokenizer, 10, 10)


def test_parents_once(spark):
    children = spark.createDataFrame([("q", 1, "x", "cx"), ("q", 2, "x", "cx2"), ("q", 3, None, "own"), ("q", 4, "y", ""), ("q", 5, "y", ""), ("q", 6, "gone", "copy"), ("q", 7, None, None)], "id string, position int, parent_id string, parent_content string")
    parents = spark.createDataFrame([("x", "whole x"), ("y", "whole y")], "parent_id string, content string")
    take = lambda dedup: [(r.position, r.rank, r.content) for r in context.first_parents(children, parents, ["id"], dedup).orderBy("position").collect()]
    assert take(False) == [(1, 1, "whole x"), (2, 2, "cx2"), (3, 3, "own"), (4, 4, "whole y"), (6, 5, "copy")]
    assert take(True) == [(1, 1, "whole x"), (3, 3, "own"), (4, 3, "whole y"), (6, 4, "copy")]


def test_persisted(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("s", "u", "old", t, t)], "id string, user_id string, title string, created_at timestamp, updated_at timestamp")
    messages = spark.createDataFrame([], "id string, session_id string, user_id string, role string, content string, created_at timestamp, sources array<string>, price_data string")
    later = t + dt.timedelta(days=1)
    asked = spark.createDataFrame([("1", "s", "u", "Q1", "A1", later, ["x"], None), ("2", "s", "stranger", "Q2", "A2", later, None, None), ("3", None, "u", "  A long question  ", "A3", later, None, "{}")], "id string, session_id string, user_id string, question string, answer string, created_at timestamp, sources array<string>, price_data string")
    after, turns = store.persisted(sessions, messages, asked.filter("id != 2"))
    assert {(r.id, r.title, r.updated_at) for r in after.collect()} == {("s", "old", later), ("new-3", "A long question", later)}
    assert {(r.id, r.session_id, r.role, r.content, r.sources is None, r.price_data) for r in turns.collect()} == {
        ("1-user", "s", "user", "Q1", True, None), ("1-assistant", "s", "assistant", "A1", False, None), ("3-user", "new-3", "user", "  A long question  ", True, None), ("3-assistant", "new-3", "assistant", "A3", True, "{}"),
    }
    rejected, _ = store.persisted(sessions, messages, asked.filter("id = 2"))
    assert rejected.first().updated_at == t


def test_settings(spark):
    assert Settings.of(spark) == Settings() and Settings().sizes().words == (400, 120, 30)
    spark.conf.set("spark.millrace.prefetch", "7")
    try:
        assert Settings.of(spark).prefetch == 7
    finally:
        spark.conf.unset("spark.millrace.prefetch")


def test_term_lists(spark):
    """Counting within a row gives the weights of the aggregation."""
    texts = spark.createDataFrame([("a", "x y x z x"), ("b", "Đau đầu đau"), ("c", ""), ("d", None), ("e", "w " * 500)], "k string, t string")
    told = {(r.k, r.token): r.w for r in search.term_weights(texts, ["k"], "t").collect()}
    found = {(r.k, t): w for r in search.term_lists(texts, ["k"], "t").collect() for t, w in zip(r.tokens, r.ws, strict=True)}
    assert found == told
