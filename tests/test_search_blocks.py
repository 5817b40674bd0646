"""Searches in blocks: what tasks return follows the queries, ties are exact across blocks."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import search


def test_terms_follow_queries(spark, monkeypatch):
    """A share of the passages returns the best of a query only, however many terms the queries have."""
    monkeypatch.setattr(search, "TERMS", 0)
    monkeypatch.setattr(search, "top", lambda scored, *_: scored)
    passages = spark.range(600).selectExpr("cast(id as string) as k", "concat('dose of drug', id % 9, ' a day') as t").repartition(12)
    asked = spark.createDataFrame([(1, "dose of drug1"), (2, "a day"), (3, "drug8 dose")], "query_id int, t string")
    found = search.sparse_search(search.term_weights(asked, ["query_id"], "t"), search.term_weights(passages, ["k"], "t"), ["k"], 2)
    assert 0 < found.count() <= 2 * 3 * search._SHARES


def test_ties_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "TERMS", 40)
    rnd = random.Random(5)
    docs = [(rnd.choice(["a", "b", None]), None if i == 7 else f"k{rnd.random()}", " ".join(rnd.choices("abcdefghijkl", k=rnd.randint(0, 9)))) for i in range(300)]
    asked = [(i, " ".join(rnd.choices("abcdxyz", k=rnd.randint(1, 4)))) for i in range(30)]
    texts = spark.createDataFrame(docs, "c string, k string, t string").repartition(5)
    terms = search.term_weights(spark.createDataFrame(asked, "query_id int, t string"), ["query_id"], "t")
    weight = lambda t: {k: round(1 + math.log(n), 6) for k, n in Counter(t.split()).items()}
    told = set()
    for q, t in asked:
        scored = [(c, -round(sum(round(w * weight(x)[k], 9) for k, w in weight(t).items() if k in weight(x)), 6), (k is not None, k or "")) for c, k, x in docs if set(t.split()) & set(x.split())]
        for group in ("a", "b", None):
            told |= {(q, group, key[1] if key[0] else None, -s, r + 1) for r, (_, s, key) in enumerate(sorted([x for x in scored if x[0] == group], key=lambda x: x[1:])[:3])}
    columns = ["query_id", "c", "k", "score", "rank"]
    by_terms = search.sparse_search(terms, search.term_weights(texts, ["c", "k"], "t"), ["c", "k"], 3, ["c"])
    assert {tuple(r) for r in by_terms.select(columns).collect()} == told
    by_texts = search.search_texts(terms, texts, ["c", "k"], "t", 3, ["c"])
    assert {tuple(r) for r in by_texts.select(columns).collect()} == told


def test_texts_of_one_key(spark):
    """Texts of a key count together, repeated ones once, as in SQL."""
    texts = spark.createDataFrame([("x", "a b"), ("x", "a c"), ("x", "a c"), ("y", "a"), ("z", None)], "k string, t string")
    terms = search.term_weights(spark.createDataFrame([(1, "a")], "query_id int, t string"), ["query_id"], "t")
    told = search.sparse_search(terms, search.term_weights(texts.distinct(), ["k"], "t"), ["k"])
    assert sorted(map(tuple, search.search_texts(terms, texts, ["k"], "t").collect())) == sorted(map(tuple, told.collect())) == [(1, "x", 1.693147, 1), (1, "y", 1.0, 2)]


def test_fusion_counts_terms_in_place(spark, monkeypatch):
    """Of A12_fusion only the terms of queries are brought together by a shuffle."""
    from helpers import DATA

    from millrace.plans import registry

    shuffled, weigh = [], search.term_weights
    monkeypatch.setattr(search, "term_weights", lambda texts, keys, text_col: shuffled.append(keys) or weigh(texts, keys, text_col))
    registry.queries()["A12_fusion"](spark, DATA)
    assert shuffled == [["feedback_id"]]


def test_vectors_follow_queries(spark, monkeypatch):
    """Vectors that all tie: a share of the corpus returns the best by id only."""
    monkeypatch.setattr(search, "top", lambda scored, *_: scored)
    rows = spark.range(500).select("id", F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v")).repartition(12)
    found = search.dense_search(rows.filter("id < 10"), rows, "id", "v", 3)
    assert 0 < found.count() <= 3 * 10 * search._SHARES
