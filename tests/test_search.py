import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import models, search


def test_sparse_against_brute_force(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 12)))) for i in range(40)]
    asked = [(i, " ".join(rnd.choices("abcdxy", k=4))) for i in range(5)]
    terms = search.term_weights(spark.createDataFrame(asked, "query_id long, t string"), ["query_id"], "t")
    postings = search.term_weights(spark.createDataFrame(docs, "doc long, t string"), ["doc"], "t")
    got = defaultdict(list)
    for r in search.sparse_search(terms, postings, ["doc"], 7).collect():
        got[r.query_id].append((r["rank"], r.doc))
    weight = lambda t: {k: round(1 + math.log(n), 6) for k, n in Counter(t.split()).items()}
    for q, t in asked:
        scored = [(-round(sum(w * weight(x).get(k, 0) for k, w in weight(t).items()), 6), i) for i, x in docs if set(t.split()) & set(x.split())]
        assert [d for _, d in sorted(got[q])] == [i for _, i in sorted(scored)[:7]]


def test_dense_against_brute_force(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    got = defaultdict(dict)
    for r in search.dense_search(df.filter("id % 20 = 0"), df, "id", "v", 5).collect():
        got[r.query_id][r["rank"]] = r.id
    m = np.array([np.float32(v) for _, v in rows[:60]], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        best = sorted((-round(float(m[q] @ m[i]), 6), str(i)) for i in range(60) if i != q)[:5]
        assert [got[str(q)][k] for k in range(1, 6)] == [i for _, i in best]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "query_id int, d string, rank int")
    got = [(r.d, r.score) for r in search.fuse(lists, ["query_id"], ["d"]).orderBy("rank").collect()]
    assert got == [("b", round(1 / 61 + 1 / 62, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6))]


def test_expansions(spark):
    df = spark.createDataFrame([("q", "1. a\n- b\n\n2) a\n* c\nd\ne"), ("q", None), ("q", "  ")], "q string, r string")
    got = [r.x for r in df.select(models.expansions(F.col("q"), F.col("r")).alias("x")).collect()]
    assert got == [["q", "a", "b", "c"], ["q"], ["q"]]


def test_retrieve(spark):
    passages = spark.createDataFrame([("legal", "1", "license rules for pharmacies"), ("legal", "2", "storage of vaccines"), ("drug", "1", "dose of aspirin"), ("drug", "3", "aspirin and alcohol")], "collection string, passage_id string, text string")
    asked = spark.createDataFrame([(7, "aspirin dose", None), (8, "license", "permit\nrules")], "query_id long, question string, response string")
    got = {(r.query_id, r["rank"]): (r.collection, r.passage_id) for r in search.retrieve(asked, passages, kept=2).collect()}
    assert got[7, 1] == ("drug", "1") and got[8, 1] == ("legal", "1")
    assert search.retrieve(asked.limit(0), passages).count() == 0


def test_vocabulary_merge(spark):
    old = spark.createDataFrame([("a", 0), ("z", 1)], "token string, idx int")
    new = spark.createDataFrame([("b",), ("z",), ("bb",), ("a",), ("c",), (None,)], "token string")
    assert {r.token: r.idx for r in search.merge_vocabulary(old, new).collect()} == {"a": 0, "z": 1, "b": 2, "bb": 3, "c": 4}


def test_summary(spark):
    df = spark.createDataFrame([("x" * 300, None), ("short", "SUMMARY: s\nTARGET_QUESTION: t?")], "c string, r string")
    got = [r.s for r in df.select(models.summary_of(F.col("c"), F.col("r")).alias("s")).collect()]
    assert got[0].summary == "x" * 200 + "..." and got[0].target_question == "Nội dung đoạn văn là gì?"
    assert (got[1].summary, got[1].target_question) == ("s", "t?")
