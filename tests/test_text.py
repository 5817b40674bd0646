import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def loop(units, size, overlap, joint):
    """Plain windows, as a loop."""
    out, s = [], 0
    while s < len(units):
        if s == 0 or s + overlap < len(units):
            out.append(joint.join(units[s : s + size]))
        s += size - overlap
    return out


def test_windows_equal_a_loop(spark):
    rows = [(n, [f"w{i}" for i in range(n)]) for n in range(70)]
    df = spark.createDataFrame(rows, "n int, u array<string>")
    for size, overlap in ((4, 0), (3, 1), (12, 3), (5, 4), (1, 0)):
        for r in df.select("u", X.windows(F.col("u"), size, overlap, " ").alias("w")).collect():
            assert r.w == loop(r.u, size, overlap, " ")


def test_window_must_move(spark):
    import pytest

    with pytest.raises(ValueError):
        X.windows(F.array(), 3, 3, " ")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aé1 .!?\n\t _đ", max_size=30), min_size=1, max_size=6))
def test_tokens_and_sentences(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.tokens(F.col("t")).alias("k"), X.words(F.col("t")).alias("w"), X.sentences(F.col("t")).alias("s")).collect():
        assert r.k == re.findall(r"\w+", r.t.strip().lower())
        assert r.w == r.t.split()
        flat = " ".join(r.t.split())
        assert r.s == [p.strip() for p in re.split(r"(?<=[.!?])\s+", flat) if p.strip()]


def test_paragraphs_keep_tables(spark):
    t = f"a\n\n{X.TABLE_START}\n|x|\n\n|y|\n{X.TABLE_END}\n\n b \n \n\nc"
    assert one(spark, t, X.paragraphs(F.col("t")).alias("p")).p == ["a", f"{X.TABLE_START}\n|x|\n\n|y|\n{X.TABLE_END}", "b", "c"]
    assert one(spark, " one \n two ", X.paragraphs(F.col("t")).alias("p")).p == ["one \n two"]
    assert one(spark, "  ", X.paragraphs(F.col("t")).alias("p")).p == []


def test_collection_names(spark):
    names = {"": "rag_chatbot", None: "rag_chatbot", " ": "rag_chatbot", "a": "axx", "__x__": "xxx", "Luật dược": "Lu_t_d_c", "-ab": "c-ab", "ab-": "ab-1", "y" * 80: "y" * 63, "***": "rag_chatbot"}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "t string, want string")
    for r in df.select("*", X.collection_name(F.col("t")).alias("c")).collect():
        assert r.c == r.want


def test_small_functions(spark):
    t = F.col("t")
    r = one(spark, "**Đau** <b> & [Source 3]\nx", X.without_citations(t).alias("a"), X.plain_words(t).alias("b"), X.parent_id(t, F.lit(2)).alias("c"), X.fold(t).alias("d"))
    assert r.a == "<strong>Đau</strong> &lt;b&gt; &amp;<br/>x"
    assert r.b == "đau b source 3 x"
    assert r.c == hashlib.sha256("**Đau** <b> & [Source 3]\nx2".encode()).hexdigest()[:16]
    assert r.d.startswith("**dau**")
    assert one(spark, "SUMMARY: a\nx\nsummary: b ", X.labelled_line(t, "SUMMARY").alias("a")).a == "b"
    assert one(spark, "x", X.labelled_line(t, "SUMMARY").alias("a")).a is None
    assert one(spark, "ếa ỄĐ", X.fold(t).alias("a")).a == "ea ed"
    assert one(spark, "PANADOL extra 500MG X", X.name_case(t).alias("a")).a == "Panadol extra 500mg X"


def test_near_names(spark):
    rows = [("para extra", "Paracetamol Extra 500", True), ("panadol", "Panadol", True), ("paradol", "Parazin", True), ("xyz", "Panadol", False), ("", "Panadol", True), ("aspirin forte", "Aspirin", False)]
    df = spark.createDataFrame(rows, "q string, n string, want boolean")
    for r in df.select("*", X.is_near_name(F.col("q"), F.col("n")).alias("x")).collect():
        assert r.x == r.want, r
