"""Re-ranking by what passages share with a question: passages are read by the search alone."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from helpers import connect, same
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.plans import registry


def test_rerank_reads_passages_once(spark, tmp_path):
    """Ids with several contents or questions too: the least content counts, each question is a row."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["Thuốc", "ΑΣ", "x_1"]
    text = lambda a, b: " ".join(rnd.choices(words, k=rnd.randint(a, b)))
    parents = {"parent_id": [f"k{rnd.randint(0, 60)}" for _ in range(150)], "content": [rnd.choice([text(0, 30), text(1, 3), None, "..."]) for _ in range(150)]}
    feedback = {"feedback_id": [rnd.randint(1, 30) * 10 for _ in range(60)], "question": [rnd.choice([text(1, 12), text(1, 90)]) for _ in range(60)]}
    pq.write_table(pa.table(parents), tmp_path / "parents.parquet")
    pq.write_table(pa.table(feedback), tmp_path / "feedback.parquet")
    query = registry.queries()["E09_K07_rerank"]
    same(spark, connect(tmp_path), query, registry.oracle_sql()["E09_K07_rerank"], tmp_path)
    read = query(spark, tmp_path).inputFiles()
    assert any("feedback.parquet" in f for f in read) and not any("parents.parquet" in f for f in read)


def test_shared_tokens(spark):
    """More tokens than bits of a byte; of several texts those of the least."""
    texts = spark.createDataFrame([("x", "b c d e f g h i j k"), ("x", "a k"), ("y", "J j z"), ("z", None)], "k string, t string")
    terms = search.term_weights(spark.createDataFrame([(1, "k j i h g f e d c b a"), (2, "z b")], "query_id int, t string"), ["query_id"], "t")
    found = search.search_texts(terms, texts, ["k"], "t", shared=True)
    assert found.drop("shared").collect() == search.search_texts(terms, texts, ["k"], "t").collect()
    told = found.select("query_id", "k", F.array_join(F.array_sort(F.split("shared", " ")), " ")).collect()
    assert sorted(map(tuple, told)) == [(1, "x", "a k"), (1, "y", "j"), (2, "x", ""), (2, "y", "z")]
