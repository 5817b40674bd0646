from pyspark.sql import functions as F

from millrace.operators import chunking


def test_sections():
    text = "# A\n\n## B\none\n```\n# no\n```\n## C\ntwo\n### D\nthree\n# E"
    got = chunking.sections(text)
    assert [b for b, _ in got] == ["# A", "## B\none\n```\n# no\n```", "## C\ntwo", "### D\nthree", "# E"]
    assert got[3][1] == {"Header 1": "A", "Header 2": "C", "Header 3": "D"}
    assert got[4][1] == {"Header 1": "E"}
    assert chunking.sections("plain") == [("plain", {})]
    assert chunking.sections("") == []


def test_recursive_cut():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(60)) + "." for _ in range(20))
    parts = chunking.cut_recursively(text, 500, 100)
    assert all(0 < len(p) <= 500 for p in parts)
    assert set(" ".join(parts).replace(".", " ").split()) == set(text.replace(".", " ").split())
    assert chunking.cut_recursively("x" * 1201, 500, 0) == ["x" * 500, "x" * 500, "x" * 201]
    assert chunking.cut_recursively("  ", 10, 0) == []


def test_strategies(spark):
    paragraph = "\n\n".join(" ".join(["w"] * 50) for _ in range(10))
    sentence = " ".join(" ".join(["w"] * 12) + "." for _ in range(20))
    df = spark.createDataFrame([(1, paragraph), (2, sentence), (3, "short"), (4, ""), (5, None)], "k long, text string")
    got = {r.k: r.strategy for r in chunking.strategy(chunking.statistics(df)).collect()}
    assert got == {1: "paragraph", 2: "sentence", 3: "semantic_tokens", 4: "semantic_tokens", 5: "semantic_tokens"}
    parents = chunking.build_parents(df, "k")
    n = {r.key: r.n for r in parents.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert n == {"1": 3, "2": 3, "3": 1}
    children = chunking.build_children(parents)
    assert {r.key: r.n for r in children.groupBy("key").agg(F.count("*").alias("n")).collect()} == {"1": 10, "2": 4 + 4 + 2, "3": 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert chunking.build_children(chunking.build_parents(df, "k")).count() == 0
