from pyspark.sql import functions as F

from millrace.operators import routing


def test_keywords(spark):
    q = "Paracetamol giá bao nhiêu và theo quy định thì thuốc này do cơ quan nào cấp phép?"
    r = spark.createDataFrame([(q,)], "q string").select(routing.by_keywords(F.col("q")).alias("r")).first().r
    assert r.collections_to_search == ["legal"] and r.price and r.price_name == "paracetamol và theo quy định thì này do cơ quan nào cấp phép"
    rows = [("THÔNG TƯ 02", "legal"), ("liều dùng", "drug_info"), ("", "drug_info"), (None, "drug_info"), ("claw", "legal")]
    for r in spark.createDataFrame(rows, "q string, want string").select("want", routing.by_keywords(F.col("q")).alias("r")).collect():
        assert r.r.collections_to_search == [r.want]


def test_model_answers(spark):
    rows = [
        ('{"collections_to_search": ["legal", "drug_info"], "price": true, "price_name": " x "}', (["legal", "drug_info"], True, "x")),
        ('Sure: {"collections_to_search": [], "price": "false"} ok', (["drug_info"], True, None)),
        ('{"collections_to_search": ["zzz"], "price": 0, "price_name": 3}', (["drug_info"], False, None)),
        ('{"price": ""}', (["drug_info"], False, None)),
        ("not json", None),
        ("[1]", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for r in df.select("i", routing.by_model(F.col("t")).alias("r")).collect():
        want = rows[r.i][1]
        assert (tuple(r.r) if r.r else None) == want, rows[r.i]


def test_fallback(spark):
    df = spark.createDataFrame([("luật dược", "broken"), ("x", '{"collections_to_search": ["legal"]}'), (" ", '{"collections_to_search": ["legal"]}')], "q string, t string")
    got = [r.r.collections_to_search for r in df.select(routing.route(F.col("q"), F.col("t")).alias("r")).collect()]
    assert got == [["legal"], ["legal"], ["drug_info"]]
    assert df.limit(1).select(routing.physical(F.array(F.lit("legal"), F.lit("?")), {"legal": "l1"}).alias("p")).first().p == ["l1"]
