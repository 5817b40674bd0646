from test_personal import rows

from millrace.llm import personal as P


def found_in(spark, texts, wanted):
    """Those of ``wanted`` in which a name is found."""
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "feedback_id long, question string, comment string")
    values = P.texts_of(df)
    found = {(texts[r.feedback_id], r.kind) for r in P.found_kinds(values, P.instances(values)).collect()}
    return [t for t in wanted if (t, "NAME") in found]


def test_rare_names_in_a_large_table(spark):
    """Two mentions make a word known, also among more than 3,000 accepted names."""
    usual = [f"Tôi tên là Nguyễn Thu Hà, đơn số {i}." for i in range(3200)]
    rare = ["My name is Tamsin Hollowick, call me.", "My name is Tamsin Hollowick, write to me."]
    lower = ["my name is tamsin hollowick, any news?"]
    assert found_in(spark, usual + rare + lower, rare + lower) == rare + lower


def test_rare_given_name_by_its_patterns(spark):
    """A given name that no other name has is found by where it stands; a common word that begins a sentence isn't one."""
    told = [f"Nhờ chuyển cho Nguyễn {n} giúp em {i}" for i in range(40) for n in ("Lan", "Minh Tâm")]
    rare, begins = ["Nhờ chuyển cho Zorwyn giúp em 7"], [f"Giá đã thay đổi, giờ là {i}." for i in range(60)]
    texts = [t for t, _ in rows() if t and len(t) < 1000] + told + rare + begins
    assert found_in(spark, texts, rare + begins) == rare
