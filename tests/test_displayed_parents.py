"""Displayed passages get their own parent, told by the whole text."""

from millrace.operators import search
from millrace.plans import registry

HEAD = "# Liều dùng và cách dùng của thuốc trong mọi trường hợp thường gặp\n"
ONE, TWO, GONE = HEAD + "Người lớn uống hai viên mỗi ngày. " * 9, HEAD + "Trẻ em uống một gói mỗi ngày. " * 9, HEAD + "Không dùng nữa. " * 9
#: Displayed text and the content it has to get.
SHOWN = [
    (ONE[:150], ONE), (TWO[:150], TWO), (TWO, TWO), (GONE[:150], GONE[:150]), (TWO[:149] + "...", TWO), (ONE[:149] + " [...]", ONE), (TWO[:150] + "\ufffd", TWO), (TWO[:150] + "<str", TWO),
    (TWO[:150] + " &nb", TWO), (ONE[:120] + TWO[120:150], ONE[:120] + TWO[120:150]), ("...", "..."), (None, None),
]


def test_parent_of_the_whole_text(spark):
    shown = spark.createDataFrame([(i, "a", t) for i, (t, _) in enumerate(SHOWN)] + [(98, None, ONE[:150]), (99, "b", ONE[:150])], "id int, source string, text string")
    parents = spark.createDataFrame([("a", ONE), ("a", TWO), ("a", TWO), (None, GONE), ("a", None)], "source string, content string")
    found = {r["id"]: r["content"] for r in search.with_displayed_parents(shown, parents, ["id"]).collect()}
    assert found == {i: want for i, (_, want) in enumerate(SHOWN)} | {98: ONE[:150], 99: ONE[:150]}


def test_query(spark, tmp_path):
    entry = "sources array<struct<rank int, source string, summary string, content string, collection_name string, page int>>"
    rows = [("m", [(k, "a", None, t, None, None) for k, (t, _) in enumerate(SHOWN)])]
    spark.createDataFrame(rows, f"id string, {entry}").write.parquet(str(tmp_path / "chat_messages.parquet"))
    spark.createDataFrame([("p1", "a", ONE), ("p2", "a", TWO)], "parent_id string, source string, content string").write.parquet(str(tmp_path / "parents.parquet"))
    found = {r["rank"]: r["content"] for r in registry.queries()["E12_J01_parent_context"](spark, str(tmp_path)).collect()}
    assert found == {k: want for k, (_, want) in enumerate(SHOWN)}
