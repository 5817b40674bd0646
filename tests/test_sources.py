import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import documents, files

XML = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>"""


def test_documents(spark, tmp_path):
    deep = tmp_path / "in" / "deep"
    deep.mkdir(parents=True)
    with zipfile.ZipFile(deep / "a.docx", "w") as z:
        z.writestr("word/document.xml", XML)
    (deep / "b.pdf").write_bytes(b"pdf bytes")
    (tmp_path / "in" / "c.docx").write_bytes(b"broken")
    (tmp_path / "in" / "d.txt").write_text("no")
    got = {r.source: r for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.docx"].text == "one two\n\na | b" and got["a.docx"].page == 0
    assert got["b.pdf"].error.startswith("ValueError") and got["c.docx"].error
    assert set(got) == {"a.docx", "b.pdf", "c.docx"}
    read = documents.read_documents(spark, str(tmp_path / "in"), {"pdf": lambda b: b.decode()})
    assert read.filter("source = 'b.pdf'").first().text == "pdf bytes"
    assert [documents.file_name(x) for x in (None, " ", "x/y.pdf")] == ["document", "document", "y.pdf"]


def test_side_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"question": "q", "answer": "a", "rating": "up", "feedbackComment": "c"}]))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "u.json").write_text(json.dumps({"total": {}, "daily": {"2024-01-02": {"prompt_tokens": 1, "completion_tokens": 2, "requests": 3}}}))
    assert files.read_feedback(spark, str(tmp_path / "f.json")).first().comment == "c"
    assert files.read_feedback(spark, str(tmp_path / "bad.json")).count() == 0
    u = files.read_usage(spark, str(tmp_path / "u.json")).first()
    assert (str(u.day), u.prompt_tokens, u.requests) == ("2024-01-02", 1, 3)
    assert files.read_usage(spark, str(tmp_path / "bad.json")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", "s", "p", 0, [1.0, 2.0])], "collection string, source string, parent_id string, chunk_index int, dense array<float>")
    with_ids = files.child_ids(rows)
    files.write_by_collection(files.check_vector_size(with_ids, "dense", 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("collection") == "c").first().child_id == with_ids.first().child_id
    with pytest.raises(Exception, match="vector size 2"):
        files.check_vector_size(rows, "dense", 3).collect()


def test_upload(spark, tmp_path):
    from millrace.sources.documents import store_upload

    path = store_upload(spark, str(tmp_path), "..\\x/leaflet.docx", b"\x00\xffabc")
    assert path.endswith("/leaflet.docx") and (tmp_path / "leaflet.docx").read_bytes() == b"\x00\xffabc"
    assert store_upload(spark, str(tmp_path), " ", b"").endswith("/document")


def test_vocabulary_table(spark, tmp_path):
    from millrace.operators.search import merge_vocabulary
    from millrace.sources.files import read_vocabulary, write_vocabulary

    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    new = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "token string")
    write_vocabulary(merge_vocabulary(read_vocabulary(spark, first), new), first)
    write_vocabulary(merge_vocabulary(read_vocabulary(spark, first), spark.createDataFrame([("aa",), ("a",)], "token string")), second)
    assert dict(read_vocabulary(spark, second).collect()) == {"a": 0, "b": 1, "aa": 2}


def test_cached_table(spark, tmp_path):
    from millrace.sources import tables

    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    first = tables.cached_table(spark, str(tmp_path), "t", now=0)
    assert tables.cached_table(spark, str(tmp_path), "t", now=100) is first and first.is_cached
    assert tables.cached_table(spark, str(tmp_path), "t", now=500) is not first
    spark.range(2).write.mode("append").parquet(path)
    assert tables.cached_table(spark, str(tmp_path), "t", now=501).count() == 5


def test_embedder_by_name():
    from millrace.operators import models

    assert models.embedder("hash-16")(["a b"]).shape == (1, 16) and models.embedder("anything")(["a"]).shape == (1, 64)
    models.register_embedder("mine-", lambda name: name.upper())
    assert models.embedder("mine-x") == "MINE-X"
