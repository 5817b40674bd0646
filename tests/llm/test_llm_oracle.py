import os

import pytest
from helpers import DATA, connect, same

from millrace import llm

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(spark, con, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name, columns", [
    ("p1_found", [("feedback_id", "bigint"), ("defect", "string")]),
    ("p2_found", [("feedback_id", "bigint"), ("field", "string"), ("kind", "string")]),
    ("p3_found", [("field", "string"), ("record_id", "string"), ("source_rank", "int")]),
    ("p4_found", [("session_id", "string"), ("reason", "string")]),
    ("p5_found", [("field", "string"), ("item_id", "string")]),
    ("p6_ids", [("doc_id", "bigint"), ("ids", "array<int>")]),
    ("p8_found", [("doc_id", "bigint")]),
])
def test_columns(spark, name, columns):
    df = llm.queries()[name](spark, DATA)
    assert df.dtypes == columns
    rows = df.collect() if name != "p6_ids" else []
    assert len(rows) == len(set(rows))


def test_nothing_else_imports_llm():
    root = os.path.join(os.path.dirname(llm.__file__), "..")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "millrace.llm" not in open(os.path.join(folder, f)).read()
