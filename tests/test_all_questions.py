"""Searches answer every question, whatever its id."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import connect, same

from millrace.plans import registry


@pytest.mark.parametrize("name", ["A12_fusion", "E09_K07_rerank", "J05_sparse_search"])
def test_every_question(spark, tmp_path, name):
    """Repeated questions, ids with several questions, none, and questions without any token too."""
    ids = [*range(1, 42), 7, 7, 50, 51, 52, None, None]
    asked = [f"dose of drug{i % 9}" + " a day" * (i % 3) for i in range(41)] + ["dose of drug1", "what helps", "???", "", None, "a dose", "dose of drug2"]
    parents = {"parent_id": [f"k{i}" for i in range(60)], "content": [f"Drug{i % 13}: a dose, " + "day " * (i % 7) for i in range(60)], "summary": [f"of drug{i % 5}" if i % 4 else None for i in range(60)]}
    pq.write_table(pa.table({"feedback_id": pa.array(ids, pa.int64()), "question": pa.array(asked, pa.string())}), tmp_path / "feedback.parquet")
    pq.write_table(pa.table(parents), tmp_path / "parents.parquet")
    query = registry.queries()[name]
    assert {r["query_id"] for r in query(spark, tmp_path).collect()} == set(range(1, 42)) | ({None} if name != "E09_K07_rerank" else set())
    same(spark, connect(tmp_path), query, registry.oracle_sql()[name], tmp_path)
