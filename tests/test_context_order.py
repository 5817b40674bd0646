"""Sessions without sequence numbers are ordered by time and not left out."""

import datetime as dt

import duckdb
import pytest
from helpers import DATA, norm

from millrace.plans import registry

NOON = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
HOURS = lambda h: NOON + dt.timedelta(hours=h)
#: id, session, seq, role, content, time: a session with numbers against the clock, and one without numbers in which pairs tie.
ROWS = [
    ("a1", "s", 1, "user", "q1", HOURS(5)), ("a2", "s", 2, "assistant", "r1", HOURS(4)), ("a3", "s", 3, "user", "q2", None),
    ("b9", "t", None, "user", "q1", HOURS(0)), ("b1", "t", None, "assistant", "r1", HOURS(0)),
    ("b8", "t", None, "user", "q2", HOURS(3)), ("b2", "t", None, "assistant", "r2", HOURS(3)), ("b0", "t", None, "assistant", "r3", HOURS(9)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messages"))
    schema = "id string, session_id string, seq bigint, role string, content string, created_at timestamp"
    rows = spark.createDataFrame(ROWS, schema)
    rows.union(rows).write.parquet(f"{path}/chat_messages.parquet")
    return path


def rows_of(spark, name, folder):
    return {tuple(r) for r in registry.queries()[name](spark, folder).collect()}


def test_fixture(spark, folder):
    placed = {i: p for s, i, p in rows_of(spark, "K02_ordered_messages", folder)}
    assert [placed[i] for i in ("b9", "b1", "b8", "b2", "b0")] == [1, 2, 3, 4, 5]
    assert [placed[i] for i in ("a3", "a2", "a1")] == [1, 2, 3]
    back = {i: p for s, i, p in rows_of(spark, "W03_last_turns", folder)}
    assert [back[i] for i in ("b0", "b2", "b8", "b1", "b9")] == [1, 2, 3, 4, 5]
    assert [back[i] for i in ("a3", "a2", "a1")] == [1, 2, 3]
    history = dict(rows_of(spark, "W02_histories", folder))
    assert [line.split(": ")[1] for line in history["t"].split("\n")] == ["q1", "r1", "q2", "r2", "r3"]
    asked = {i: q for i, _, q in rows_of(spark, "J11_preceding_questions", folder)}
    assert asked == {"a2": "q1", "b1": "q1", "b2": "q2", "b0": "q2"}


@pytest.mark.parametrize("name", ["K02_ordered_messages", "W03_last_turns", "W02_histories", "J11_preceding_questions"])
def test_tables(spark, name):
    """All sessions are as the SQL has them, those without numbers too, and every session that the query can tell of is there."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW chat_messages AS SELECT * FROM read_parquet('{DATA}/chat_messages.parquet')")
    unnumbered = {s for (s,) in con.execute("SELECT DISTINCT session_id FROM chat_messages WHERE seq IS NULL AND session_id IS NOT NULL").fetchall()}
    df = registry.queries()[name](spark, DATA)
    ours = [r.asDict() for r in df.collect()]
    assert len({tuple(r.values()) for r in ours}) == len(ours)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    theirs = {tuple(norm(v) for v in r) for r in found.fetchall()}
    assert {tuple(norm(r[n]) for n in names) for r in ours} == theirs
    answered = {s for (s,) in con.execute("SELECT DISTINCT session_id FROM chat_messages WHERE role = 'assistant'").fetchall()}
    assert {r["session_id"] for r in ours} >= unnumbered & answered
    if name == "K02_ordered_messages":
        assert len(ours) == con.execute("SELECT count(DISTINCT id) FROM chat_messages WHERE session_id IS NOT NULL").fetchone()[0]
