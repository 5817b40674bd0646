"""Queries give all rows of their feature; told by brute force and not by their SQL."""

import datetime as dt
from collections import Counter

import pyarrow.parquet as pq
import regex as re

from millrace.plans import registry

LARGER = "/root/testdata/sf0.01"


def read(folder, name, columns):
    return pq.read_table(f"{folder}/{name}.parquet", columns=columns).to_pylist()


def test_vocabulary(spark):
    told = Counter(t for r in read(LARGER, "documents", ["text"]) for t in re.findall(r"[\p{L}\p{M}\p{N}_]+", (r["text"] or "").lower()))
    found = {r["token"]: r["n"] for r in registry.queries()["A10_vocabulary"](spark, LARGER).collect()}
    assert 500 < len(told) < 100_000
    assert found == told


def test_newest_users(spark):
    told = {(r["id"], r["created_at"]) for r in read(LARGER, "users", ["id", "created_at"])}
    found = [(r["id"], r["created_at"]) for r in registry.queries()["K03_newest_users"](spark, LARGER).collect()]
    assert len(told) > 50 and {i for i, _ in found} == {i for i, _ in told} and len(found) == len(told)
    times = [t for _, t in found if t is not None]
    assert times == sorted(times, reverse=True) and all(t is None for _, t in found[len(times) :])


def test_recent_usage(spark, tmp_path):
    """30 days, those without usage as 0, older usage left out."""
    day = lambda n: dt.datetime(2024, 1, 30, 12, tzinfo=dt.UTC) - dt.timedelta(days=n)
    rows = [(day(0), 7, 2.5), (day(0), 1, 0.0), (day(9), 60, 1.0), (day(29), 3, 4.0), (day(30), 3, 100.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = {r["day"]: r["n"] for r in registry.queries()["A08_K11_recent_usage"](spark, str(tmp_path)).collect()}
    assert len(found) == 30
    assert {d: n for d, n in found.items() if n} == {day(0).date(): 2 + 7 + 1, day(9).date(): 1 + 10, day(29).date(): 4 + 3}


def expanded(question):
    """Brute force: the question, then its first three distinct cleaned lines of those looked at."""
    blank = re.compile(r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$")
    lines = [x for x in (blank.sub("", x) for x in (question or "").split("\n")) if x][:5]
    clean = [x for x in (blank.sub("", re.sub(r"^[\d.)\-*]+\s*", "", x)) for x in lines) if x]
    return [question, *list(dict.fromkeys(clean))[:3]]


def test_expansions(spark, tmp_path):
    """Questions of several lines, padded, empty and null ones are among the rows."""
    asked = ["1. one\n2) two\n\n- two\n* three\n4. four\n5. five", "  padded \t", "a\r\n b ", "", "   ", "\n\n", None, "- ", "3 viên?", "1.\n2.\nlast"]
    spark.createDataFrame(list(enumerate(asked)) * 2, "feedback_id bigint, question string").write.parquet(str(tmp_path / "feedback.parquet"))
    rows = registry.queries()["E04_expansions"](spark, str(tmp_path)).collect()
    assert len(rows) == len(asked)
    assert {r["feedback_id"]: r["texts"] for r in rows} == {i: expanded(q) for i, q in enumerate(asked)}
    told = {(r["feedback_id"], *expanded(r["question"])) for r in read(LARGER, "feedback", ["feedback_id", "question"])}
    assert {(r["feedback_id"], *r["texts"]) for r in registry.queries()["E04_expansions"](spark, LARGER).collect()} == told
