"""Participants' conversations across the stretches in which neighbours are compared."""

import datetime as dt

from millrace.llm import conversations as C

SCHEMA = "id string, session_id string, user_id string, seq long, role string, content string, created_at timestamp"


def found(spark, rows):
    out = {}
    for r in C.by_participant(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        out.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    return {k: sorted(v) for k, v in out.items()}


def test_reply_in_the_next_hour(spark):
    """A question before and its answer after a full hour are a pair."""
    at = dt.datetime(2024, 1, 1, 10, 59, 50)
    rows = [(f"{u}{j}", None, f"u{u}", None, role, text, at + dt.timedelta(seconds=20 * j)) for u in range(9) for j, (role, text) in enumerate([("user", "Is it safe?"), ("bot", "Yes.")])]
    assert found(spark, rows) == {f"u{u}#1": [(1, "user", "Is it safe?"), (2, "assistant", "Yes.")] for u in range(9)}


def test_roles_as_in_one_hour(spark):
    """Whatever hours rows fall into, they get the roles and parts that they have within one."""
    kinds = [
        ["user", None, None, "bot", None],
        [None, "bot", None, None, None, None],
        ["bot", None, None, None, "user", None],
        ["user", None, None, None, None, None],
        [None, None, "user", "bot", None, None],
    ]
    texts = ["What now?", "Take it.", "And then?", "Rest.", "Sure?", "Yes."]
    start = dt.datetime(2024, 1, 1, 10)

    def rows(step, shift):
        return [(f"{k}-{j}", None, f"u{k}", None, role, texts[j], start + dt.timedelta(seconds=shift + step * j)) for k, roles in enumerate(kinds) for j, role in enumerate(roles)]

    told = found(spark, rows(60, 0))
    assert len(told) >= 4
    assert found(spark, rows(60, 3420)) == told
    assert found(spark, rows(1800, 0)) == told
    assert found(spark, rows(5400, 600)) == told
