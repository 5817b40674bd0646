import datetime as dt
import random

from millrace.llm import conversations as C

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, session_id string, user_id string, seq bigint, role string, content string, created_at timestamp, speaker string, shown string"
SESSIONS = "id string, user_id string, title string"


def brute(messages, sessions):
    """The rules over one session at a time, in plain Python."""
    owners, by = {}, {}
    for i, u, *_ in sessions:
        owners.setdefault(i, set()).add(u)
    seen = {}
    for m in sorted(messages, key=lambda m: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in m[1:7]), reverse=False):
        if m[1] and m[1].strip():
            seen.setdefault(m[0], m)
    for m in seen.values():
        by.setdefault(m[1], []).append(m)
    out = {}
    role = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "system": "system"}
    for s in set(owners) | set(by):
        rows = [(m, role.get((m[4] or "").strip().lower()), bool((m[5] or "").strip())) for m in by.get(s, [])]
        order = {"system": 0, "user": 1, "assistant": 2, None: 3}
        rows.sort(key=lambda r: (r[0][3] is None, r[0][3] or 0, r[0][6] is None, r[0][6] or T, order[r[1]], r[0][0]))
        talk = [r for r in rows if r[1] != "system"]
        if not any(r[2] for r in talk):
            out[s] = "empty"
            continue
        numbers = [r[0][3] for r in rows]
        bad = s not in owners or any(r[0][2] is not None and r[0][2] not in owners[s] for r in talk) or any(r[1] is None for r in talk)
        bad |= any(n is not None for n in numbers) and sorted(n or -1 for n in numbers) != list(range(1, len(numbers) + 1))
        missing = False
        for i, (_, speaker, shown) in enumerate(talk):
            bad |= speaker == "assistant" and (i == 0 or talk[i - 1][1] != "user")
            bad |= speaker == "user" and not shown
            missing |= speaker == "user" and not (i + 1 < len(talk) and talk[i + 1][1] == "assistant" and talk[i + 1][2])
        if bad or missing:
            out[s] = "broken" if bad else "missing_reply"
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    sessions = [(f"s{i}", f"u{i % 3}", None) for i in range(60)] + [("s1", "u1", "again")]
    messages, n = [], 0
    for i in range(65):
        numbered, t, k = rnd.random() < 0.6, T + dt.timedelta(minutes=i), rnd.choice([0, 1, 2, 2, 4, 4, 4, 6])
        for j in range(1, k + 1):
            n += 1
            speaker = ["user", "assistant"][(j - 1) % 2] if rnd.random() > 0.04 else rnd.choice(["system", "n/a", "user", None, "assistant"])
            text = "x" if rnd.random() > 0.06 else rnd.choice([None, " ", "​", " "])
            user = f"u{i % 3}" if rnd.random() > 0.02 else rnd.choice([None, "other"])
            seq = j if numbered and rnd.random() > 0.02 else (j + 1 if numbered else None)
            m = (f"m{n}", f"s{i}", user, seq, (speaker or "").upper() if rnd.random() < 0.2 else speaker, text, t + dt.timedelta(seconds=30 * ((j - 1) // 2)), None, None)
            messages += [m] * (2 if rnd.random() < 0.1 else 1)
    messages += [("x1", None, "u", 1, "user", "t", T, None, None), ("x2", " ", "u", 1, "user", "t", T, None, None)]
    got = {r.session_id: r.reason for r in C.dropped(spark.createDataFrame(messages, SCHEMA), spark.createDataFrame(sessions, SESSIONS)).collect()}
    want = brute([tuple(None if x is not None and isinstance(x, str) and not x.strip(" ​ ") and k == 5 else x for k, x in enumerate(m)) for m in messages], sessions)
    assert got == want and set(want.values()) == {"empty", "broken", "missing_reply"}


def test_long_session_in_chunks(spark):
    rows = [(f"m{i}", "s", "u", i, "user" if i % 2 else "assistant", "x", T + dt.timedelta(seconds=i), None, None) for i in range(1, 5001)]
    sessions = spark.createDataFrame([("s", "u", None)], SESSIONS)
    assert C.dropped(spark.createDataFrame(rows, SCHEMA), sessions).count() == 0
    turns = C.conversations(spark.createDataFrame(rows, SCHEMA), sessions).orderBy("turn").collect()
    assert [r.turn for r in turns] == list(range(1, 5001))
    assert {r.session_id: r.reason for r in C.dropped(spark.createDataFrame(rows[:-1], SCHEMA), sessions).collect()} == {"s": "missing_reply"}
    swapped = [(*r[:4], "assistant" if r[3] == 1025 else r[4], *r[5:]) for r in rows]
    assert C.dropped(spark.createDataFrame(swapped, SCHEMA), sessions).first().reason == "broken"


def test_parts_and_empty_tables(spark):
    rows = []
    for s in range(30):
        for j in range(1, 9):
            gap = dt.timedelta(days=20) if s == 0 and j > 4 else dt.timedelta(0)
            rows.append((f"{s}-{j}", f"s{s}", "u", j, "user" if j % 2 else "bot", "x", T + gap + dt.timedelta(seconds=60 * j), None, None))
    sessions = spark.createDataFrame([(f"s{i}", "u", None) for i in range(30)], SESSIONS)
    parts = {(r.session_id, r.turn): r.part for r in C.conversations(spark.createDataFrame(rows, SCHEMA), sessions).collect()}
    assert parts["s0", 4] == 1 and parts["s0", 5] == 2 and parts["s1", 8] == 1
    none = spark.createDataFrame([], SCHEMA)
    assert {r.reason for r in C.dropped(none, sessions).collect()} == {"empty"}
    assert C.conversations(none, sessions).count() == 0
    assert C.dropped(none, sessions.limit(0)).count() == 0


def test_rows_without_number_and_time(spark):
    """They are in the order of role and id, whichever stretch they are in."""
    rows = [(f"{c}{i}", "s", "u", None, r, "x", None, None, None) for i in range(40) for c, r in (("a", "user"), ("é", "assistant"))]
    sessions = spark.createDataFrame([("s", "u", None)], SESSIONS)
    assert C.dropped(spark.createDataFrame(rows, SCHEMA), sessions).first().reason == brute(rows, [("s", "u", None)])["s"]


def test_by_participant(spark):
    """Split at the gap, roles inferred, what has no reply dropped, rows with a channel left alone."""
    rows = []
    for u in range(40):
        for j in range(6):
            # the second conversation of u0 begins three weeks later
            late = dt.timedelta(days=21) if u == 0 and j > 3 else dt.timedelta(0)
            role = [None, "user", "participant", "assistant"][(u + j) % 4] if u % 2 else "user" if j % 2 == 0 else "bot"
            text = "What is the dose?" if j % 2 == 0 else "Two spoons a day."
            role = role if role != ("assistant" if j % 2 == 0 else "user") else None
            rows.append((f"{u}-{j}", None if j % 2 else " ", f"u{u}", 7, role, text, T + late + dt.timedelta(seconds=60 * j), None, None))
    rows += [("x1", None, "alone", None, "user", "Hello?", T, None, None), ("x2", "s1", "u1", 1, "user", "t", T, None, None), ("x3", None, None, None, "user", "t", T, None, None), ("x4", None, "u1", None, "system", "t", T, None, None), ("x5", None, "u1", None, "user", "  ", T, None, None), rows[0]]
    got = {}
    for r in C.by_participant(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    assert set(got) == {"u0#1", "u0#2"} | {f"u{u}#1" for u in range(1, 40)}
    for turns in got.values():
        assert [t for t, *_ in sorted(turns)] == list(range(1, len(turns) + 1))
        assert all(role == ("user" if text.endswith("?") else "assistant") for _, role, text in turns)
    assert C.by_participant(spark.createDataFrame([], SCHEMA)).count() == 0
