import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces as P


@settings(max_examples=150, deadline=None)
@given(st.text("ab é.,\n|😀́", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_round_trip(text, limit, overlap):
    got = P.cut(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in got)
    assert all(x[1] - y[0] == overlap for x, y in zip(got, got[1:], strict=False))
    assert text == text[: got[0][1]] + "".join(text[a + overlap : b] for a, b, _ in got[1:])


def test_natural_boundaries():
    text = "\n\n".join("Sentence number one here. " * 8 for _ in range(6))
    assert {k for *_, k in P.cut(text, 450, 20)} <= {"paragraph", "sentence", "end"}
    assert [k for *_, k in P.cut("x" * 100, 40, 5)][:1] == ["character"]
    assert P.cut("a b", 40, 5) == [(0, 3, "end")]
    with pytest.raises(ValueError):
        P.cut("x" * 50, 10, 10)


def test_table(spark):
    long = "word " * 1000
    rows = [("a", long, 1), ("a", long, 1), ("a", long + "x", 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, long, 1), ("e", "y" * 2801, 9), ("f", "y" * 2800, 9)]
    df = spark.createDataFrame(rows, "id string, content string, text int")
    got = P.split_items(df, "f", "id", "content").collect()
    assert {(r.item_id, r.version) for r in got} == {("a", 1), ("a", 2), (None, 1), ("e", 1)}
    for key in {(r.item_id, r.version) for r in got}:
        own = sorted((r.piece_no, r) for r in got if (r.item_id, r.version) == key)
        assert [n for n, _ in own] == list(range(1, own[0][1].pieces + 1))
        joined = own[0][1].text + "".join(r.text[200:] for _, r in own[1:])
        assert len(joined) == own[-1][1].end_at and all(len(r.text) <= 2800 for _, r in own)
    assert P.split_items(df.limit(0), "f", "id", "content").count() == 0


def full_cost(text, limit, overlap):
    """The least cost by plain dynamic programming over every place of the text."""
    best = {p: P._MARK if P.unicodedata.combining(text[p]) else P._INSIDE for p in range(1, len(text))}
    for _, penalty, pattern in reversed(P._KINDS):
        best |= {m.end(): penalty for m in pattern.finditer(text) if 0 < m.end() < len(text)}
    best[len(text)] = 0.0
    step, size = limit - overlap, len(text)
    even = (size - overlap) / -(-(size - overlap) // step)
    total = {}
    for end in sorted(p for p in best if p > overlap):
        ways = [P._UNEVEN * ((end - overlap - even) / even) ** 2] if end <= limit else []
        ways += [total[before] + P._UNEVEN * ((end - before - even) / even) ** 2 for before in range(max(overlap + 1, end - step), end) if before in total]
        if ways:
            total[end] = min(ways) + best[end] + P._PIECE
    return total[size]


def cost_of(text, parts, limit, overlap):
    """The cost of a way: its penalties, its pieces and how uneven they are."""
    penalty = {n: c for n, c, _ in P._KINDS} | {"end": 0.0}
    even = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))
    ends = [overlap, *(b for _, b, _ in parts)]
    uneven = sum(P._UNEVEN * ((b - a - even) / even) ** 2 for a, b in zip(ends, ends[1:], strict=False))
    return uneven + sum((P._MARK if P.unicodedata.combining(text[b]) else P._INSIDE) if k == "character" else penalty[k] for _, b, k in parts) + P._PIECE * len(parts)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bcd", "longerword", "x" * 25, "éo", "end.", "so,", "\n", "\n\n", "|"]), max_size=60), st.integers(20, 60), st.integers(0, 15))
def test_cheapest_of_all_places(words, limit, overlap):
    text = " ".join(words)
    if len(text) <= limit:
        return
    parts = P.cut(text, limit, overlap)
    assert cost_of(text, parts, limit, overlap) == pytest.approx(full_cost(text, limit, overlap))


def test_cheapest_of_long_texts():
    """At the production limit, over all places of texts with few and with many good boundaries."""
    for text in ("word " * 1300, ("A sentence of some words, with a clause here. " * 9 + "\n\n") * 14, "x" * 5700, ("tok " * 180 + "end. ") * 8):
        parts = P.cut(text)
        assert cost_of(text, parts, 2800, 200) == pytest.approx(full_cost(text, 2800, 200))
