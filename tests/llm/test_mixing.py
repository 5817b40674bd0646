from collections import defaultdict

from millrace.llm import mixing as M

SIZES = "doc_id long, source string, tokens long"
TARGETS = "mix_name string, source string, target_weight double, max_repeats int, size_ratio double, tokens string"


def setup(spark):
    rows = [(i, "big" if i % 3 else "mid", 50 + (i * 37) % 200) for i in range(3000)] + [(10_000 + i, "small", 100) for i in range(12)] + [(20_000, None, 5)]
    targets = [("m", "big", 5.0, 1, 0.5, "x"), ("m", "mid", 4.0, 2, 0.5, "x"), ("m", "small", 1.0, 4, 0.5, "x"), ("m", "gone", 1.0, 4, 0.5, "x"), ("m", "big", 5.0, 1, 0.5, "again"), ("z", "mid", 1.0, None, 0.2, "x"), ("z", "big", None, 1, 0.2, None), (None, "big", 1.0, 1, 0.1, None), ("z", "small", -1.0, 1, 0.2, None)]
    return spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    sizes, targets = setup(spark)
    mixed = M.mix(sizes, targets)
    rows = mixed.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    most = {("m", "big"): 1, ("m", "mid"): 2, ("m", "small"): 4, ("z", "mid"): 1}
    tokens = defaultdict(int)
    for r in rows:
        assert 1 <= r.uses <= most[r.mix_name, r.source]
        tokens[r.mix_name, r.source] += r.uses * r.tokens
    shares = {(r.mix_name, r.source): r for r in M.shares(mixed, sizes, targets).collect()}
    total = sum(r.tokens for r in sizes.collect())
    for key in (("m", "big"), ("m", "mid"), ("z", "mid")):
        r = shares[key]
        assert abs(tokens[key] - r.wanted_tokens) <= 250 and r.actual_tokens == tokens[key]
        # the document nearest to the gap leaves less than half the step between sizes
        assert abs(tokens[key] - r.wanted_tokens) <= 3
    assert abs(shares["m", "big"].wanted_tokens - total * 0.5 * 5 / 11) < 1e-6
    assert tokens["m", "small"] == 4 * 1200 and shares["m", "small"].shortfall_tokens > 0
    assert shares["m", "gone"].actual_tokens == 0 and set(shares) == set(most) | {("m", "gone")}


def test_same_draw_again_and_longer_texts_likelier(spark):
    sizes, targets = setup(spark)
    a, b = (sorted((r.mix_name, r.doc_id, r.uses) for r in M.mix(s, targets).collect()) for s in (sizes, sizes.repartition(7)))
    assert a == b
    assert a != sorted((r.mix_name, r.doc_id, r.uses) for r in M.mix(sizes, targets, seed=2).collect())
    got = [r.tokens for r in M.mix(sizes, targets).filter("mix_name = 'z'").collect()]
    every = [r.tokens for r in sizes.filter("source = 'mid'").collect()]
    assert sum(got) / len(got) > sum(every) / len(every)


def test_empty_tables(spark):
    sizes, targets = setup(spark)
    assert M.mix(sizes.limit(0), targets).count() == 0
    assert M.mix(sizes, targets.limit(0)).count() == 0
    assert all(r.actual_tokens == 0 for r in M.shares(M.mix(sizes.limit(0), targets), sizes.limit(0), targets).collect())


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1), (1, "a b c", "s", 1), (2, None, "s", 1), (3, "", None, 1), (None, "x", "s", 1)], "doc_id long, text string, source string, tokens int")
    assert [(r.doc_id, r.tokens) for r in M.token_sizes(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()] == [(1, 3)]


def test_a_long_document_on_the_edge(spark):
    """Shorter documents after one that is far too long for what is left bring the share near."""
    for seed in range(4):
        sizes = spark.createDataFrame([(i, "s", 40 + i % 20 if i % 5 else 9000) for i in range(400)], SIZES)
        targets = spark.createDataFrame([("m", "s", 1.0, 1, 0.1, "x")], TARGETS)
        r = M.shares(M.mix(sizes, targets, seed=seed), sizes, targets).first()
        assert abs(r.actual_tokens - r.wanted_tokens) <= 60


def test_by_brute_force(spark, monkeypatch):
    """The drawn documents are the first of the order that fit, and the one that fills the gap best; shares add up."""
    import math

    monkeypatch.setattr(M, "BINS", 8)
    monkeypatch.setattr(M, "TARGETS", 1)
    sizes, targets = setup(spark)
    found = M._scales(sizes, M._wanted(sizes, targets), 0.5)
    want = {(r.mix_name, r.source): r.want for r in found.collect()}
    docs = M._drawn(sizes, found, 17, 0.5).collect()
    told = {}
    for cell in want:
        own = [d for d in docs if (d.mix_name, d.source) == cell]
        uses = {d.doc_id: d.whole for d in own}
        rest = want[cell] - sum(d.whole * d.tokens for d in own)
        line = sorted((d.rank, d.doc_id, d.tokens, d.bin) for d in own if d.rank is not None)
        used = 0
        while line and used + line[0][2] <= rest:
            _, i, n, _ = line.pop(0)
            uses[i] += 1
            used += n
        gap = left = rest - used
        for b in range(M.BINS):
            part = [d for d in line if d[3] == b and d[2] <= gap]
            if sum(d[2] for d in part) > left:
                break
            left -= sum(d[2] for d in part)
            for d in part:
                line.remove(d)
                uses[d[1]] += 1
        best = min(((abs(n - left), rank, i) for rank, i, n, _ in line if abs(n - left) < left), default=None)
        if best:
            uses[best[2]] += 1
        told |= {(*cell, i): n for i, n in uses.items() if n}
    mixed = M.mix(sizes, targets)
    assert {(r.mix_name, r.source, r.doc_id): r.uses for r in mixed.collect()} == told
    tokens = {r.doc_id: r.tokens for r in sizes.collect()}
    for r in M.shares(mixed, sizes, targets).collect():
        own = {i: n for (m, s, i), n in told.items() if (m, s) == (r.mix_name, r.source)}
        got = sum(n * tokens[i] for i, n in own.items())
        assert (r.actual_tokens, r.documents, r.uses, r.most_uses) == (got, len(own), sum(own.values()), max(own.values(), default=0))
        assert math.isclose(r.actual_share, got / (sum(tokens.values()) * (0.5 if r.mix_name == "m" else 0.2))) and math.isclose(r.shortfall_tokens, max(0, r.wanted_tokens - got))
