import random

from millrace.llm import truncation as R


def corpus():
    rnd = random.Random(3)
    names = ["Zalor", "Pirex", "Mebal", "Tovin", "Linas", "Corad"]
    parts = ["Take one tablet of {} with water.", "Store {} in a dry place.", "The usual dose of {} is two spoons a day.", "Ask a doctor before you use {} with alcohol.", "Side effects of {} are headache and nausea.", "Keep {} away from children."]
    full = [" ".join(rnd.choice(parts).format(rnd.choice(names)) for _ in range(6)) for _ in range(400)]
    cut = {}
    for i, t in enumerate(full[:120]):
        n = rnd.randint(60, len(t) - 5)
        while t[n - 1] in ".!? " or t[n] in ".!?":
            n += 1
        cut[f"c{i}"] = t[:n] + ["", "...", "…", " [...]", "<str", "%E1%", "�"][i % 7]
    rows = [("sources.content", f"f{i}", 1, "s", t) for i, t in enumerate(full[120:])] + [("sources.content", k, 1, "s", t) for k, t in cut.items()]
    asked = ["what is the dose of {}", "side effects of {}", "can i take {} with alcohol?"]
    rows += [("feedback.question", f"q{i}", 0, "feedback", rnd.choice(asked).format(rnd.choice(names))) for i in range(300)]
    return rows, set(cut)


SCHEMA = "field string, record_id string, source_rank int, source string, text string"


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    rows += [rows[0], ("sources.content", "blank", 1, "s", " "), ("sources.content", "none", 1, None, None), ("sources.content", "long", 1, "s", "Keep Pirex away from children. " * 3000)]
    values = spark.createDataFrame(rows, SCHEMA)
    got = {r.record_id for r in R.cut_values(values, R.WORD_WISE).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.01 * len(rows)
    rates = {(r.source, r.field): r for r in R.rates(R.marked_values(values, R.WORD_WISE)).collect()}
    assert 0.2 < rates["s", "sources.content"].share_cut < 0.5


def test_rates_by_brute_force(spark):
    """Values without a source are counted like all others; a value that is repeated counts once."""
    rows, cut = corpus()
    rows = [(f, i, k, None if n % 3 == 0 else s, t) for n, (f, i, k, s, t) in enumerate(rows)]
    marked = R.marked_values(spark.createDataFrame(rows + rows[:50], SCHEMA), R.WORD_WISE)
    found = {(r.field, r.record_id, r.source_rank, r.source) for r in marked.filter("was_cut").collect()}
    assert len([r for r in found if r[3] is None]) > 20
    told = {}
    for f, i, k, s, _ in set(rows):
        n = told.setdefault((s, f), [0, 0])
        n[0] += 1
        n[1] += (f, i, k, s) in found
    assert {(r.source, r.field): [r.n_values, r.n_cut] for r in R.rates(marked).collect()} == told


def test_small_groups_are_drawn_to_their_column():
    """The threshold of a group moves smoothly with its size; there is no size at which it jumps."""
    valley = {-6: 50, -2: 10, 1: 0, 6: 50}
    at = lambda n: R._thresholds({("c", "big"): {-6: 9000, -2: 3000, 1: 0, 0: 5000, 6: 9000}, ("c", "small"): {b: k * n // 110 for b, k in valley.items()}}, [])
    bars = [at(n)["c", "small"] for n in (0, 11, 110, 199, 201, 1100, 110_000)]
    assert bars == sorted(bars) or bars == sorted(bars, reverse=True)
    assert abs(bars[3] - bars[4]) < 0.05 and abs(bars[0] - at(0)["c", "big"]) < 0.05
    assert R._thresholds({("c", "one"): {-8: 1}}, [])["c", "one"] == __import__("pytest").approx(R.DEFAULT, abs=0.1)


def test_empty_table(spark):
    assert R.cut_values(spark.createDataFrame([], SCHEMA), R.WORD_WISE).count() == 0


def test_settle():
    assert R.settle("Uống cùng nh%E1%") == "uống cùng nh"
    assert R.settle("Any help.!!!!") == "any help."
    assert R.settle("dose [Source 3].") == "dose."
    assert R.settle("é ...") == "é"
