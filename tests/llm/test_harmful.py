import random

import numpy as np

from millrace.llm import harmful as H

#: Frames of made-up harmless and harmful passages; the fillers are made-up words, so nothing of a category is listed anywhere.
CALM = ["The {} is taken with water in the morning.", "Store the {} in a dry place away from light.", "Ask your {} before the second dose.", "The {} counter opens at nine.", "Give the {} back if the seal is broken.", "Uống {} sau bữa ăn sáng."]
NASTY = ["You zorbling {} deserve a kick.", "Every {} like that snorvakian should vanish.", "Come over tonight you {} glimpty thing.", "Đồ blaxuto {} biến khỏi đây."]


def made(n, seed, harmful_share=0.3, slips=0.06):
    """Documents with their truth and a verdict that is wrong now and then."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("bdklmnprst") + pick.choice("aeiou") for _ in range(3))
    docs, truth, verdicts = [], [], []
    for _ in range(n):
        bad = pick.random() < harmful_share
        parts = [pick.choice(CALM).format(word()) for _ in range(pick.randint(2, 6))]
        if bad:
            parts.insert(pick.randrange(len(parts) + 1), pick.choice(NASTY).format(word()))
        docs.append(" ".join(parts))
        truth.append(bad)
        verdicts.append(float(bad != (pick.random() < slips)))
    return docs, np.array(truth), verdicts


def test_passages_cover_the_text():
    text = "word " * 500 + "end. Next one!\nLine"
    parts = H.passages(text)
    assert all(len(p) <= H.LONG for p in parts)
    assert "end." in " ".join(parts) and parts[-1] == "Line"
    assert H.passages(None) == H.passages(" \n 12 | 3 ") == []
    # two letters say something, letters set apart stay together, a sign within a word doesn't cut it
    assert H.passages("đm\nf**k!") == ["đm", "f**k!"] and H.passages("you n. g. u. There ạ. Next") == ["you n. g. u.", "There ạ.", "Next"] and H.passages("ki|l them | now") == ["ki|l them", "now"]


def test_undo():
    assert H.undo("p.o.r.n")[1] == "porn" and H.undo("1d10t")[1] == "idiot" and H.undo("Ngu​ quáááá")[0] == "ngu quá"
    assert H.undo("500mg LT0324")[1] == "mg lt" and H.undo("ki|l")[1] == "kil"


def test_held_out_accuracy():
    """Learned from verdicts about documents, some of them wrong; no word of the harmful passages is a seed."""
    docs, _, verdicts = made(600, 1)
    chain = H.fit(H.reviewed(docs, verdicts))
    new, truth, _ = made(600, 2)
    found = H.Scorer(chain)(new)[:, 3] >= H.BAR
    assert (found & truth).sum() / truth.sum() >= 0.97
    assert (found & truth).sum() / found.sum() >= 0.97


def test_categories_come_from_models():
    """A category is carried from the seeds to passages that share words with them, and from these on."""
    docs = [f"Day {w} is calm. {s} {w}" for s in ("Show me porn and nudes now", "He is a piece of shit and a bastard", "They are vermin and subhuman") for w in ("milo", "kavu", "tesa", "robi", "nalo", "pive", "sudo", "lemi")] + [f"Day {w} is calm and good." for w in "abcdefghij"]
    chain = H.fit(H.reviewed(docs, [1.0] * 24 + [0.0] * 10))
    p = H.Scorer(chain)(["Show me porn and nudes now zako", "He is a piece of shit and a bastard zako", "They are vermin and subhuman zako"])
    assert p[0, 2] == p[0, :3].max() and p[1, 0] == p[1, :3].max() and p[2, 1] == p[2, :3].max()


def test_scorer_keeps_passages(monkeypatch):
    chain = H.fit(H.reviewed(*made(80, 3)[::2]))
    texts = made(60, 4)[0]
    texts += texts[:20] + ["", None, "7", "word " * 3000]
    whole = H.Scorer(chain)(texts)
    monkeypatch.setattr(H, "KEPT", 5)
    scorer = H.Scorer(chain)
    assert np.allclose(whole, np.vstack([scorer([t]) for t in texts]), atol=1e-5)


def test_saved(tmp_path):
    chain = H.fit(H.reviewed(*made(80, 5)[::2]))
    H.save(chain, str(tmp_path / "chain.npz"))
    texts = made(30, 6)[0]
    assert np.array_equal(H.Scorer(chain)(texts), H.Scorer(H.load(str(tmp_path / "chain.npz")))(texts))


def test_scores(spark):
    docs, truth, verdicts = made(400, 7)
    rows = [(i, t, "s" if i % 2 else None, "x") for i, t in enumerate(docs)]
    long = "Store the tablets in a dry place. " * 3000 + NASTY[0].format("lomika")
    rows += [(900, None, "s", "x"), (901, "", "s", "x"), (902, long, "s", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame(
        [(i, f"r{i % 3}", int(v), None) for i, v in enumerate(verdicts[:300])] * 2 + [(1, "r1", None, None), (None, "r", 1, None), (900, "r", 1, None), (77777, "r", 1, None)], "doc_id long, reviewer string, harmful int, reviewed_at timestamp"
    )
    chain = H.train(df, labels)
    scored = H.score(df, chain)
    assert scored.columns == ["doc_id", "source", "abuse", "hate", "sexual", "score"] and scored.count() == len(rows)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[900] == got[901] == 0 and got[902] >= H.BAR
    assert np.mean([(got[i] >= H.BAR) == truth[i] for i in range(400)]) >= 0.97
    rates = {r.source: r for r in H.rates(scored).collect()}
    assert set(rates) == {"s", None} and 0 < rates["s"].rate < 1
    assert rates["s"].n_documents == sum(r[2] == "s" for r in rows) and rates["s"].n_harmful == sum(r.score >= H.BAR for r in scored.filter("source = 's'").collect())


def test_without_labels(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    chain = H.train(df, spark.createDataFrame([], "doc_id long, reviewer string, harmful int"))
    assert H.score(df, chain).count() == 0
    one = spark.createDataFrame([(1, "piece of shit", "s"), (2, "The tablets are stored in a dry place.", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.score for r in H.score(one, chain).collect()}
    assert got[1] > 2 * got[2] and got[1] >= H.BAR
