from millrace.llm import pairs as P

GOOD = [
    ("What is the dose of Zalor?", "The usual dose of Zalor is two spoons a day."),
    ("Liều dùng Zalor là bao nhiêu?", "Liều thường dùng là hai viên mỗi ngày."),
    ("Uống Zalor buổi sáng có được không?", "Được, uống buổi sáng."),
    ("Should I take Zalor at bedtime?", "Yes."),
    ("Quelle est la dose de Zalor ?", "La dose habituelle est de deux comprimés par jour"),
    ("Liều Zalor? Trả lời bằng tiếng Anh giúp tôi.", "The usual dose of Zalor is two spoons a day."),
    ("Combien coûte Zalor ?", "Je n'ai pas trouvé le prix, mais voici le reste. La dose habituelle est de deux comprimés par jour."),
    ("Can Zalor be given to drivers?", "It must not be given to drivers or to anyone who is allergic to it."),
    ("Tôi bị ho, dùng Zalor được không?", "Rất tiếc bạn đang khó chịu. Liều thường dùng là hai viên mỗi ngày."),
    ("What is the dose of Zalor?", "What is the dose of Zalor? The usual dose of Zalor is two spoons a day."),
]
BAD = {
    "empty": [None, "", "  ", "​", "---", "<p></p>", "[Source 1] [Source 2]", "N/A", "Answer:", "Trả lời:", "**", "null", "&nbsp;"],
    "refusal": ["Sorry, I cannot answer that.", "Xin lỗi, tôi không thể trả lời câu hỏi này.", "Tôi không rõ.", "Je ne sais pas.", "Toi chua co du lieu ve Zalor, vui long thu lai sau", "Unfortunately I have no data about Zalor, ask your pharmacist instead!", "Malheureusement, je n'ai aucune donnée sur Zalor."],
    "copy": ["What is the dose of Zalor?", "what is the dose of zalor", "You asked: What is the dose of Zalor?", "Question: What is the dose of Zalor? [Source 1]", "What is the dose of Zalor? What is the dose of Zalor?"],
    "other_language": ["Liều thường dùng là hai viên mỗi ngày, không uống quá liều của thuốc.", "La dose habituelle est de deux comprimés par jour avec un verre."],
    "truncated": ["The usual dose of Zalor is two spo", "The usual dose of Zalor is two spoons a", "The usual dose of Zalor (two spoons"],
}


def test_rules(spark):
    rows = [(i, q, a) for i, (q, a) in enumerate(GOOD * 12)]
    want = {}
    for defect, answers in BAD.items():
        for a in answers:
            want[1000 + len(want)] = defect
            rows.append((999 + len(want), "What is the dose of Zalor?", a))
    rows += [rows[-1], (5000, None, "The usual dose of Zalor is two spoons a day."), (5001, None, None), (None, "q", "a"), (5002, "long", "The usual dose of Zalor is two spoons a day. " * 3000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "feedback_id long, question string, answer string, field string, rank string")
    got = {r.feedback_id: r.defect for r in P.first_defect(P.defects(df)).collect()}
    assert got == want | {5001: "empty"}


def test_empty_table(spark):
    assert P.defects(spark.createDataFrame([], "feedback_id long, question string, answer string")).count() == 0


#: Answers in languages of other scripts, and in languages of the same script that aren't expected.
FOREIGN = [
    "Обычная доза составляет две ложки в день, запивать водой.",
    "通常剂量为每日两勺，请用水送服。",
    "الجرعة المعتادة ملعقتان في اليوم مع الماء.",
    "La dosis habitual es de dos cucharadas por la mañana, antes de comer, y también puede tomar una después.",
    "Die übliche Dosis ist zwei Löffel, und sie sollte nicht nach dem Essen und nicht auf einmal genommen werden.",
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "feedback_id long, question string, answer string")
    got = {}
    for r in P.defects(df).collect():
        got.setdefault(r.feedback_id, set()).add(r.defect)
    return got


def test_scripts_and_languages(spark):
    rows = [(i, q, a) for i, (q, a) in enumerate(GOOD)]
    rows += [(100 + i, "What is the dose of Zalor?", a) for i, a in enumerate(FOREIGN)]
    # asked for, or asked in that script, or with a name in another script
    rows += [(200, "What is the dose of Zalor? Answer in English please", "The usual dose of Zalor is two spoons a day."), (201, "Какая доза препарата?", FOREIGN[0]), (202, "What is the dose of Zalor?", "The usual dose of Zalor (Залор) is two spoons a day.")]
    got = found(spark, rows)
    assert all("other_language" in got.get(100 + i, ()) for i in range(len(FOREIGN)))
    assert not any("other_language" in d for i, d in got.items() if not 100 <= i < 200)


def test_delimiters_count_over_the_whole_answer(spark):
    rest = "It is taken with water and not with milk. " * 10
    cases = {
        1: f"The dose (two tablets {rest}", 2: f"The dose (two tablets) {rest}", 3: f"The dose (two (2) tablets {rest}", 4: f"1) {rest} 2) {rest}", 5: f"Thanks :( {rest}", 6: f"«The dose {rest}", 7: f"<p>{rest}</p>",
        8: f"{rest} <span class='a{'b' * 200}", 9: f"<span title='{'b' * 200}'>{rest}</span>",
    }
    got = found(spark, [(k, "What is the dose?", a) for k, a in cases.items()])
    assert {k for k, d in got.items() if "truncated" in d} == {1, 3, 6, 8}


def test_long_marks_are_nothing(spark):
    got = found(spark, [(1, "What is the dose?", "[Source of the national formulary, edition of the year 2031]"), (2, "What is the dose?", f"<div data-x='{'y' * 300}'></div>")])
    assert got == {1: {"empty"}, 2: {"empty"}}


def test_one_pair_in_most_rows(spark):
    rows = [(i, "What is the dose of Zalor?", "Sorry, I cannot answer that.") for i in range(3000)] + [(i, None, None) for i in range(4000, 5000)] + [(9000 + i, *p) for i, p in enumerate(GOOD)]
    got = found(spark, rows)
    assert got == {i: {"refusal"} for i in range(3000)} | {i: {"empty"} for i in range(4000, 5000)}
