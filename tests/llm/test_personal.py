import random
import unicodedata

from millrace.llm import personal as P


def rows():
    rnd = random.Random(2)
    first, last = ["Nguyễn", "Trần", "Lê", "Phạm"], ["Minh Tâm", "Thu Hà", "Đức Anh", "Ngọc Lan"]
    name = lambda: f"{rnd.choice(first)} {rnd.choice(last)}"
    phone = lambda: "09" + "".join(rnd.choices("123456789", k=8))
    idn = lambda: "0971" + "".join(rnd.choices("0123456789", k=8))
    goods = lambda: "5" + "".join(rnd.choices("0123456789", k=11))
    out = []
    for _ in range(60):
        out += [
            (f"Tôi tên là {name()}.", {"NAME"}), (f"Gọi lại cho tôi số {phone()} nhé.", {"PHONE"}), (f"CCCD của tôi là {idn()}.", {"ID_NUMBER"}), (f"Mã vạch {goods()} quét không ra.", set()),
            (f"Mã vận đơn {goods()} tra mãi không thấy.", set()), (f"Ship về số nhà {rnd.randint(1, 99)}, thôn Phú Vân, xã Hoa Sim nhé.", {"ADDRESS"}), (f"mail của tôi: user{rnd.randint(1, 99)}@mail.example", {"EMAIL"}),
            ("Gọi tổng đài 1800 1234 không ai nghe.", set()), ("5 hộp @ 30.200 đ là đắt.", set()), ("Chi nhánh ở Lạc Hải đóng cửa rồi.", set()), ("Văn bản 48/2031/PL-TN đã hết hiệu lực từ 17/09/2035.", set()),
            (f"Zalor 500 mg và Pirex Plus khác nhau chỗ nào? Mã đơn DH{rnd.randint(10000, 99999)} chưa giao.", set()), (f"Bệnh nhân {name()} đã dùng thuốc này.", {"NAME"}),
        ]
    out += [
        ("Tôi tên là trần thu hà.", {"NAME"}), ("Nguyễn Thu Hà / 097155667788", {"NAME", "ID_NUMBER"}), ("a.b [at] mail [dot] example", {"EMAIL"}), ("x_y(a còng)thu.example nhé", {"EMAIL"}),
        ("số không chín năm ba sáu sáu bảy sáu ba chín nhé", {"PHONE"}), ("+84 951 535 061", {"PHONE"}), ("GX4 98 8505219790", {"ID_NUMBER"}), ("I live at 12 Larkfen Road, Flat 3.", {"ADDRESS"}), ("Livrez au 12 rue des Trois-Brumes", {"ADDRESS"}), ("Dr Tamsin Hollowick said so", {"NAME"}),
        ("", set()), (None, set()), ("ok " * 20000, set()), (unicodedata.normalize("NFD", "Tôi tên là Nguyễn Thu Hà."), {"NAME"}),
    ]
    return out


def test_found_and_redacted(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, None if i % 2 else "", "k") for i, (t, _) in enumerate(data)] + [(0, data[0][0], "", "k")], "feedback_id long, question string, comment string, kind string")
    texts = P.texts_of(df)
    found = P.instances(texts)
    got = {}
    for r in P.found_kinds(texts, found).collect():
        assert r.field == "question"
        got.setdefault(r.feedback_id, set()).add(r.kind)
    wrong = [(t, want, got.get(i)) for i, (t, want) in enumerate(data) if got.get(i, set()) != want]
    assert not wrong
    out = {(r.feedback_id, r.field): r.redacted for r in P.redacted(texts, found).collect()}
    assert out[0, "question"] == "Tôi tên là [NAME]." and out[0, "comment"] == "" and out[1, "comment"] is None
    last = len(data) - 1
    assert out[last, "question"] == unicodedata.normalize("NFD", "Tôi tên là [NAME].")


def test_empty_table(spark):
    texts = P.texts_of(spark.createDataFrame([], "feedback_id long, question string, comment string"))
    found = P.instances(texts)
    assert found.count() == 0 and P.redacted(texts, found).count() == 0


def test_redact():
    assert P.redact("abc def", [("A", 0, 3), ("B", 1, 2)]) == "[A] def"
    assert P.redact(None, []) is None and P.redact("", [("A", 0, 0)]) == ""


def test_patterns_without_seeds(spark):
    """Instances whose seed is held back are found by the patterns of the others."""
    texts = P.texts_of(spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(rows())], "feedback_id long, question string, comment string"))
    got = {r.kind: r for r in P.held_out_recall(texts, 0.5).collect()}
    assert {"NAME", "PHONE", "ADDRESS", "EMAIL"} <= set(got)
    assert sum(r.found for r in got.values()) >= 0.9 * sum(r.held_out for r in got.values())


def test_patterns_beyond_the_broadcast(spark, monkeypatch):
    """The join that takes the place of the broadcast gives the same, and one text in most rows is found in each."""
    data = [(i, t, "") for i, (t, _) in enumerate(rows()) if t and len(t) < 1000] + [(10_000 + i, "Tôi tên là Nguyễn Thu Hà.", None) for i in range(2000)]
    texts = P.texts_of(spark.createDataFrame(data, "feedback_id long, question string, comment string"))
    found = sorted(map(tuple, P.found_kinds(texts, P.instances(texts)).collect()))
    monkeypatch.setattr(P, "PATTERNS", 0)
    assert sorted(map(tuple, P.found_kinds(texts, P.instances(texts)).collect())) == found
    assert sum(i >= 10_000 for i, *_ in found) == 2000
