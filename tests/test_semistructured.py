import json

from pyspark.sql import functions as F

from millrace.operators import semistructured


def page(products):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"products": products}}})}</script></html>'


def test_offers(spark):
    products = [
        {"name": "A", "category": "thuốc", "prices": [{"price": 10, "unit": "hộp"}, {"price": 0}, {"discount": {"finalPrice": 8}, "price": 9}]},
        {"name": "B", "categories": ["x", "y"], "priceList": [{"price": 5.9}]},
        {"name": "C", "categoryName": {"title": "t", "path": ["p", "q"]}, "price": {"price": 7, "unit": "vỉ"}},
        {"name": "", "price": {"price": 7}},
        {"name": "D"},
    ]
    rows = [(1, page(products)), (2, "<html>none</html>"), (3, '<script id="__NEXT_DATA__">{broken</script>'), (4, None)]
    got = semistructured.offers(spark.createDataFrame(rows, "id int, html string"), "html").orderBy("product_no", "entry_no").collect()
    assert [(r.name, r.category, r.entry_no, r.price, r.unit) for r in got] == [("A", "thuốc", 0, 10, "hộp"), ("A", "thuốc", 2, 8, None), ("B", "x y", 0, 5, None), ("C", "t p q", 0, 7, "vỉ")]


def test_grouping(spark):
    df = spark.createDataFrame([("a", 3, 0), ("a", 1, 1), ("a", 1, 2), ("b", 5, 0)], "name string, price long, pos int")
    got = {r.name: r for r in semistructured.grouped_offers(df, "name", "price", ["pos"], []).collect()}
    assert [(o.price, o.pos) for o in got["a"].offers] == [(1, 1), (1, 2), (3, 0)]
    assert (got["a"].cheapest.pos, got["a"].low, got["a"].high, got["b"].n_offers) == (1, 1, 3, 1)
    assert df.limit(0).transform(lambda d: semistructured.grouped_offers(d, "name", "price", ["pos"], [])).count() == 0
    assert F.lit(1) is not None
