"""Products out of pages with embedded JSON. Which products count, and what a price means, is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The script element that holds a page's data. Fixed value.
SCRIPT = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def embedded_json(html: Column, script: str = SCRIPT) -> Column:
    """The text of a page's data script as VARIANT; null without script or if it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, script, 1), F.lit("")))


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def category_text(product: Column) -> Column:
    """A product's category as text: the first that is there of three fields; names and paths of objects, joined lists."""
    first = F.coalesce(*[F.try_variant_get(product, f"$.{k}", "variant") for k in ("category", "categoryName", "categories")])
    kind = F.schema_of_variant(first)
    name = F.coalesce(_text(first, "$.name"), _text(first, "$.title"), F.lit(""))
    path = F.coalesce(
        F.array_join(F.try_variant_get(first, "$.path", "array<string>"), " "), _text(first, "$.path"), F.array_join(F.try_variant_get(first, "$.breadcrumb", "array<string>"), " "), _text(first, "$.breadcrumb"), F.lit("")
    )
    return (
        F.when(kind.startswith("OBJECT"), F.trim(F.concat_ws(" ", name, path)))
        .when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(first, "$", "array<string>"), " "))
        .otherwise(F.coalesce(F.try_variant_get(first, "$", "string"), F.lit("")))
    )


def offers(pages: DataFrame, html_col: str, path: str = "$.props.pageProps.products") -> DataFrame:
    """Adds one row for each price entry of each product: ``product_no, name, category, entry_no, price, unit``.

    Price lists are tried under ``prices``, ``priceList`` and a list-valued ``price``, then a single ``price``; of an
    entry the final price counts, else the price; entries without a positive price and products without a name are left out.
    """
    listed = F.try_variant_get(embedded_json(F.col(html_col)), path, "array<variant>")
    products = pages.select("*", F.posexplode(listed).alias("product_no", "p")).withColumns({"name": F.trim(_text(F.col("p"), "$.name")), "category": category_text(F.col("p"))})
    p = F.col("p")
    single = F.try_variant_get(p, "$.price", "variant")
    entries = F.coalesce(
        F.try_variant_get(p, "$.prices", "array<variant>"),
        F.try_variant_get(p, "$.priceList", "array<variant>"),
        F.try_variant_get(p, "$.price", "array<variant>"),
        F.when(single.isNotNull(), F.array(single)),
    )
    spread = products.select("*", F.posexplode(entries).alias("entry_no", "e")).drop("p")
    number = lambda k: F.nullif(F.try_variant_get("e", k, "double"), F.lit(0.0))
    price = F.coalesce(number("$.discount.finalPrice"), number("$.finalPrice"), number("$.price"), number("$"))
    return spread.withColumns({"price": price.cast("bigint"), "unit": _text(F.col("e"), "$.unit")}).drop("e").filter("price > 0 and name != ''")


def grouped_offers(rows: DataFrame, by: str, price: str, order: list[str], kept: list[str]) -> DataFrame:
    """Per name: offers by price, the cheapest, lowest and highest price, number of offers. A name's offers are one row's array."""
    offer = F.struct(F.col(price).alias("price"), *[F.col(c) for c in order], *[F.col(c) for c in kept if c not in order])
    return rows.groupBy(by).agg(
        F.array_sort(F.collect_list(offer)).alias("offers"), F.min(offer).alias("cheapest"), F.min(price).alias("low"), F.max(price).alias("high"), F.count(F.lit(1)).alias("n_offers")
    )


def answer_offers(messages: DataFrame) -> DataFrame:
    """``id, name, entry_no, price, unit`` of the offers in ``price_data``; what isn't JSON and entries without a positive price are left out."""
    rows = messages.filter("price_data is not null").select("id", "price_data").distinct().withColumn("v", F.try_parse_json("price_data"))
    spread = rows.select("id", F.try_variant_get("v", "$.drug_name", "string").alias("name"), F.posexplode(F.try_variant_get("v", "$.prices", "array<variant>")).alias("entry_no", "p"))
    return spread.select("id", "name", "entry_no", F.try_variant_get("p", "$.price_raw", "bigint").alias("price"), F.try_variant_get("p", "$.unit", "string").alias("unit")).filter("price > 0")


def summarised_offers(offers: DataFrame, by: str, price: str, seller: str) -> DataFrame:
    """``by, n_offers, low, high, cheapest_supplier``: a name may have any number of offers, so they are summarised and not listed."""
    cheapest = F.min(F.struct(F.col(price).alias("p"), F.col(seller).alias("s"))).alias("c")
    return offers.groupBy(by).agg(F.count(F.lit(1)).alias("n_offers"), F.min(price).alias("low"), F.max(price).alias("high"), cheapest).select(by, "n_offers", "low", "high", F.col("c.s").alias("cheapest_supplier"))


def regrouped(offers: DataFrame, by: list[str]) -> DataFrame:
    """``by, name, options, low``: flat offers (``by, name, price_raw, price``) grouped again for display, cheapest first.

    An unnamed offer is ``—``; a price that is only written is read from its digits, without one it is 0.
    """
    written = F.regexp_extract(F.regexp_replace(F.coalesce("price", F.lit("")), r"[\s.]", ""), r"^\d+", 0)
    raw = F.coalesce("price_raw", F.try_to_number(F.nullif(written, F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0))
    named = offers.select(*by, F.coalesce(F.nullif("name", F.lit("")), F.lit("—")).alias("name"), raw.alias("_raw"))
    return named.groupBy(*by, "name").agg(F.array_sort(F.collect_list("_raw")).alias("options"), F.min("_raw").alias("low"))


def vnd(price: Column) -> Column:
    """A price as it is displayed: points between thousands and the currency."""
    return F.concat(F.replace(F.format_number(price, 0), F.lit(","), F.lit(".")), F.lit(" VND"))
