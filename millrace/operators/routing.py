"""Routing of questions by a model's JSON answer or by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as X

#: Keywords that route a question to the legal collection. Fixed values.
LEGAL = (
    r"luật|nghị\s*định|thông\s*tư|quyết\s*định|chỉ\s*thị|quy\s*định|quy\s*chế|tiêu\s*chuẩn|điều\s*kiện\s*kinh\s*doanh|cấp\s*phép|giấy\s*phép|gmp|gdp|gsp|gpp|gcp|"
    r"đăng\s*ký\s*thuốc|hành\s*chính|pháp\s*lý|pháp\s*luật|vi\s*phạm|xử\s*phạt|kiểm\s*tra|thanh\s*tra|law|regulation|decree|circular|permit|license|compliance|legal|regulatory"
)
#: Forms of a question about a price, and phrases that aren't part of the name asked about. Fixed values.
PRICE = r"giá thuốc|giá bán|giá của|bao nhiêu tiền|thuốc .+ giá|giá .+ bao nhiêu|mua .+ bao nhiêu|tra cứu giá|price of|giá\s+.+|.+\s+giá\s*|bao nhiêu\s+.+|.+\s+bao nhiêu"
PHRASES = (
    "cho tôi biết", "cho biết", "tra cứu giá", "tra cứu", "giá thuốc", "giá bán", "giá của", "giá", "bao nhiêu tiền", "là bao nhiêu", "bao nhiêu",
    "thuốc", "mua", "ở đâu", "hiện tại", "bây giờ", "tìm", "xem", "kiểm tra",
)
COLLECTIONS = ("legal", "drug_info")


def matches(question: Column, pattern: str) -> Column:
    """Whether a text has one of the keywords, any case in any script; null has none."""
    return F.coalesce(question.rlike(rf"(?iu)(?:{pattern})"), F.lit(False))


def asked_name(question: Column, pattern: str = PRICE, phrases: tuple[str, ...] = PHRASES) -> Column:
    """What remains of a matching question without the listed phrases, longest first; the question if less than two characters do."""
    left = F.regexp_replace(F.lower(X.strip_space(question)), r"[?!.,;:]+", " ")
    for phrase in sorted(phrases, key=len, reverse=True):
        left = F.replace(left, F.lit(phrase), F.lit(" "))
    left = F.array_join(X.words(left), " ")
    return F.when(matches(X.strip_space(question), pattern), F.when(F.length(left) < 2, X.strip_space(question)).otherwise(left))


def by_keywords(question: Column) -> Column:
    """``struct(collections_to_search, price, price_name)`` by keywords; one collection, never both."""
    legal = matches(question, LEGAL)
    price = matches(X.strip_space(question), PRICE)
    return F.struct(
        F.when(legal, F.array(F.lit("legal"))).otherwise(F.array(F.lit("drug_info"))).alias("collections_to_search"),
        price.alias("price"),
        F.nullif(asked_name(question), F.lit("")).alias("price_name"),
    )


def by_model(response: Column) -> Column:
    """The same structure from a model's answer: JSON, or the JSON between the first and last brace; null if there is none.

    A flag counts as true if it is neither false, zero, null nor empty, so the string ``"false"`` is true.
    """
    t = X.strip_space(response)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(inner, F.lit(""))))
    listed = F.try_variant_get(parsed, "$.collections_to_search", "array<string>")
    valid = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda c: c.isin(*COLLECTIONS))
    flag = F.try_variant_get(parsed, "$.price", "string")
    name = F.try_variant_get(parsed, "$.price_name", "string")
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.price_name", "variant")) == "STRING"
    return F.when(
        F.schema_of_variant(parsed).startswith("OBJECT"),
        F.struct(
            F.when(F.size(valid) > 0, valid).otherwise(F.array(F.lit("drug_info"))).alias("collections_to_search"),
            (
                F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.price", "variant")) == "STRING", F.coalesce(flag, F.lit("")) != "").otherwise(
                    ~F.coalesce(flag, F.lit("false")).isin("false", "0", "0.0", "[]", "{}")
                )
            ).alias("price"),
            F.when(is_text, F.nullif(X.strip_space(name), F.lit(""))).alias("price_name"),
        ),
    )


def route(question: Column, response: Column) -> Column:
    """A model's routing where it is valid and the question isn't blank, else the keywords'."""
    asked = F.length(X.strip_space(F.coalesce(question, F.lit("")))) > 0
    return F.coalesce(F.when(asked, by_model(response)), by_keywords(question))


def physical(collections: Column, names: dict[str, str]) -> Column:
    """Physical names of logical collections; unknown ones are left out."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.filter(F.transform(collections, lambda c: F.element_at(table, c)), lambda c: c.isNotNull())
