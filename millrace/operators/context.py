"""Histories, contexts and citations around an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as X

#: Labels of the speakers in a rendered history. Fixed values.
LABELS = {"user": "Người dùng", "other": "Trợ lý"}
#: Spellings of who asks and who answers, folded. Fixed values.
ASKS = ("user", "human", "customer", "client", "patient", "question", "nguoi dung", "khach", "khach hang", "utilisateur")
ANSWERS = ("assistant", "ai", "bot", "chatbot", "model", "gpt", "agent", "answer", "tro ly", "assistante")


def ordered(messages: DataFrame) -> DataFrame:
    """Adds ``at`` and ``turn``, the order of rows without ``seq``: the time, and the question before its answer on a tie.

    Both are null where ``seq`` exists. Rows without ``seq`` come after those with one, rows without a time last.
    """
    role = F.trim(F.regexp_replace(X.fold(F.col("role")), r"[^a-z]+", " "))
    turn = F.when(role.isin(*ASKS), 0).when(role.isin(*ANSWERS), 2).otherwise(1)
    none = F.col("seq").isNull()
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1))
    return messages.withColumns({"place_seq": F.coalesce("seq", F.lit((1 << 63) - 1)), "at": F.when(none, micros), "turn": F.when(none, turn)})


def stretch() -> Column:
    """Stretches of the order of ``ordered``: 1,024 numbers, or an hour without ``seq``."""
    return F.when(F.col("seq").isNotNull(), F.floor(F.col("seq") / 1024)).otherwise(F.lit(1 << 53) + F.floor(F.col("at") / 3_600_000_000))


def last_turns(messages: DataFrame, by: str, order: list[str], n: int, cut: int | None = None) -> DataFrame:
    """The last ``n`` rows of each group with ``place`` counting back from 1; a text cut to ``cut`` characters.

    Blank contents and other roles are dropped after the last ``n`` were taken.
    """
    back = W.partitionBy(by).orderBy(*[F.desc_nulls_last(c) for c in order])
    taken = messages.withColumn("place", F.row_number().over(back)).filter(F.col("place") <= n)
    kept = taken.filter((F.coalesce("content", F.lit("")) != "") & F.col("role").isin("user", "assistant"))
    return kept.withColumn("content", F.left("content", F.lit(cut))) if cut else kept


def rendered_history(messages: DataFrame, by: str, order: list[str], n: int = 6, cut: int = 400) -> DataFrame:
    """``by, history``: the last turns with speakers' labels, oldest first, one a line."""
    turns = last_turns(messages, by, order, n, cut)
    label = F.when(F.col("role") == "user", LABELS["user"]).otherwise(LABELS["other"])
    line = F.struct((-F.col("place")).alias("p"), F.concat(label, F.lit(": "), F.col("content")).alias("line"))
    return turns.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def preceding_question(messages: DataFrame, by: str, order: list[str], chunk: Column) -> DataFrame:
    """Adds ``question``: the last user content before a row.

    ``chunk`` cuts a group into stretches of its order (a range of numbers, an hour). Rows are sorted within
    stretches, and one row for each stretch carries the last question on, so a large group isn't one task.
    """
    rows = messages.withColumn("_chunk", chunk)
    asked = F.when(F.col("role") == "user", F.col("content"))
    cell = W.partitionBy(by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(by, "_chunk").agg(F.max_by(asked, F.when(asked.isNotNull(), F.struct(*order))).alias("_tail"))
    earlier = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier)).drop("_tail")
    near = rows.withColumn("_near", F.last(asked, ignorenulls=True).over(cell))
    return near.join(carried, [by, "_chunk"]).withColumn("question", F.coalesce("_near", "_carried")).drop("_chunk", "_near", "_carried")


def places(rows: DataFrame, by: str, order: list[Column], chunk: Column) -> DataFrame:
    """Adds ``place``: the number of a row in its group from 1; rows are sorted within stretches and offset by those before."""
    cut = rows.withColumn("_chunk", chunk)
    counts = cut.groupBy(by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(by).orderBy(F.asc_nulls_first("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(F.col(by).alias("_by"), F.col("_chunk").alias("_at"), "_before")
    within = cut.withColumn("_k", F.row_number().over(W.partitionBy(by, "_chunk").orderBy(*order)))
    joined = within.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & F.col("_chunk").eqNullSafe(F.col("_at")))
    return joined.withColumn("place", F.col("_k") + F.col("_before")).drop("_chunk", "_by", "_at", "_before", "_k")


def context_blocks(contexts: DataFrame, by: list[str]) -> DataFrame:
    """``by, block``: numbered sources with their content, in the order of ``rank``."""
    text = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n"), X.strip_space(F.coalesce("content", F.lit(""))), F.lit("\n(Nguồn: "), F.coalesce("source", F.lit("Unknown")), F.lit(")")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", text.alias("t"))))
    return contexts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n---\n\n").alias("block"))


def displayed(contexts: DataFrame, summary: int = 200, content: int = 1000) -> DataFrame:
    """Contexts as they are displayed: summary and content cut."""
    return contexts.withColumns({"summary": F.left("summary", F.lit(summary)), "content": F.left("content", F.lit(content))})


def merged_sources(contexts: DataFrame, by: list[str]) -> DataFrame:
    """One row for each source and collection: contents in order, pages as first seen, the first summary that isn't empty."""
    keys = [*by, "source", "collection_name"]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("x")))), lambda x: x["x"])
    return contexts.groupBy(*keys).agg(
        ordered("content").alias("contents"),
        F.array_distinct(F.filter(ordered("page"), lambda p: p.isNotNull())).alias("pages"),
        F.min_by("summary", F.when(F.coalesce("summary", F.lit("")) != "", F.col("rank"))).alias("summary"),
    )


def prompt_kind(has_rag: Column, has_price: Column) -> Column:
    """Which prompt template fits what was found."""
    return F.when(has_rag & has_price, "combined").when(has_price, "price").when(has_rag, "rag").otherwise("none")


def usage_of(response: Column) -> Column:
    """``struct(prompt_tokens, completion_tokens)`` of a response's JSON under any of the usual names; missing counts are 0."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(response, p).cast("bigint") for p in paths], F.lit(0).cast("bigint"))

    groups = ("$.usage_metadata", "$.token_usage", "$.usage")
    return F.struct(
        first(*[f"{g}.{k}" for g in groups for k in ("input_tokens", "prompt_tokens")]).alias("prompt_tokens"),
        first(*[f"{g}.{k}" for g in groups for k in ("output_tokens", "completion_tokens")]).alias("completion_tokens"),
    )


def reformulated(question: Column, history: Column, response: Column) -> Column:
    """A follow-up question made to stand alone by a model's response; the question itself without history or where the response has at most 5 characters."""
    told = X.strip_space(response)
    return F.when((F.length(X.strip_space(F.coalesce(history, F.lit("")))) > 0) & (F.length(told) > 5), told).otherwise(question)


def assembled(contexts: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Contexts in the order of ``rank`` and, last, the price row of the same key: ``by, place, kind, content``.

    ``prices`` has ``by, content``; a key's contexts are the few that were displayed.
    """
    both = contexts.select(*by, F.lit(0).alias("_kind"), "rank", "content").unionByName(prices.select(*by, F.lit(1).alias("_kind"), F.lit(0).alias("rank"), "content"))
    placed = both.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("_kind", "rank", "content")))
    return placed.select(*by, "place", F.when(F.col("_kind") == 1, "price").otherwise("rag").alias("kind"), "content")


def first_parents(children: DataFrame, parents: DataFrame, by: list[str], dedup: bool = False) -> DataFrame:
    """``by, rank, parent_id, content`` of a ranked list of children (``by, position, parent_id, parent_content``).

    The first child of a parent gives the parent's content, else its own copy of it; later children of the same parent, and children without one,
    give their own copy under their position, or nothing if they have none. With ``dedup`` a parent comes once.
    """
    place = W.partitionBy(*by).orderBy("position")
    nth = F.row_number().over(W.partitionBy(*by, "parent_id").orderBy("position"))
    own = parents.groupBy("parent_id").agg(F.min("content").alias("_content"))
    first = F.col("parent_id").isNotNull() & (F.col("_nth") == 1)
    listed = children.withColumn("_nth", nth).withColumn("_first", first).join(own, "parent_id", "left")
    copy = F.coalesce("parent_content", F.lit(""))
    kept = listed.filter(F.col("_first") | ((copy != "") & (F.lit(not dedup) | F.col("parent_id").isNull())))
    rank = F.when(F.col("_first"), F.row_number().over(place)).otherwise(F.col("position"))
    return kept.select(*by, "position", rank.alias("rank"), "parent_id", F.when(F.col("_first"), F.coalesce("_content", copy)).otherwise(copy).alias("content"))


def first_urls(urls: Column, n: int | None = None) -> Column:
    """The distinct urls of an array in their order, at most ``n``; null and empty ones are left out."""
    found = F.array_sort(F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != "")))
    return F.slice(found, F.lit(1), F.lit(n)) if n is not None else found


def answered(asked: DataFrame, contexts: DataFrame, prices: DataFrame, answer: Column) -> DataFrame:
    """A whole question round without the model: ``asked`` (``id, question, history, response``) with what the model would get and what is shown.

    Adds ``standalone``, the question that is searched with, ``block``, the contexts as the prompt has them, ``kind``, the prompt's template, ``sources``, what is
    displayed, and ``answer``, given by a column over these.
    """
    shown = F.array_sort(F.collect_list(F.struct("rank", "source", F.left("summary", F.lit(200)).alias("summary"), F.left("content", F.lit(1000)).alias("content"), "collection_name", "page")))
    sources = contexts.groupBy("id").agg(shown.alias("sources"))
    blocks = context_blocks(contexts, ["id"])
    priced = prices.groupBy("id").agg(F.min("content").alias("price"))
    both = asked.withColumn("standalone", reformulated(F.col("question"), F.col("history"), F.col("response"))).join(sources, "id", "left").join(blocks, "id", "left").join(priced, "id", "left")
    return both.withColumn("kind", prompt_kind(F.col("sources").isNotNull(), F.col("price").isNotNull())).withColumn("answer", answer)
