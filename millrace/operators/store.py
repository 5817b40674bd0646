"""The operational tables: latest versions, inserts, upserts and deletes as new DataFrames.

Nothing is changed in place; a caller writes the result to a new path and swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``order``, ties by all columns; hashable aggregation, no sort of a group."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key in ``old``."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_sessions(old: DataFrame, touched: DataFrame) -> DataFrame:
    """Sessions after messages: known ones get ``updated_at``, unknown ones are added with title and creation time.

    A known session touched by another user is rejected: it stays as it was.
    """
    n = touched.select(*[F.col(c).alias(f"n_{c}") for c in ("id", "user_id", "title", "created_at", "updated_at")])
    both = old.join(n, F.col("id") == F.col("n_id"), "full_outer")
    same = F.col("id").isNull() | F.col("n_user_id").eqNullSafe(F.col("user_id"))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c)
    return both.select(
        pick("id"), pick("user_id"), pick("title"), pick("created_at"), F.when(same & F.col("n_updated_at").isNotNull(), F.col("n_updated_at")).otherwise(F.col("updated_at")).alias("updated_at")
    )


def without(rows: DataFrame, gone: DataFrame, column: str, gone_column: str = "id") -> DataFrame:
    """Rows whose ``column`` isn't among the deleted ids; null stays."""
    return rows.join(gone.select(F.col(gone_column).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def without_source(rows: DataFrame, source: str) -> DataFrame:
    """Rows of other sources; a null source is another source."""
    return rows.filter(~F.col("source").eqNullSafe(F.lit(source)))


def set_where(rows: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """``column`` is ``value`` where the condition holds, else as it was."""
    return rows.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def session_title(question: Column) -> Column:
    """The first 80 characters of the stripped question, or a fixed title."""
    return F.coalesce(F.nullif(F.left(X.strip_space(question), F.lit(80)), F.lit("")), F.lit("New chat"))


def list_title(question: Column) -> Column:
    """A question as a list shows it: 77 characters and dots if longer than 80."""
    return F.when(F.length(question) > 80, F.concat(F.left(question, F.lit(77)), F.lit("..."))).otherwise(question)


def stored_feedback(feedback: DataFrame, limit: int = 500) -> DataFrame:
    """Feedback as it is stored: ratings up and down only, question and comment cut, nulls empty."""
    ok = feedback.filter(F.col("rating").isin("up", "down"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return ok.withColumns({"question": F.left("question", F.lit(limit)), "comment": F.left(empty("comment"), F.lit(limit)), "session_id": empty("session_id")})


def user_name(email: Column) -> Column:
    """A normalised login name."""
    return F.lower(X.strip_space(email))


def may_register(email: Column, password: Column) -> Column:
    """Whether a login name and password are long enough."""
    return F.coalesce((F.length(user_name(email)) >= 3) & (F.length(password) >= 6), F.lit(False))


def newest_users(users: DataFrame) -> DataFrame:
    """``id, created_at`` of every user, newest first, those without a time last."""
    return users.select("id", "created_at").distinct().orderBy(F.desc_nulls_last("created_at"), "id")


def newest_feedback(feedback: DataFrame, rating: str, n: int = 100) -> DataFrame:
    """``feedback_id, timestamp`` of the newest ``n`` records of a rating."""
    rated = feedback.filter(F.col("rating") == rating).select("feedback_id", "timestamp").distinct()
    return rated.orderBy(F.desc_nulls_last("timestamp"), F.desc("feedback_id")).limit(n)


def spoken_counts(messages: DataFrame) -> DataFrame:
    """``role, n``: messages of the two speakers that say something."""
    said = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    return said.groupBy("role").agg(F.countDistinct("id").alias("n"))


def sessions_per_user(sessions: DataFrame) -> DataFrame:
    """``user_id, n``; sessions without a user are a group."""
    return sessions.groupBy("user_id").agg(F.countDistinct("id").alias("n"))


def without_collection(rows: DataFrame, collection: str | None = None) -> DataFrame:
    """Rows of other collections; without a name the whole store is emptied, its columns stay."""
    return rows.filter(~F.col("collection").eqNullSafe(F.lit(collection))) if collection is not None else rows.limit(0)


def turns_of(asked: DataFrame) -> DataFrame:
    """The two messages of each answered question: ``id, session_id, user_id, role, content, created_at, sources, price_data``.

    ``asked`` has ``id, session_id, user_id, question, answer, created_at, sources, price_data``; the question has neither sources nor prices.
    """
    kinds = asked.schema
    none = lambda c: F.lit(None).cast(kinds[c].dataType)
    turn = lambda role, content, *more: F.struct(F.concat_ws("-", "id", F.lit(role)).alias("id"), F.lit(role).alias("role"), F.col(content).alias("content"), *[m.alias(n) for n, m in zip(("sources", "price_data"), more, strict=True)])
    both = F.array(turn("user", "question", none("sources"), none("price_data")), turn("assistant", "answer", F.col("sources"), F.col("price_data")))
    return asked.select("session_id", "user_id", "created_at", F.explode(both).alias("t")).select("t.id", "session_id", "user_id", "t.role", "t.content", "created_at", "t.sources", "t.price_data")


def persisted(sessions: DataFrame, messages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after answered questions: sessions are added or touched, both turns are appended.

    A question without a session opens one of its own, named after its id and titled by its text.
    """
    placed = asked.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("new-"), F.col("id"))))
    first = F.min_by("question", F.struct("created_at", "id"))
    touched = placed.groupBy(F.col("session_id").alias("id")).agg(
        F.min("user_id").alias("user_id"), session_title(first).alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    )
    new = turns_of(placed)
    return upsert_sessions(sessions, touched), messages.select(*new.columns).unionByName(new)


def first_titles(messages: DataFrame, order: list[str]) -> DataFrame:
    """``session_id, title`` as a list of sessions shows them: the first user message of each that says something, cut."""
    asked = messages.filter((F.col("role") == "user") & (F.coalesce("content", F.lit("")) != ""))
    return asked.groupBy("session_id").agg(list_title(F.min_by("content", F.struct(*order))).alias("title"))
