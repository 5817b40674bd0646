"""The queries of the training-data problems, over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import conversations, harmful, mixing, pairs, personal, pieces, tokens, truncation
from millrace.plans.session import materialize
from millrace.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their one type."""
    return pairs.first_defect(pairs.defects(table(spark, d, "feedback")))


def p1_all_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect of every pair."""
    return pairs.defects(table(spark, d, "feedback")).select("feedback_id", "defect")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal data of each value."""
    texts = personal.texts_of(table(spark, d, "feedback"))
    return personal.found_kinds(texts, personal.instances(texts))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every value with typed placeholders."""
    texts = personal.texts_of(table(spark, d, "feedback"))
    return personal.redacted(texts, personal.instances(texts))


def _displayed(spark: SparkSession, d: str) -> DataFrame:
    return truncation.displayed_values(table(spark, d, "chat_messages"), table(spark, d, "feedback"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Cut values."""
    cut = truncation.cut_values(_displayed(spark, d), truncation.WORD_WISE)
    return cut.select("field", "record_id", "source_rank").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of values cut, for each displayed source and for feedback."""
    return truncation.rates(truncation.marked_values(_displayed(spark, d), truncation.WORD_WISE))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop with their reason."""
    return conversations.dropped(table(spark, d, "chat_messages"), table(spark, d, "chat_sessions"))


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the kept sessions in order."""
    return conversations.conversations(table(spark, d, "chat_messages"), table(spark, d, "chat_sessions"))


def p4_by_participant(spark: SparkSession, d: str) -> DataFrame:
    """Conversations among the messages that name no session."""
    return conversations.by_participant(table(spark, d, "chat_messages"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of oversized parents and messages."""
    both = pieces.split_items(table(spark, d, "parents"), "parents.content", "parent_id", "content")
    return both.unionByName(pieces.split_items(table(spark, d, "chat_messages"), "chat_messages.content", "id", "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that were split."""
    return p5_pieces(spark, d).select("field", "item_id").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    return tokens.encode_corpus(documents, tokens.vocabulary_path(spark)).select("doc_id", "ids")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sizes = mixing.sized_table(table(spark, d, "documents"), tokens.vocabulary_path(spark))
    return mixing.mix(sizes, targets), sizes, targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix with their number of uses."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of each mix and source."""
    mixed, sizes, targets = _mixed(spark, d)
    return mixing.shares(materialize(mixed, "mix"), sizes, targets)


def _harm(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return harmful.score(documents, harmful.train(documents, table(spark, d, "review_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a harmful passage."""
    return _harm(spark, d).filter(F.col("score") >= harmful.BAR).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    return _harm(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of harmful documents of each source."""
    return harmful.rates(_harm(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    named = (p1_found, p1_all_defects, p2_found, p2_redacted, p3_found, p3_rates, p4_found, p4_conversations, p4_by_participant, p5_found, p5_pieces, p6_ids, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in named}


#: Session checks over whole sessions with plain window functions; the engine's chunks don't occur here.
_P4 = r"""
WITH raw AS (
  SELECT id, session_id, user_id, seq, created_at,
         trim(regexp_replace(lower(coalesce(role, '')), '[^a-z]+', ' ', 'g')) AS r,
         length(regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{C}]', '', 'g')) > 0 AS shown
  FROM chat_messages WHERE session_id IS NOT NULL AND trim(session_id) <> ''
), m AS (
  SELECT *, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN r = 'system' THEN 'system' END AS speaker
  FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY session_id, user_id, seq, created_at) = 1
), n AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq NULLS LAST, created_at NULLS LAST,
           CASE speaker WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, id) AS pos,
         lag(seq) OVER (PARTITION BY session_id ORDER BY seq NULLS LAST) AS seq_before
  FROM m
), t AS (
  SELECT *, lag(coalesce(speaker, '?')) OVER w AS prev, lead(coalesce(speaker, '?')) OVER w AS nxt, lead(shown) OVER w AS nxt_shown
  FROM n WHERE coalesce(speaker, '?') <> 'system' WINDOW w AS (PARTITION BY session_id ORDER BY pos)
), talk AS (
  SELECT session_id, bool_or(shown) AS any_shown, bool_or(speaker IS NULL) AS odd,
         bool_or(speaker = 'user' AND NOT shown) AS blank_q,
         bool_or(speaker = 'assistant' AND coalesce(prev, '') <> 'user') AS loose,
         bool_or(speaker = 'user' AND NOT coalesce(nxt = 'assistant' AND nxt_shown, false)) AS unanswered
  FROM t GROUP BY 1
), stranger AS (
  SELECT DISTINCT t.session_id FROM t JOIN chat_sessions s ON s.id = t.session_id WHERE t.user_id <> s.user_id
), num AS (
  SELECT session_id, count(seq) > 0 AND (count(seq) < count(*) OR min(seq) <> 1 OR bool_or(coalesce(seq <> seq_before + 1, false))) AS bad
  FROM n GROUP BY 1
), ids AS (SELECT id AS session_id FROM chat_sessions WHERE id IS NOT NULL UNION SELECT session_id FROM m)
SELECT * FROM (
  SELECT i.session_id,
    CASE WHEN NOT coalesce(any_shown, false) THEN 'empty'
         WHEN i.session_id NOT IN (SELECT id FROM chat_sessions WHERE id IS NOT NULL) OR i.session_id IN (SELECT session_id FROM stranger)
              OR odd OR blank_q OR loose OR bad THEN 'broken'
         WHEN unanswered THEN 'missing_reply' END AS reason
  FROM ids i LEFT JOIN talk USING (session_id) LEFT JOIN num USING (session_id)
) WHERE reason IS NOT NULL
"""

_P5 = """
SELECT DISTINCT 'parents.content' AS field, parent_id AS item_id FROM parents WHERE length(content) > 2800
UNION ALL
SELECT DISTINCT 'chat_messages.content', id FROM chat_messages WHERE length(content) > 2800
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"p4_found": _P4, "p5_found": _P5}
