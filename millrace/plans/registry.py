"""The registry of the engine's own queries, each with the SQL that says the same."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as X
from millrace.operators import analytics, chunking, context, models, routing, search, semistructured, store
from millrace.plans.settings import Settings
from millrace.sources import files
from millrace.sources.tables import cached_table, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: "Today" of the series: the last day of the events.
AS_OF = dt.date(2024, 1, 30)


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


# -- building blocks of the SQL ------------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


# -- text and documents --------------------------------------------------------------------------


@_query("X12_parent_ids", "SELECT DISTINCT parent_id, left(sha256(content || '0'), 16) AS content_id FROM parents WHERE content IS NOT NULL")
def _parent_ids(spark, d):
    return table(spark, d, "parents").filter("content is not null").select("parent_id", X.parent_id(F.col("content"), F.lit(0)).alias("content_id")).distinct()


@_query(
    "X13_short_summaries",
    "SELECT DISTINCT parent_id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS summary FROM parents",
)
def _short(spark, d):
    return table(spark, d, "parents").select("parent_id", X.shortened(F.col("content"), 200).alias("summary")).distinct()


@_query("P01_displayed_parents", "SELECT DISTINCT parent_id, source, left(summary, 200) AS summary, left(content, 1000) AS content FROM parents")
def _displayed(spark, d):
    return context.displayed(table(spark, d, "parents").select("parent_id", "source", "summary", "content")).distinct()


@_query(
    "P02_session_titles",
    rf"SELECT DISTINCT id, coalesce(nullif(left({_STRIP.format('content')}, 80), ''), 'New chat') AS title FROM chat_messages WHERE role = 'user'",
)
def _titles(spark, d):
    return table(spark, d, "chat_messages").filter("role = 'user'").select("id", store.session_title(F.col("content")).alias("title")).distinct()


@_query(
    "P17_without_citations",
    r"""SELECT DISTINCT feedback_id, replace(regexp_replace(replace(replace(replace(regexp_replace(answer, '\s*\[Source\s*\d+\]', '', 'gi'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), chr(10), '<br/>') AS html FROM feedback""",
)
def _citations(spark, d):
    return table(spark, d, "feedback").select("feedback_id", X.without_citations(F.col("answer")).alias("html")).distinct()


@_query(
    "P18_file_kinds",
    r"SELECT CASE WHEN regexp_matches(file_path, '\.pdf$', 'i') THEN 'pdf' WHEN regexp_matches(file_path, '\.docx?$', 'i') THEN 'docx' END AS kind, count(*) AS n FROM documents GROUP BY 1",
)
def _kinds(spark, d):
    return table(spark, d, "documents").groupBy(X.file_kind(F.col("file_path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "X05_collection_names",
    r"""WITH s AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT title FROM chat_sessions WHERE title IS NOT NULL),
    a AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(trim(name), '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM s),
    b AS (SELECT name, c, CASE WHEN length(c) < 3 THEN rpad(c, 3, 'x') ELSE c END AS e FROM a),
    f AS (SELECT name, c, CASE WHEN regexp_matches(e, '^[^a-zA-Z0-9]') THEN 'c' || e ELSE e END AS e FROM b)
    SELECT name, CASE WHEN c = '' THEN 'rag_chatbot' ELSE left(CASE WHEN regexp_matches(e, '[^a-zA-Z0-9]$') THEN e || '1' ELSE e END, 63) END AS collection FROM f""",
)
def _names(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("name")).union(table(spark, d, "chat_sessions").select("title")).filter("name is not null").distinct()
    return names.select("name", X.collection_name(F.col("name")).alias("collection"))


@_query(
    "X06_X07_near_names",
    """WITH q AS (SELECT DISTINCT lower(p_name) AS query FROM part), p AS (SELECT DISTINCT p_name AS name, lower(p_name) AS low FROM part),
    t AS (SELECT query, name, string_split(query, ' ') AS q, string_split(low, ' ') AS n FROM q, p),
    m AS (SELECT query, name, q, n, len(list_filter(q, lambda x: len(list_filter(n, lambda y: contains(y, x) OR contains(x, y))) > 0)) AS k FROM t)
    SELECT query, name FROM m WHERE CASE WHEN len(q) >= 2 THEN k >= 2
      ELSE k > 0 OR (length(q[1]) >= 5 AND len(list_filter(n, lambda y: contains(y, left(q[1], 4)))) > 0) END""",
)
def _near(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return search.near_names(names.select(F.lower("p_name").alias("query")).distinct(), names.select(F.col("p_name").alias("name")))


@_query(
    "X08_name_case",
    """SELECT DISTINCT p_brand, array_to_string(list_transform(list_filter(string_split(upper(p_type) || ' ' || p_name || ' 5MG', ' '), lambda w: w <> ''),
    lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN lower(w) WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), ' ') AS name FROM part""",
)
def _case(spark, d):
    raw = F.concat_ws(" ", F.upper("p_type"), "p_name", F.lit("5MG"))
    return table(spark, d, "part").select("p_brand", X.name_case(raw).alias("name")).distinct()


_STATS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 s AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM t),
 c AS (SELECT doc_id,
   len(list_filter(string_split(flat, ' '), lambda w: w <> '')) AS n_words,
   len(list_filter(string_split(regexp_replace(flat, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n_sentences FROM s)
"""


@_query("A16_statistics", _STATS + "SELECT doc_id, n_words, n_sentences, round(n_words / greatest(1, n_sentences), 6) AS words_per_sentence FROM c")
def _stats(spark, d):
    s = chunking.statistics(table(spark, d, "documents").select("doc_id", "text"))
    return s.select("doc_id", F.col("n_words").cast("bigint"), F.col("n_sentences").cast("bigint"), F.round("words_per_sentence", 6).alias("words_per_sentence"))


#: Marked table blocks are set off by blank lines; blank lines within one, of which the tables have none, aren't shielded here.
_BLOCKS = r"regexp_replace(coalesce(text, ''), '(<!--TABLE_START-->(?s:.*?)<!--TABLE_END-->)', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"
_PARAGRAPHS = "list_filter(list_transform(string_split_regex(" + _BLOCKS + r", '\n[\s\x0b]*\n+'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"


@_query("C01_strategies", _STATS.replace("len(list_filter(string_split(flat, ' ')", f"(SELECT len({_PARAGRAPHS}) FROM documents d WHERE d.doc_id = s.doc_id) AS n_paragraphs, len(list_filter(string_split(flat, ' ')", 1)
    + """SELECT doc_id, n_paragraphs, n_sentences, n_words, CASE WHEN n_paragraphs >= 10 AND n_words / greatest(1, n_paragraphs) BETWEEN 40 AND 200 THEN 'paragraph'
      WHEN n_sentences >= 20 AND n_words / greatest(1, n_sentences) BETWEEN 10 AND 60 THEN 'sentence' ELSE 'semantic_tokens' END AS strategy FROM c""")
def _strategies(spark, d):
    return chunking.strategy(chunking.statistics(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "n_paragraphs", "n_sentences", "n_words", "strategy")


def _windows_sql(kind: str, size: int, overlap: int) -> str:
    units = {
        "word": "list_filter(string_split(flat, ' '), lambda w: w <> '')",
        "sentence": r"list_filter(string_split(regexp_replace(flat, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')",
    }[kind]
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM t),
      u AS (SELECT doc_id, {units} AS u FROM s),
      j AS (SELECT doc_id, u, unnest(range(0, greatest(len(u), 1), {size - overlap})) AS s FROM u WHERE len(u) > 0)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS idx, array_to_string(u[s + 1 : s + {size}], ' ') AS text
      FROM j WHERE s = 0 OR s + {overlap} < len(u)"""


def _chunks(name: str, kind: str, parent: bool) -> None:
    sizes = {"word": chunking.Sizes().words, "sentence": chunking.Sizes().sentences}[kind]
    size, overlap = (sizes[0], 0) if parent else sizes[1:]
    make = chunking.parent_texts if parent else chunking.child_texts
    _QUERIES[name] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(make(F.col("text"), kind)).alias("idx", "text"))
    _SQL[name] = _windows_sql(kind, size, overlap)


_chunks("C03_sentence_parents", "sentence", True)
_chunks("C04_word_parents", "word", True)
_chunks("C08_sentence_children", "sentence", False)
_chunks("C09_word_children", "word", False)


@_query(
    "C02_C07_paragraphs",
    f"""WITH u AS (SELECT doc_id, {_PARAGRAPHS} AS u FROM documents)
    SELECT doc_id, 'parent' AS level, CAST(s / 4 AS INTEGER) AS idx, array_to_string(u[s + 1 : s + 4], chr(10) || chr(10)) AS text FROM (SELECT doc_id, u, unnest(range(0, len(u), 4)) AS s FROM u)
    UNION ALL SELECT doc_id, 'child', CAST(s AS INTEGER), u[s + 1] FROM (SELECT doc_id, u, unnest(range(0, len(u))) AS s FROM u)""",
)
def _paragraph_chunks(spark, d):
    docs = table(spark, d, "documents")
    parents = docs.select("doc_id", F.lit("parent").alias("level"), F.posexplode(chunking.parent_texts(F.col("text"), "paragraph")).alias("idx", "text"))
    return parents.unionByName(docs.select("doc_id", F.lit("child").alias("level"), F.posexplode(chunking.child_texts(F.col("text"), "paragraph")).alias("idx", "text")))


@_query("C05_sections")
def _sections(spark, d):
    return chunking.semantic_parents(table(spark, d, "documents"), "doc_id").select("key", "parent_idx", "content")


@_query("C06_C11_C14_chunks")
def _all_chunks(spark, d):
    return chunking.build_children(chunking.build_parents(table(spark, d, "documents"), "doc_id"))


@_query("C14_ingest_counts")
def _ingest_counts(spark, d):
    children = _all_chunks(spark, d)
    return children.groupBy("strategy").agg(F.countDistinct("key", "parent_idx").alias("num_parents"), F.count(F.lit(1)).alias("num_children"))


# -- index and search ----------------------------------------------------------------------------


@_query("E01_tokens", f"SELECT DISTINCT feedback_id, {_tokens('question')} AS tokens FROM feedback WHERE question IS NOT NULL")
def _token_lists(spark, d):
    return table(spark, d, "feedback").filter("question is not null").select("feedback_id", X.tokens(F.col("question")).alias("tokens")).distinct()


@_query("A10_vocabulary", f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 100000")
def _vocabulary(spark, d):
    return search.vocabulary(table(spark, d, "documents"), "text")


_WEIGHTS = (
    "SELECT {key}, token, round(1 + ln(count(*)), 6) AS w FROM (SELECT {key}, unnest({tokens}) AS token FROM (SELECT DISTINCT {key}, {text} FROM {table})) GROUP BY 1, 2"
)


def _passages(spark, d):
    return table(spark, d, "parents").select("parent_id", "content").distinct()


@_query("A11_postings", _WEIGHTS.format(key="parent_id", text="content", tokens=_tokens("content"), table="parents"))
def _postings(spark, d):
    return search.term_weights(_passages(spark, d), ["parent_id"], "content")


@_query(
    "U05_vocabulary_merge",
    rf"""WITH old AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT unnest({_tokens('title')}) AS token FROM chat_sessions)),
    fresh AS (SELECT token FROM (SELECT DISTINCT unnest({_tokens('question')}) AS token FROM feedback) WHERE token NOT IN (SELECT token FROM old))
    SELECT * FROM old UNION ALL SELECT token, CAST((SELECT max(idx) FROM old) + row_number() OVER (ORDER BY token) AS INTEGER) FROM fresh""",
)
def _merged_vocabulary(spark, d):
    none = spark.createDataFrame([], "token string, idx int")
    terms = lambda name, col: table(spark, d, name).select(F.explode(X.tokens(F.col(col))).alias("token"))
    old = search.merge_vocabulary(none, terms("chat_sessions", "title"))
    return search.merge_vocabulary(old, terms("feedback", "question"))


@_query("J04_indexed_postings", "WITH w AS (" + _WEIGHTS.format(key="parent_id", text="content", tokens=_tokens("content"), table="parents") + f"), v AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT unnest({_tokens('question')}) AS token FROM feedback)) SELECT parent_id, idx, w FROM w JOIN v USING (token)")
def _indexed(spark, d):
    """The passages' terms by the numbers of the questions' vocabulary."""
    none = spark.createDataFrame([], "token string, idx int")
    asked = table(spark, d, "feedback").select(F.explode(X.tokens(F.col("question"))).alias("token"))
    counted = search.merge_vocabulary(none, asked).join(search.vocabulary(_passages(spark, d), "content"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return search.indexed(_postings(spark, d), counted, ["parent_id"])


@_query("S08_cached_parents", "SELECT collection, count(*) AS n FROM parents GROUP BY 1")
def _cached_parents(spark, d):
    return cached_table(spark, d, "parents").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def _questions(spark, d):
    """``feedback_id, question``, and in ``first`` whether the question is the least of the id, in ``least`` the least id with the same question.

    An id with several questions is its own ``least``.
    """
    asked = table(spark, d, "feedback").select("feedback_id", "question").distinct()
    of_id = W.partitionBy("feedback_id")
    rows = asked.select("*", F.min("question").over(of_id).alias("lo"), (F.count(F.lit(1)).over(of_id) > 1).alias("more"))
    alike = W.partitionBy("lo", F.when(F.col("more") | F.col("lo").isNull(), F.col("feedback_id")), "more")
    return rows.select("feedback_id", "question", (F.col("question") == F.col("lo")).alias("first"), F.min("feedback_id").over(alike).alias("least"))


def _asked_once(spark, d):
    """The questions without those of ids that have the same answer as a lesser id; ``_for_all`` gives it to them."""
    return _questions(spark, d).filter("feedback_id <=> least").select("feedback_id", "question")


def _for_all(spark, d, found):
    """The rows found for each ``query_id``, for all ids with the same question."""
    ids = _questions(spark, d).filter("first").select(F.col("feedback_id").alias("_id"), F.col("least").alias("_least"))
    return found.join(ids, F.col("query_id").eqNullSafe(F.col("_least"))).select(F.col("_id").alias("query_id"), *[c for c in found.columns if c != "query_id"])


def _query_terms(spark, d):
    return search.term_weights(_asked_once(spark, d), ["feedback_id"], "question").withColumnRenamed("feedback_id", "query_id")


_SPARSE = (
    "WITH p AS (" + _WEIGHTS.format(key="parent_id", text="content", tokens=_tokens("content"), table="parents") + "), "
    "q AS (" + _WEIGHTS.format(key="feedback_id", text="question", tokens=_tokens("question"), table="feedback") + "), "
    "s AS (SELECT feedback_id AS query_id, parent_id, round(sum(round(q.w * p.w, 9)), 6) AS score FROM q JOIN p USING (token) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM s) "
)


@_query("J05_sparse_search", _SPARSE + "SELECT query_id, parent_id, score, rank FROM r WHERE rank <= 20")
def _sparse(spark, d):
    found = search.search_texts(_query_terms(spark, d), table(spark, d, "parents").select("parent_id", "content"), ["parent_id"], "content")
    return _for_all(spark, d, found)


_DENSE = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM s) """


@_query("J06_E05_dense_search", _DENSE + "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, score, rank FROM r WHERE rank <= 20")
def _dense(spark, d):
    v = table(spark, d, "embeddings")
    return search.dense_search(v.filter("vec_id % 20 = 0"), v, "vec_id", "embedding").select("query_id", "id", "score", "rank")


@_query(
    "A12_fusion",
    _SPARSE
    + ", p2 AS ("
    + _WEIGHTS.format(key="parent_id", text="summary", tokens=_tokens("summary"), table="(SELECT * FROM parents WHERE summary IS NOT NULL)")
    + """), s2 AS (SELECT feedback_id AS query_id, parent_id, round(sum(round(q.w * p2.w, 9)), 6) AS score FROM q JOIN p2 USING (token) GROUP BY 1, 2),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM s2),
    f AS (SELECT query_id, parent_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, parent_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT query_id, parent_id, rank FROM r2 WHERE rank <= 20) GROUP BY 1, 2)
    SELECT * FROM (SELECT query_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM f) WHERE rank <= 20""",
)
def _fusion(spark, d):
    terms = _query_terms(spark, d)
    parents = table(spark, d, "parents")
    by_content = search.search_texts(terms, parents.select("parent_id", "content"), ["parent_id"], "content")
    by_summary = search.search_texts(terms, parents.select("parent_id", "summary"), ["parent_id"], "summary")
    lists = by_content.select("query_id", "parent_id", "rank").unionByName(by_summary.select("query_id", "parent_id", "rank"))
    return _for_all(spark, d, search.fuse(lists, ["query_id"], ["parent_id"]))


def _asked(spark, d):
    return table(spark, d, "feedback").filter("feedback_id % 20 = 0 and question is not null").groupBy(F.col("feedback_id").alias("query_id")).agg(F.min("question").alias("question")).withColumn("response", F.lit(None).cast("string"))


_VECTOR = """(SELECT k, list(coalesce(s, 0)::DOUBLE ORDER BY b) AS v FROM (SELECT DISTINCT k FROM {0}) CROSS JOIN (SELECT unnest(range(64)) AS b)
  LEFT JOIN (SELECT k, h % 64 AS b, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM (SELECT k, ('0x' || left(md5(token), 8))::BIGINT AS h FROM {0} WHERE token IS NOT NULL) GROUP BY 1, 2) USING (k, b) GROUP BY k)"""


@_query(
    "E10_federated_retrieval",
    f"""WITH q AS (SELECT feedback_id AS k, min(question) AS text FROM feedback WHERE feedback_id % 20 = 0 AND question IS NOT NULL GROUP BY 1),
    p AS (SELECT {{'c': collection, 'i': parent_id}} AS k, max(content) AS text FROM parents WHERE content IS NOT NULL GROUP BY 1),
    qa AS (SELECT k, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS token FROM (SELECT k, {_tokens('text')} AS t FROM q)),
    pa AS (SELECT k, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS token FROM (SELECT k, {_tokens('text')} AS t FROM p)),
    qw AS (SELECT k, token, round(1 + ln(2 * count(*)), 6) AS w FROM qa WHERE token IS NOT NULL GROUP BY 1, 2), pw AS (SELECT k, token, round(1 + ln(count(*)), 6) AS w FROM pa WHERE token IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT qw.k AS q, pw.k AS p, round(sum(round(qw.w * pw.w, 9)), 6) AS score FROM qw JOIN pw USING (token) GROUP BY 1, 2),
    qv AS MATERIALIZED {_VECTOR.format('qa')}, pv AS MATERIALIZED {_VECTOR.format('pa')},
    v AS (SELECT qv.k AS q, pv.k AS p, round(list_dot_product(qv.v, pv.v) / greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-12) / greatest(sqrt(list_dot_product(pv.v, pv.v)), 1e-12), 6) AS score FROM qv, pv),
    r AS (SELECT *, row_number() OVER (PARTITION BY q, p.c ORDER BY score DESC, p.i) AS rank FROM s), d AS (SELECT *, row_number() OVER (PARTITION BY q, p.c ORDER BY score DESC, p.i) AS rank FROM v),
    f AS (SELECT q, p, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT q, p, rank FROM r WHERE rank <= 20 UNION ALL SELECT q, p, rank FROM d WHERE rank <= 20) GROUP BY 1, 2),
    b AS (SELECT q, p FROM f QUALIFY row_number() OVER (PARTITION BY q, p.c ORDER BY score DESC, p.i) <= 20),
    z AS (SELECT b.q, b.p, coalesce(round(len(list_intersect(list_distinct({_tokens('q.text')}), list_distinct({_tokens('p.text')}))) / nullif(len(list_distinct({_tokens('q.text')})), 0), 6), 0) AS score
      FROM b JOIN q ON q.k = b.q JOIN p ON p.k = b.p)
    SELECT * FROM (SELECT q AS query_id, p.c AS collection, p.i AS passage_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, p.c, p.i) AS rank FROM z) WHERE rank <= 5""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval of every twentieth question over the index of the passages of all collections."""
    rows = table(spark, d, "parents").filter("content is not null").select("collection", F.col("parent_id").alias("passage_id"), F.col("content").alias("text"))
    index = search.index_of(rows, lambda: store.latest(rows, ["collection", "passage_id"], ["text"]))
    return search.retrieve_from(index, _asked(spark, d)).select("query_id", "collection", "passage_id", "score", "rank")


@_query("E12_J01_parent_context", rf"""WITH c AS (SELECT DISTINCT m.id, s.rank, s.source, s.content AS text FROM (SELECT id, unnest(sources) AS s FROM chat_messages) m),
  t AS (SELECT *, regexp_replace(text, '{search._DEBRIS}', '') AS plain FROM c),
  p AS (SELECT DISTINCT source, content FROM parents WHERE source IS NOT NULL AND content IS NOT NULL)
  SELECT t.id, t.rank, coalesce(min(p.content), t.text) AS content FROM t LEFT JOIN p ON p.source = t.source AND left(p.content, 60) = left(t.text, 60)
    AND (starts_with(p.content, t.text) OR (plain <> '' AND starts_with(p.content, plain))) GROUP BY t.id, t.rank, t.source, t.text""")
def _parent_context(spark, d):
    shown = table(spark, d, "chat_messages").select("id", F.explode("sources").alias("s")).select("id", "s.rank", "s.source", F.col("s.content").alias("text")).distinct()
    return search.with_displayed_parents(shown, table(spark, d, "parents"), ["id", "rank"]).select("id", "rank", "content")


@_query("E09_K07_rerank", _SPARSE + rf""", c AS (SELECT r.query_id, r.parent_id, list_distinct({_tokens('f.question')}) AS q, list_distinct({_tokens('p2.content')}) AS t
    FROM r JOIN (SELECT DISTINCT feedback_id, question FROM feedback) f ON f.feedback_id = r.query_id JOIN (SELECT parent_id, min(content) AS content FROM parents GROUP BY 1) p2 ON p2.parent_id = r.parent_id WHERE r.rank <= 20),
    z AS (SELECT query_id, parent_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM c)
    SELECT * FROM (SELECT query_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM z) WHERE rank <= 5""")
def _rerank(spark, d):
    found = search.search_texts(_query_terms(spark, d), table(spark, d, "parents").select("parent_id", "content"), ["parent_id"], "content", shared=True)
    # what a passage shares with the question scores like the whole passage; a question's tokens are worked out once and not for each passage
    asked = _asked_once(spark, d).select(F.col("feedback_id").alias("query_id"), F.array_distinct(X.tokens(F.col("question"))).alias("words"))
    known = found.filter("parent_id is not null").select("query_id", "parent_id", "shared").join(asked, "query_id")
    best = search.rerank(known.withColumn("shared", F.split("shared", " ")), "words", "shared", ["parent_id"]).select("query_id", "parent_id", "score", "rank")
    return _for_all(spark, d, best).filter("query_id is not null")


@_query("E02_embeddings", f"WITH p AS (SELECT DISTINCT parent_id, content FROM parents WHERE content IS NOT NULL), a AS (SELECT parent_id AS k, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS token FROM (SELECT parent_id, {_tokens('content')} AS t FROM p)) SELECT k AS parent_id, v AS dense FROM {_VECTOR.format('a')}")
def _embeddings(spark, d):
    return _passages(spark, d).filter("content is not null").select("parent_id", models.embed(F.col("content"), models.HashEmbedder()).alias("dense"))


_LINES = f"list_slice(list_filter(list_transform(string_split(coalesce(question, ''), chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), 1, 5)"


@_query("E04_expansions", rf"""WITH l AS (SELECT feedback_id, question, list_filter(list_transform({_LINES}, lambda x: {_STRIP.format("regexp_replace(x, '^[0-9.)*-]+[' || chr(9) || '-' || chr(13) || ' ]*', '')")}), lambda x: x <> '') AS l FROM feedback)
    SELECT DISTINCT feedback_id, [question] || list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3) AS texts FROM l""")
def _expansions(spark, d):
    return table(spark, d, "feedback").select("feedback_id", models.expansions(F.col("question"), F.col("question")).alias("texts")).distinct()


# -- routing and semi-structured data ------------------------------------------------------------


_LEGAL_SQL = routing.LEGAL.replace("\\s*", r"[\s\p{Z}]*").replace("'", "''")


@_query("X16_X18_routing", rf"SELECT DISTINCT feedback_id, coalesce(regexp_matches(question, '{_LEGAL_SQL}', 'i'), false) AS legal FROM feedback")
def _legal(spark, d):
    return table(spark, d, "feedback").select("feedback_id", routing.matches(F.col("question"), routing.LEGAL).alias("legal")).distinct()


def _asked_sql(question: str) -> str:
    left = rf"regexp_replace(lower({_STRIP.format(question)}), '[?!.,;:]+', ' ', 'g')"
    for phrase in sorted(routing.PHRASES, key=len, reverse=True):
        left = f"replace({left}, '{phrase}', ' ')"
    return rf"regexp_replace(regexp_replace({left}, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'), '^ | $', '', 'g')"


_PRICE_SQL = routing.PRICE.replace("\\s", r"[\s\p{Z}]").replace("'", "''")


@_query(
    "X17_asked_names",
    rf"""WITH f AS (SELECT DISTINCT feedback_id, question, coalesce(regexp_matches(question, '{_LEGAL_SQL}', 'i'), false) AS legal, coalesce(regexp_matches({_STRIP.format('question')}, '{_PRICE_SQL}', 'i'), false) AS price, {_asked_sql('question')} AS n FROM feedback)
    SELECT feedback_id, CASE WHEN legal THEN ['legal'] ELSE ['drug_info'] END AS collections_to_search, price, nullif(CASE WHEN price THEN CASE WHEN length(n) < 2 THEN {_STRIP.format('question')} ELSE n END END, '') AS price_name FROM f""",
)
def _asked_names(spark, d):
    return table(spark, d, "feedback").select("feedback_id", routing.by_keywords(F.col("question")).alias("r")).select("feedback_id", "r.*").distinct()


@_query(
    "X15_R01_model_routing",
    rf"""WITH m AS (SELECT DISTINCT id, content, length({_STRIP.format("coalesce(content, '')")}) > 0 AS asked FROM chat_messages WHERE role = 'user')
    SELECT id, CASE WHEN asked THEN ['legal'] ELSE ['drug_info'] END AS collections_to_search, asked AND length(content) % 2 = 0 AS price, NULL::VARCHAR AS price_name FROM m""",
)
def _model_routing(spark, d):
    rows = table(spark, d, "chat_messages").filter("role = 'user'").select("id", "content").distinct()
    response = F.concat(F.lit('ok {"collections_to_search": ["legal", "x"], "price": "'), F.when(F.length("content") % 2 == 0, "false").otherwise(""), F.lit('", "price_name": null} end'))
    return rows.select("id", routing.route(F.col("content"), response).alias("r")).select("id", "r.*")


@_query("J12_physical_names", "SELECT DISTINCT source, [CASE WHEN collection = 'legal' THEN 'laws_v1' ELSE 'drugs_v1' END] AS names FROM source_catalog WHERE collection IN ('legal', 'drug_info')")
def _physical(spark, d):
    rows = table(spark, d, "source_catalog").filter(F.col("collection").isin("legal", "drug_info"))
    return rows.select("source", routing.physical(F.array("collection"), {"legal": "laws_v1", "drug_info": "drugs_v1"}).alias("names")).distinct()


@_query(
    "X24_event_properties",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
)
def _props(spark, d):
    rows = table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows


@_query(
    "R05_offers",
    """WITH m AS (SELECT DISTINCT id, price_data FROM chat_messages WHERE price_data IS NOT NULL AND json_valid(price_data)),
    e AS (SELECT id, json_extract_string(price_data, '$.drug_name') AS name, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS entry_no, unnest(l) AS p FROM (SELECT *, CAST(json_extract(price_data, '$.prices') AS JSON[]) AS l FROM m))
    SELECT id, name, entry_no, CAST(json_extract(p, '$.price_raw') AS BIGINT) AS price, json_extract_string(p, '$.unit') AS unit FROM e WHERE CAST(json_extract(p, '$.price_raw') AS BIGINT) > 0""",
)
def _offers(spark, d):
    return semistructured.answer_offers(table(spark, d, "chat_messages"))


@_query("S14_page_offers", "SELECT DISTINCT id, 0 AS product_no, id AS name, 0 AS entry_no, CAST(length(price_data) AS BIGINT) AS price, 'box' AS unit FROM chat_messages WHERE price_data IS NOT NULL")
def _page_offers(spark, d):
    rows = table(spark, d, "chat_messages").filter("price_data is not null").select("id", "price_data").distinct()
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"products":[{"name":"'), F.col("id"), F.lit('","prices":[{"price":'), (F.length("price_data")).cast("string"), F.lit(',"unit":"box"}]}]}}}</script></html>'))
    return semistructured.offers(rows.select("id", page.alias("html")), "html").select("id", "product_no", "name", "entry_no", "price", "unit")


@_query(
    "A13_grouped_offers",
    """SELECT p_name, count(*) AS n_offers, min(l_extendedprice) AS low, max(l_extendedprice) AS high, min({'p': l_extendedprice, 's': l_suppkey}).s AS cheapest_supplier
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def _grouped(spark, d):
    joined = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return semistructured.summarised_offers(joined, "p_name", "l_extendedprice", "l_suppkey")


@_query(
    "K08_session_offers",
    """WITH m AS (SELECT DISTINCT id, price_data FROM chat_messages WHERE price_data IS NOT NULL AND json_valid(price_data)),
    e AS (SELECT id, CAST(json_extract(unnest(CAST(json_extract(price_data, '$.prices') AS JSON[])), '$.price_raw') AS BIGINT) AS price FROM m)
    SELECT id, list_sort(list(price)) AS prices, min(price) AS low, max(price) AS high, count(*) AS n_offers FROM e WHERE price > 0 GROUP BY 1""",
)
def _message_offers(spark, d):
    g = semistructured.grouped_offers(_offers(spark, d), "id", "price", ["entry_no"], ["unit"])
    return g.select("id", F.transform("offers", lambda o: o["price"]).alias("prices"), "low", "high", "n_offers")


# -- contexts ------------------------------------------------------------------------------------

_SPEAKS = "trim(regexp_replace(lower(strip_accents(role)), '[^a-z]+', ' ', 'g'))"
_TURN = f"CASE WHEN {_SPEAKS} IN {context.ASKS} THEN 0 WHEN {_SPEAKS} IN {context.ANSWERS} THEN 2 ELSE 1 END"
_LAST = (1 << 63) - 1
_M = f"""(SELECT DISTINCT id, session_id, seq, role, content, created_at, coalesce(seq, {_LAST}) AS place_seq, CASE WHEN seq IS NULL THEN coalesce(epoch_us(created_at), {_LAST}) END AS place_at,
  CASE WHEN seq IS NULL THEN {_TURN} END AS turn FROM chat_messages WHERE session_id IS NOT NULL)"""
_BACK = ", ".join(f"{c} DESC NULLS LAST" for c in ("place_seq", "place_at", "turn", "id"))


def _messages(spark, d):
    """Messages of every session; whole sessions have no ``seq`` and are ordered by time, the question first on a tie."""
    rows = table(spark, d, "chat_messages").filter("session_id is not null").select("id", "session_id", "seq", "role", "content", "created_at").distinct()
    return context.ordered(rows)


_ORDER = ["place_seq", "at", "turn", "id"]


@_query(
    "W03_last_turns",
    f"""SELECT session_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_BACK}) AS place FROM {_M})
    WHERE place <= 8 AND coalesce(content, '') <> '' AND role IN ('user', 'assistant')""",
)
def _last(spark, d):
    return context.last_turns(_messages(spark, d), "session_id", _ORDER, 8).select("session_id", "id", "place")


@_query(
    "W02_histories",
    f"""SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || left(content, 400), chr(10) ORDER BY place DESC) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_BACK}) AS place FROM {_M})
    WHERE place <= 6 AND coalesce(content, '') <> '' AND role IN ('user', 'assistant') GROUP BY 1""",
)
def _histories(spark, d):
    return context.rendered_history(_messages(spark, d), "session_id", _ORDER)


@_query(
    "J11_preceding_questions",
    f"""SELECT id, session_id, question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY place_seq, place_at NULLS FIRST, turn NULLS FIRST, id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
    FROM {_M}) WHERE role = 'assistant'""",
)
def _preceding(spark, d):
    return context.preceding_question(_messages(spark, d), "session_id", _ORDER, context.stretch()).filter("role = 'assistant'").select("id", "session_id", "question")


@_query(
    "P03_list_titles",
    f"""SELECT session_id, CASE WHEN length(c) > 80 THEN left(c, 77) || '...' ELSE c END AS title FROM (SELECT session_id, first(content ORDER BY place_seq, place_at NULLS FIRST, turn NULLS FIRST, id NULLS FIRST) AS c
    FROM {_M} WHERE role = 'user' AND coalesce(content, '') <> '' GROUP BY 1)""",
)
def _list_titles(spark, d):
    return store.first_titles(_messages(spark, d), _ORDER)


_CTX = "(SELECT DISTINCT id, s.rank AS rank, s.source AS source, s.summary AS summary, s.content AS content, s.collection_name AS collection_name, s.page AS page FROM (SELECT id, unnest(sources) AS s FROM chat_messages))"


def _contexts(spark, d):
    return table(spark, d, "chat_messages").select("id", F.explode("sources").alias("s")).select("id", "s.*").distinct()


@_query(
    "X20_context_blocks",
    f"""SELECT id, string_agg('[Source ' || rank || ']' || chr(10) || {_STRIP.format("coalesce(content, '')")} || chr(10) || '(Nguồn: ' || coalesce(source, 'Unknown') || ')', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block
    FROM {_CTX} GROUP BY 1""",
)
def _blocks(spark, d):
    return context.context_blocks(_contexts(spark, d), ["id"])


@_query(
    "A17_merged_sources",
    f"""SELECT id, source, collection_name, contents, list_filter(p, lambda x, i: list_position(p, x) = i) AS pages, summary, n FROM
    (SELECT id, source, collection_name, list(content ORDER BY rank) AS contents, coalesce(list(page ORDER BY rank) FILTER (WHERE page IS NOT NULL), []) AS p,
      min_by(summary, rank) FILTER (WHERE coalesce(summary, '') <> '') AS summary, count(*) AS n FROM {_CTX} GROUP BY 1, 2, 3)""",
)
def _merged(spark, d):
    return context.merged_sources(_contexts(spark, d), ["id"]).select("id", "source", "collection_name", "contents", "pages", "summary", F.size("contents").cast("bigint").alias("n"))


@_query(
    "X23_prompt_kinds",
    "SELECT DISTINCT id, CASE WHEN coalesce(len(sources), 0) > 0 AND price_data IS NOT NULL THEN 'combined' WHEN price_data IS NOT NULL THEN 'price' WHEN coalesce(len(sources), 0) > 0 THEN 'rag' ELSE 'none' END AS kind FROM chat_messages",
)
def _prompt_kinds(spark, d):
    has = F.coalesce(F.size("sources") > 0, F.lit(False))
    return table(spark, d, "chat_messages").select("id", context.prompt_kind(has, F.col("price_data").isNotNull()).alias("kind")).distinct()


# -- operational tables --------------------------------------------------------------------------


@_query("K01_latest_sessions", "SELECT id, user_id, max(updated_at) AS updated_at FROM chat_sessions GROUP BY 1, 2")
def _sessions(spark, d):
    return store.latest(table(spark, d, "chat_sessions").select("id", "user_id", "updated_at"), ["id", "user_id"], ["updated_at"])


@_query("K02_ordered_messages", f"SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, seq NULLS LAST, turn NULLS FIRST, id) AS place FROM {_M}")
def _ordered(spark, d):
    order = [F.asc_nulls_first("created_at"), F.asc_nulls_last("seq"), F.asc("turn"), F.asc("id")]
    return context.places(_messages(spark, d), "session_id", order, F.date_trunc("hour", "created_at")).select("session_id", "id", "place")


@_query("K03_newest_users", "SELECT DISTINCT id, created_at FROM users")
def _users(spark, d):
    return store.newest_users(table(spark, d, "users"))


@_query("K04_newest_feedback", "SELECT DISTINCT feedback_id, timestamp FROM feedback WHERE rating = 'down' ORDER BY timestamp DESC NULLS LAST, feedback_id DESC LIMIT 100")
def _newest(spark, d):
    return store.newest_feedback(table(spark, d, "feedback"), "down")


@_query("P04_stored_feedback", "SELECT DISTINCT feedback_id, left(question, 500) AS question, left(coalesce(comment, ''), 500) AS comment, coalesce(session_id, '') AS session_id FROM feedback WHERE rating IN ('up', 'down')")
def _stored(spark, d):
    return store.stored_feedback(table(spark, d, "feedback")).select("feedback_id", "question", "comment", "session_id").distinct()


@_query("P05_P07_spoken", "SELECT role, count(DISTINCT id) AS n FROM chat_messages WHERE role IN ('user', 'assistant') AND coalesce(content, '') <> '' GROUP BY 1")
def _spoken(spark, d):
    return store.spoken_counts(table(spark, d, "chat_messages"))


@_query("P06_user_sessions", "SELECT user_id, count(DISTINCT id) AS n FROM chat_sessions GROUP BY 1")
def _user_sessions(spark, d):
    return store.sessions_per_user(table(spark, d, "chat_sessions"))


@_query("P15_user_names", f"SELECT DISTINCT id, lower({_STRIP.format('email')}) AS email, coalesce(length({_STRIP.format('email')}) >= 3 AND length(password_hash) >= 6, false) AS ok FROM users")
def _user_names(spark, d):
    return table(spark, d, "users").select("id", store.user_name(F.col("email")).alias("email"), store.may_register(F.col("email"), F.col("password_hash")).alias("ok")).distinct()


@_query("J08_unknown_users", "SELECT DISTINCT s.id FROM chat_sessions s WHERE s.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id)")
def _unknown(spark, d):
    return table(spark, d, "chat_sessions").filter("user_id is not null").join(table(spark, d, "users").select(F.col("id").alias("user_id")), "user_id", "left_anti").select("id").distinct()


@_query("J08_unknown_sessions", "SELECT DISTINCT id FROM chat_messages m WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chat_sessions s WHERE s.id = m.session_id)")
def _unknown_sessions(spark, d):
    rows = table(spark, d, "chat_messages").filter("session_id is not null").select("id", "session_id")
    return rows.join(table(spark, d, "chat_sessions").select(F.col("id").alias("session_id")), "session_id", "left_anti").select("id").distinct()


@_query("J09_cascade", "WITH gone AS (SELECT DISTINCT id FROM users WHERE last_login_at IS NULL) SELECT DISTINCT id FROM chat_messages WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)")
def _cascade(spark, d):
    return store.without(table(spark, d, "chat_messages").select("id", "user_id"), table(spark, d, "users").filter("last_login_at is null and id is not null"), "user_id").select("id").distinct()


@_query("J10_without_source", "SELECT DISTINCT doc_id FROM documents WHERE source IS DISTINCT FROM 'bang-gia-quy.xlsx'")
def _without_source(spark, d):
    return store.without_source(table(spark, d, "documents"), "bang-gia-quy.xlsx").select("doc_id").distinct()


@_query(
    "U06_upserted_sessions",
    """WITH o AS (SELECT id, max({'updated_at': updated_at, 'user_id': user_id, 'title': title, 'created_at': created_at}) AS r FROM chat_sessions GROUP BY 1),
    n AS (SELECT session_id AS id, min(user_id) AS user_id, max(created_at) AS updated_at, min(created_at) AS created_at FROM chat_messages WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.r.user_id, n.user_id) AS user_id, coalesce(o.r.created_at, n.created_at) AS created_at,
      CASE WHEN (o.id IS NULL OR n.user_id IS NOT DISTINCT FROM o.r.user_id) AND n.updated_at IS NOT NULL THEN n.updated_at ELSE o.r.updated_at END AS updated_at
    FROM o FULL JOIN n ON o.id = n.id""",
)
def _upserted(spark, d):
    old = store.latest(table(spark, d, "chat_sessions").select("id", "user_id", "title", "created_at", "updated_at"), ["id"], ["updated_at"])
    new = table(spark, d, "chat_messages").filter("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.min("user_id").alias("user_id"), F.lit("New chat").alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    )
    return store.upsert_sessions(old, new).drop("title")


@_query("U08_roles", "SELECT DISTINCT id, CASE WHEN id LIKE '2%' THEN true ELSE is_admin END AS is_admin FROM users")
def _roles(spark, d):
    return store.set_where(table(spark, d, "users"), "is_admin", F.lit(True), F.col("id").like("2%")).select("id", "is_admin").distinct()


@_query(
    "U05_S07_merged_parents",
    """WITH p AS (SELECT DISTINCT parent_id, source FROM parents), n AS (SELECT DISTINCT parent_id, 'new' AS source FROM parents WHERE collection = 'legal')
    SELECT parent_id, source FROM p WHERE parent_id NOT IN (SELECT parent_id FROM n) UNION ALL SELECT * FROM n""",
)
def _merged_parents(spark, d):
    old = table(spark, d, "parents").select("parent_id", "source").distinct()
    new = table(spark, d, "parents").filter("collection = 'legal'").select("parent_id", F.lit("new").alias("source")).distinct()
    return store.merged(old, new, ["parent_id"])


@_query("S16_collections", "SELECT collection, count(DISTINCT source) AS sources, count(*) AS rows FROM documents GROUP BY 1")
def _collections(spark, d):
    return analytics.collections(table(spark, d, "documents"))


@_query("S15_source_scroll", "SELECT doc_id, page FROM documents WHERE source = 'quy-che-kho.docx'")
def _scroll(spark, d):
    return table(spark, d, "documents").filter(F.col("source") == "quy-che-kho.docx").select("doc_id", "page")


# -- analytics -----------------------------------------------------------------------------------

_SPINE = "(SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)"


def _daily(name: str, table_: str, ts: str, where: str = "true") -> None:
    _QUERIES[name] = lambda spark, d: analytics.daily(table(spark, d, table_).filter(where), ts, AS_OF)
    _SQL[name] = f"SELECT s.day, coalesce(n, 0) AS n FROM {_SPINE} s LEFT JOIN (SELECT CAST({ts} AS DATE) AS day, count(*) AS n FROM {table_} WHERE {where} GROUP BY 1) c USING (day)"


_daily("A02_users_per_day", "users", "created_at")
_daily("A03_sessions_per_day", "chat_sessions", "created_at")
_daily("A04_answers_per_day", "chat_messages", "created_at", "role = 'assistant'")
_daily("A05_feedback_per_day", "feedback", "timestamp")
_daily("X25_J07_events_per_day", "events", "ts")


@_query("A01_totals", "SELECT 'users' AS name, count(DISTINCT id) AS n FROM users UNION ALL SELECT 'sessions', count(DISTINCT id) FROM chat_sessions UNION ALL SELECT 'messages', count(DISTINCT id) FROM chat_messages")
def _totals(spark, d):
    return analytics.totals({"users": table(spark, d, "users"), "sessions": table(spark, d, "chat_sessions"), "messages": table(spark, d, "chat_messages")})


@_query(
    "A06_A18_ratings",
    "SELECT count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down, count(*) AS total, CAST(round(100.0 * count(*) FILTER (WHERE rating = 'up') / count(*)) AS BIGINT) AS positive_rate FROM feedback",
)
def _ratings(spark, d):
    return analytics.rating_counts(table(spark, d, "feedback"))


_USAGE = "SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS BIGINT)) AS prompt_tokens, sum(CAST(user_id % 50 AS BIGINT)) AS completion_tokens, count(*) AS requests FROM events WHERE CAST(floor(value) AS BIGINT) <> 0 OR user_id % 50 <> 0"
_USAGE = _USAGE.replace("sum(CAST(value AS BIGINT))", "sum(CAST(floor(value) AS BIGINT))")


def _used(spark, d):
    return table(spark, d, "events").select("ts", F.floor("value").alias("prompt"), (F.col("user_id") % 50).alias("completion"))


@_query("A07_usage", _USAGE + " GROUP BY ROLLUP (1)")
def _usage(spark, d):
    return analytics.usage(_used(spark, d), "ts", "prompt", "completion")


@_query("A08_K11_recent_usage", f"SELECT s.day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {_SPINE} s LEFT JOIN (SELECT day, prompt_tokens + completion_tokens AS n FROM ({_USAGE} GROUP BY 1) ORDER BY day DESC LIMIT 30) u ON u.day = s.day")
def _recent(spark, d):
    """The last 30 recorded days on the 30 calendar days; those without a record are 0."""
    recorded = analytics.recorded_days(_usage(spark, d), 30).select("day", (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("n"))
    return analytics.spine(spark, AS_OF).join(recorded, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@_query("A09_parents_per_source", "SELECT coalesce(source, 'Unknown') AS source, count(*) AS n FROM parents GROUP BY 1")
def _per_source(spark, d):
    return analytics.per_source(table(spark, d, "parents"))


@_query("A21_any_positive", f"SELECT bool_or(coalesce(n, 0) > 0) AS shown FROM {_SPINE} s LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) c USING (day)")
def _any(spark, d):
    return analytics.daily(table(spark, d, "events"), "ts", AS_OF).agg(analytics.any_positive("n").alias("shown"))


@_query("X30_busy_minutes", "SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def _busy(spark, d):
    return analytics.busy_minutes(table(spark, d, "events"), "event_type", "ts", 2)


@_query(
    "S08_cache_lookups",
    "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) <= 300000000, false) AS fresh FROM events",
)
def _stale(spark, d):
    return analytics.stale_lookups(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "fresh")


# -- storing, composing and displaying -----------------------------------------------------------


@_query("A20_collection_counts", "SELECT collection, count(DISTINCT parent_id) AS n FROM parents WHERE content IS NOT NULL GROUP BY 1")
def _collection_counts(spark, d):
    rows = table(spark, d, "parents").filter("content is not null").select("collection", F.col("parent_id").alias("passage_id"), F.col("content").alias("text"))
    index = search.index_of(rows, lambda: store.latest(rows, ["collection", "passage_id"], ["text"]))
    return index.table(spark, "passages").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@_query("X26_coerced", "SELECT DISTINCT parent_id, coalesce(source, 'None') AS source, coalesce(summary, 'None') AS summary, CASE WHEN length(content) > 30000 THEN left(content, 30000) || '...' ELSE coalesce(content, 'None') END AS parent_content FROM parents")
def _coerced(spark, d):
    return files.coerced(table(spark, d, "parents").select("parent_id", "source", "summary", F.col("content").alias("parent_content"))).distinct()


@_query("U09_without_collection", "SELECT DISTINCT doc_id FROM documents WHERE collection IS DISTINCT FROM 'legal'")
def _without_collection(spark, d):
    return store.without_collection(table(spark, d, "documents"), "legal").select("doc_id").distinct()


@_query(
    "W06_first_parents",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY rank) AS nth FROM {_CTX}), p AS (SELECT source, min(content) AS full_text FROM parents GROUP BY 1),
    j AS (SELECT c.*, p.full_text, c.source IS NOT NULL AND nth = 1 AS first FROM c LEFT JOIN p ON p.source = c.source), k AS (SELECT * FROM j WHERE first OR coalesce(content, '') <> '')
    SELECT id, rank AS position, CASE WHEN first THEN row_number() OVER (PARTITION BY id ORDER BY rank) ELSE rank END AS rank, source AS parent_id, CASE WHEN first THEN coalesce(full_text, content, '') ELSE coalesce(content, '') END AS content FROM k""",
)
def _first_parents(spark, d):
    children = _contexts(spark, d).select("id", F.col("rank").alias("position"), F.col("source").alias("parent_id"), F.col("content").alias("parent_content"))
    return context.first_parents(children, table(spark, d, "parents").select(F.col("source").alias("parent_id"), "content"), ["id"])


@_query("J01_children_with_parents", _windows_sql("word", *chunking.Sizes().words[1:]).replace("FROM documents", "FROM (SELECT DISTINCT parent_id AS doc_id, content AS text, collection FROM parents)").replace(
    "SELECT doc_id, CAST(", "SELECT * FROM (SELECT doc_id AS parent_id, CAST(").rstrip() + """) JOIN (SELECT parent_id, coalesce(full_text, '') AS full_text FROM (SELECT DISTINCT parent_id, CASE WHEN collection = 'legal' THEN NULL ELSE content END AS full_text FROM parents))
    USING (parent_id)""")
def _children_with_parents(spark, d):
    """Children found by their parent's id; parents of one collection were deleted, so their children have their own copy."""
    parents = table(spark, d, "parents").select("parent_id", "collection", "content").distinct()
    children = parents.select("parent_id", F.posexplode(chunking.child_texts(F.col("content"), "word")).alias("idx", "text"))
    kept = parents.filter("collection is null or collection != 'legal'").select("parent_id", "content")
    found = search.with_parents(children, kept, ["parent_id"])
    return found.select("parent_id", "idx", "text", F.coalesce("parent_content", F.lit("")).alias("full_text"))


@_query("X29_standalone_questions", rf"""SELECT DISTINCT feedback_id, CASE WHEN length({_STRIP.format("coalesce(comment, '')")}) > 0 AND length({_STRIP.format('answer')}) > 5 THEN {_STRIP.format('answer')} ELSE question END AS question FROM feedback""")
def _standalone(spark, d):
    return table(spark, d, "feedback").select("feedback_id", context.reformulated(F.col("question"), F.col("comment"), F.col("answer")).alias("question")).distinct()


_PRICES = "(SELECT DISTINCT id, price_data AS content FROM chat_messages WHERE price_data IS NOT NULL)"


def _priced(spark, d):
    return table(spark, d, "chat_messages").filter("price_data is not null").select("id", F.col("price_data").alias("content")).distinct()


@_query(
    "U04_assembled",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k, rank, content NULLS FIRST) AS INTEGER) AS place, CASE WHEN k = 1 THEN 'price' ELSE 'rag' END AS kind, content
    FROM (SELECT id, 0 AS k, rank, content FROM {_CTX} UNION ALL SELECT id, 1, 0, content FROM {_PRICES})""",
)
def _assembled(spark, d):
    return context.assembled(_contexts(spark, d).select("id", "rank", "content"), _priced(spark, d), ["id"])


@_query(
    "R09_rounds",
    f"""WITH a AS (SELECT DISTINCT id, content AS question FROM chat_messages WHERE role = 'assistant'), b AS ({_SQL['X20_context_blocks']}), p AS (SELECT id, min(content) AS price FROM {_PRICES} GROUP BY 1),
    n AS (SELECT id, count(*) AS n FROM {_CTX} GROUP BY 1)
    SELECT id, question AS standalone, block, coalesce(n, 0) AS n_sources, CASE WHEN n IS NOT NULL AND price IS NOT NULL THEN 'combined' WHEN price IS NOT NULL THEN 'price' WHEN n IS NOT NULL THEN 'rag' ELSE 'none' END AS kind
    FROM a LEFT JOIN b USING (id) LEFT JOIN p USING (id) LEFT JOIN n USING (id)""",
)
def _rounds(spark, d):
    none = F.lit(None).cast("string")
    asked = table(spark, d, "chat_messages").filter("role = 'assistant'").select("id", F.col("content").alias("question"), none.alias("history"), none.alias("response")).distinct()
    rounds = context.answered(asked, _contexts(spark, d), _priced(spark, d), F.col("question"))
    return rounds.select("id", "standalone", "block", F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("n_sources"), "kind")


_OLD = "(SELECT id, max({'updated_at': updated_at, 'user_id': user_id, 'title': title, 'created_at': created_at}) AS r FROM chat_sessions GROUP BY 1)"
_ASKED = f"""(SELECT f.*, coalesce(nullif(session_id, ''), 'new-' || f.id) AS sid, o.r.user_id AS user_id FROM (SELECT 'f' || feedback_id AS id, min(session_id) AS session_id, min(question) AS question, min(answer) AS answer, min(timestamp) AS asked_at FROM feedback GROUP BY feedback_id) f
  LEFT JOIN {_OLD} o ON o.id = f.session_id)"""


def _persisted(spark, d):
    """The feedback's questions and answers stored as messages of their sessions."""
    old = store.latest(table(spark, d, "chat_sessions").select("id", "user_id", "title", "created_at", "updated_at"), ["id"], ["updated_at"])
    messages = table(spark, d, "chat_messages").select("id", "session_id", "user_id", "role", "content", "created_at", "sources", "price_data")
    rows = table(spark, d, "feedback").groupBy(F.concat(F.lit("f"), F.col("feedback_id")).alias("id")).agg(
        F.min("session_id").alias("session_id"), F.min("question").alias("question"), F.min("answer").alias("answer"), F.min("timestamp").alias("created_at")
    )
    asked = rows.join(old.select(F.col("id").alias("session_id"), "user_id"), "session_id", "left").withColumns({c: F.lit(None).cast(messages.schema[c].dataType) for c in ("sources", "price_data")})
    return store.persisted(old, messages, asked)


@_query(
    "U07_appended_messages",
    f"""SELECT id, session_id, role, content, created_at FROM chat_messages UNION ALL SELECT id || '-user', sid, 'user', question, asked_at FROM {_ASKED} UNION ALL SELECT id || '-assistant', sid, 'assistant', answer, asked_at FROM {_ASKED}""",
)
def _appended(spark, d):
    return _persisted(spark, d)[1].select("id", "session_id", "role", "content", "created_at")


@_query(
    "U07_touched_sessions",
    rf"""WITH n AS (SELECT sid AS id, min(user_id) AS user_id, coalesce(nullif(left({_STRIP.format("first(question ORDER BY asked_at NULLS FIRST, id)")}, 80), ''), 'New chat') AS title, min(asked_at) AS created_at, max(asked_at) AS updated_at FROM {_ASKED} GROUP BY 1), o AS {_OLD}
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.r.title, n.title) AS title, CASE WHEN (o.id IS NULL OR n.user_id IS NOT DISTINCT FROM o.r.user_id) AND n.updated_at IS NOT NULL THEN n.updated_at ELSE o.r.updated_at END AS updated_at
    FROM o FULL JOIN n ON o.id = n.id""",
)
def _touched(spark, d):
    return _persisted(spark, d)[0].select("id", "title", "updated_at")


@_query("K10_U03_first_sources", "SELECT DISTINCT id, list_sort(list_distinct(l)) AS every, list_slice(list_sort(list_distinct(l)), 1, 3) AS three FROM (SELECT id, list_filter([x.source for x in coalesce(sources, [])], lambda u: coalesce(u, '') <> '') AS l FROM chat_messages)")
def _first_sources(spark, d):
    urls = F.col("sources.source")
    return table(spark, d, "chat_messages").select("id", context.first_urls(urls).alias("every"), context.first_urls(urls, 3).alias("three")).distinct()


@_query("X09_displayed_prices", _SQL["R05_offers"].replace("SELECT id, name, entry_no,", "SELECT id, entry_no, replace(format('{:,}', CAST(json_extract(p, '$.price_raw') AS BIGINT)), ',', '.') || ' VND' AS shown FROM e WHERE CAST(json_extract(p, '$.price_raw') AS BIGINT) > 0 --"))
def _displayed_prices(spark, d):
    return _offers(spark, d).select("id", "entry_no", semistructured.vnd(F.col("price")).alias("shown"))


@_query("A14_regrouped", _SQL["R05_offers"].replace("SELECT id, name, entry_no,", """SELECT id, coalesce(CASE WHEN entry_no % 3 < 2 THEN name END, '—') AS name, list_sort(list(CAST(json_extract(p, '$.price_raw') AS BIGINT))) AS options,
    min(CAST(json_extract(p, '$.price_raw') AS BIGINT)) AS low FROM e WHERE CAST(json_extract(p, '$.price_raw') AS BIGINT) > 0 GROUP BY 1, 2 --"""))
def _regrouped(spark, d):
    """Flat offers as they are displayed, every second price only as text and every third offer without a name."""
    flat = _offers(spark, d).select("id", F.when(F.col("entry_no") % 3 < 2, F.col("name")).alias("name"), F.when(F.col("entry_no") % 2 == 0, F.col("price")).alias("price_raw"), semistructured.vnd(F.col("price")).alias("price"))
    return semistructured.regrouped(flat, ["id"])


@_query(
    "C12_enriched_parents",
    rf"""SELECT DISTINCT parent_id, coalesce(nullif({_STRIP.format("regexp_extract(summary, '^(.*)', 1)")}, ''), CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END) AS summary,
    coalesce(nullif({_STRIP.format("regexp_extract(target_question, '^(.*)', 1)")}, ''), 'Nội dung đoạn văn là gì?') AS target_question FROM parents""",
)
def _enriched(spark, d):
    """The labelled lines of a model's response, here made of what is stored, else the default."""
    response = F.concat_ws("\n", F.concat(F.lit("SUMMARY: "), F.col("summary")), F.concat(F.lit("TARGET_QUESTION: "), F.col("target_question")))
    return table(spark, d, "parents").select("parent_id", models.summary_of(F.col("content"), response).alias("e")).select("parent_id", "e.*").distinct()


@_query(
    "X24_usage",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE event_id END AS prompt_tokens, CASE event_id % 4 WHEN 3 THEN 0 ELSE user_id END AS completion_tokens FROM events",
)
def _usage_of(spark, d):
    """Token counts under the names that responses use for them, and of a response without any."""
    names = [("usage_metadata", "input_tokens", "output_tokens"), ("token_usage", "prompt_tokens", "completion_tokens"), ("usage", "input_tokens", "completion_tokens")]
    response = F.lit('{"usage": null}')
    for n, (group, a, b) in enumerate(names):
        response = F.when(F.col("event_id") % 4 == n, F.concat(F.lit(f'{{"{group}":{{"{a}":'), F.col("event_id"), F.lit(f',"{b}":'), F.col("user_id"), F.lit("}}"))).otherwise(response)
    return table(spark, d, "events").select("event_id", context.usage_of(response).alias("u")).select("event_id", "u.*")


@_query("C10_token_children")
def _token_children(spark, d):
    """Children of 150 tokens of a public vocabulary with 30 in common; words where the vocabulary file isn't there."""
    path = spark.conf.get("spark.millrace.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    make = (lambda: models.VocabularyTokenizer(path)) if os.path.exists(path) else models.WordTokenizer
    return table(spark, d, "documents").select("doc_id", F.posexplode(models.token_windows(F.col("text"), make)).alias("idx", "text"))


@_query(
    "R11_settings",
    """SELECT * FROM (VALUES ('child_tokens', '150'), ('parent_tokens', '700'), ('parent_paragraphs', '4'), ('child_paragraphs', '1'), ('parent_sentences', '8'), ('child_sentences', '3'), ('parent_words', '400'), ('child_words', '120'),
    ('embed_batch', '64'), ('variations', '3'), ('prefetch', '20'), ('kept', '5'), ('legal_collection', 'legal'), ('drug_collection', 'drug')) t(name, value)""",
)
def _settings(spark, d):
    return Settings.of(spark).table(spark)


def queries() -> dict[str, Query]:
    """Query name to callable."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to SQL; queries without an entry are tested against brute force."""
    return dict(_SQL)
