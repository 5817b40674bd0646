"""Term weights, vectors, fusion and federated retrieval, for batches of queries."""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as X
from millrace.operators import models
from millrace.plans.session import lookup, materialize, scratch, scratch_folder, ship, stamps


def term_weights(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, token, w`` with ``w = 1 + ln(tf)``, rounded so that engines agree before anything is ranked."""
    counts = texts.select(*keys, F.explode(X.tokens(F.col(text_col))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    return counts.select(*keys, "token", F.round(1 + F.log("tf"), 6).alias("w"))


def vocabulary(texts: DataFrame, text_col: str, limit: int = 100_000) -> DataFrame:
    """``token, n``: the most frequent tokens; ties by token."""
    return texts.select(F.explode(X.tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(limit)


def merge_vocabulary(old: DataFrame, new: DataFrame) -> DataFrame:
    """``token, idx``: old numbers stay, unknown tokens get the next ones in the order of tokens.

    Numbers are given within beginnings of three characters with offsets, so no single task sorts all new tokens.
    """
    fresh = new.select("token").filter("token is not null").distinct().join(old, "token", "left_anti")
    ordered = fresh.withColumn("part", F.substring("token", 1, 3))
    within = W.partitionBy("part").orderBy("token")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each beginning of three characters
    offsets = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    top = old.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("top"))
    numbered = ordered.withColumn("k", F.row_number().over(within)).join(offsets, "part").join(F.broadcast(top))
    return old.select("token", "idx").unionByName(numbered.select("token", (F.col("top") + F.coalesce("before", F.lit(0)) + F.col("k")).cast("int").alias("idx")))


def indexed(postings: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, idx, w``: terms by their numbers; terms that the vocabulary lacks are dropped.

    A token that many passages have would be one task, so the commonest of the vocabulary (``n``, how many have it) stay out of the shuffle.
    """
    return lookup(postings, vocabulary.select("token", "idx", "n"), ["token"], "n", keys).filter("idx is not null").select(*keys, "idx", "w")


def top(scored: DataFrame, by: list[str], n: int, tie: list[str], score: str = "score") -> DataFrame:
    """The best ``n`` of each group with ``rank`` from 1; Spark limits each group before and after the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


#: Terms of a block at most, if it has more than one row.
TERMS = 400_000
#: Rows of a block, shares into which the searched rows are split for fewer than so many blocks of queries, and numbers of a table of passages by terms.
_BLOCK, _SHARES, _MANY, _CELLS = 2048, 4, 16, 4_000_000


def listed_terms(postings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tokens, ws``: the terms of each passage in one row."""
    return postings.groupBy(*keys).agg(F.collect_list("token").alias("tokens"), F.collect_list("w").alias("ws"))


def term_lists(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``listed_terms`` of texts that have each key once, counted where they are; texts without tokens have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # not by a filter, which would go below the tokens, so that they would be worked out twice
            some = np.flatnonzero(batch["t"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0)
            for i in range(0, len(some), _BLOCK):
                yield counted(batch.take(pa.array(some[i : i + _BLOCK])))

    def counted(own: pa.RecordBatch) -> pa.RecordBatch:
        row = np.repeat(np.arange(own.num_rows), own["t"].value_lengths().to_numpy(zero_copy_only=False))
        coded = own["t"].flatten().dictionary_encode()
        cell, tf = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, token = np.divmod(cell, len(coded.dictionary))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=own.num_rows))]).astype(np.int32))
        tokens, ws = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(token))), pa.ListArray.from_arrays(ends, pa.array(np.round(1 + np.log(tf), 6)))
        return pa.RecordBatch.from_arrays([*(own[k] for k in keys), tokens, ws], [*keys, "tokens", "ws"])

    ship(texts.sparkSession)
    rows = texts.select(*keys, X.tokens(F.col(text_col)).alias("t"))
    schema = ", ".join(f"{k} {dict(texts.dtypes)[k]}" for k in keys) + ", tokens array<string>, ws array<double>"
    return rows.mapInArrow(count, schema)


def sparse_search(queries: DataFrame, postings: DataFrame, keys: list[str], n: int = 20, by: list[str] | None = None) -> DataFrame:
    """``query_id, keys, score, rank``: dot products of term weights; ``queries`` has ``query_id, token, w``. A weight of 0 is no term."""
    return search_terms(queries, listed_terms(postings, keys), keys, n, by)


def search_texts(queries: DataFrame, texts: DataFrame, keys: list[str], text_col: str, n: int = 20, by: list[str] | None = None, shared: bool = False) -> DataFrame:
    """``sparse_search`` of the ``term_weights`` of texts; those of a key are brought together, but terms aren't shuffled.

    With ``shared`` also the tokens of the query that the least text of the key has, as a text.
    """
    gathered = texts.groupBy(*keys).agg(F.collect_set(text_col).alias("texts"))
    # of one text all tokens are its own
    own = [F.when(F.size("texts") > 1, X.tokens(F.array_min("texts"))).alias("own")] if shared else []
    return search_terms(queries, gathered.select(*keys, F.flatten(F.transform("texts", X.tokens)).alias("tokens"), *own), keys, n, by)


def _term_blocks(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``block``: rows of ``keys, tokens`` and ``ws``, or tokens as often as they occur, packed up to ``_BLOCK`` rows of one group of ``by``; a block has its own numbers of tokens.

    Where a row has ``own``, its other tokens are marked.
    """
    ship(rows.sparkSession)
    weighed, marked, most = "ws" in rows.columns, "own" in rows.columns, TERMS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.zeros(batch.num_rows, dtype=np.int64)
            for k in by:
                codes = batch[k].dictionary_encode(null_encoding="encode")
                group = group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False)
            for g in np.unique(group):
                of_group = np.flatnonzero(group == g)
                ends = np.cumsum(batch["tokens"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[of_group])
                i = 0
                while i < len(of_group):
                    end = max(i + 1, min(i + _BLOCK, int(np.searchsorted(ends, most + (ends[i - 1] if i else 0), "right"))))
                    own = batch.take(pa.array(of_group[i:end]))
                    yield pa.RecordBatch.from_arrays([pa.array([packed(own)], pa.binary())], ["block"])
                    i = end

    def packed(own: pa.RecordBatch) -> bytes:
        coded = own["tokens"].flatten().dictionary_encode()
        row = np.repeat(np.arange(own.num_rows), own["tokens"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if weighed:
            w = own["ws"].flatten().to_numpy(zero_copy_only=False)
        else:
            cell, tf = np.unique(row * len(coded.dictionary) + token, return_counts=True)
            row, token = np.divmod(cell, max(len(coded.dictionary), 1))
            w = np.round(1 + np.log(tf), 6)
        others = np.zeros(0, dtype=np.int32)
        if marked and own["own"].null_count < own.num_rows:
            sizes = own["own"].value_lengths()
            held = np.repeat(np.arange(own.num_rows), sizes.fill_null(0).to_numpy(zero_copy_only=False)) * len(coded.dictionary) + pc.index_in(own["own"].flatten(), coded.dictionary).to_numpy(zero_copy_only=False)
            others = np.flatnonzero(sizes.is_valid().to_numpy(zero_copy_only=False)[row] & ~np.isin(row * len(coded.dictionary) + token, held)).astype(np.int32)
        weights, code = np.unique(w, return_inverse=True)
        small = lambda x, most: x.astype(np.min_scalar_type(max(most, 1)))
        parts = np.bincount(row, minlength=own.num_rows).astype(np.int32), small(token, len(coded.dictionary)), weights, small(code, len(weights)), others
        return pickle.dumps((list(zip(*(own[k].to_pylist() for k in keys), strict=True)), coded.dictionary.to_pylist(), *parts), 5)

    # a filter of rows without tokens would go below the tokens, which would be worked out twice
    return rows.select(*keys, "tokens", *(["ws"] if weighed else []), *(["own"] if marked else [])).mapInArrow(pack, "block binary")


class _Terms:
    """A block of ``_term_blocks``: entries in the order of ``row``, with the number of their token, their weight, and whether they are ``own``."""

    def __init__(self, block: bytes):
        self.keys, self.tokens, self.sizes, token, weights, code, others = pickle.loads(block)
        self.token, self.w = token.astype(np.int64), weights[code]
        self.own = np.ones(len(self.w), dtype=bool)
        self.own[others] = False
        self.row, self.first = np.repeat(np.arange(len(self.sizes)), self.sizes), np.cumsum(self.sizes) - self.sizes
        self.number = {t: i for i, t in enumerate(self.tokens)}


class _Keys:
    """The keys of the rows that a task has seen, and their order."""

    def __init__(self):
        self._sorted: list = []
        self.keys: list[tuple] = []
        self._order = np.zeros(0, dtype=np.int64)

    def add(self, keys: list[tuple]) -> int:
        """The number of the first of some more keys."""
        before = len(self.keys)
        self._sorted += sorted((tuple((v is not None, v) for v in k), before + i) for i, k in enumerate(keys))
        self.keys += keys
        return before

    def order(self) -> np.ndarray:
        """The place of each key; null comes first, as in Spark."""
        if len(self._order) < len(self.keys):
            self._sorted.sort()
            self._order = np.empty(len(self.keys), dtype=np.int64)
            self._order[[i for _, i in self._sorted]] = np.arange(len(self.keys))
        return self._order


class _Best:
    """The best ``n`` rows of each of some queries, ties by the order of keys; ``least`` is the score of the last of them, or -inf while there are fewer.

    A row may carry ``width`` bytes.
    """

    def __init__(self, queries: int, n: int, keys: _Keys, width: int = 0):
        self.n, self.keys, self.width, self.least = n, keys, width, np.full(queries, -np.inf)
        self._parts, self._new = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, width), dtype=np.uint8))], 0

    def add(self, query: np.ndarray, at: np.ndarray, score: np.ndarray, carried: np.ndarray | None = None) -> None:
        """Rows by the numbers of their keys."""
        self._parts.append((query, at, score, np.zeros((len(query), 0), dtype=np.uint8) if carried is None else carried))
        self._new += len(query)
        if self._new > self.n * len(self.least):
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, number of key, score and bytes of the best so far."""
        query, at, score, carried = map(np.concatenate, zip(*self._parts, strict=True))
        ranked = np.lexsort((self.keys.order()[at], -score, query))
        query, at, score = query[ranked], at[ranked], score[ranked]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last, kept = nth == self.n - 1, nth < self.n
        self.least[query[last]] = score[last]
        self._parts, self._new = [(query[kept], at[kept], score[kept], carried[ranked[kept]])], 0
        return self._parts[0]


def _raised(least: np.ndarray, scores: np.ndarray, n: int, margin: np.ndarray) -> np.ndarray:
    """``least`` less ``margin``, or where more than a few rows are above it the ``n``-th of these scores less twice the margin; scores are right within ``margin``."""
    cut = least - margin
    many = np.flatnonzero(np.count_nonzero(scores >= cut.astype(np.float32)[:, None], axis=1) > 2 * n)
    if len(many) and scores.shape[1] > n:
        cut[many] = np.maximum(cut[many], np.partition(scores[many], -n, axis=1)[:, -n] - 2 * margin[many])
    return cut


def _crossed(blocks: DataFrame, asked: DataFrame, search: Callable, schema: str) -> DataFrame:
    """``search`` of rows ``block, asked``: each share of the blocks with each block of queries is one task, which returns only the best of each query.

    Both are written first; what a task returns follows the queries, however many rows are searched. Many blocks of queries keep
    all cores busy without shares, which would each return as much.
    """
    asked = materialize(asked, "asked")
    # a few rows, each a block of queries
    count = asked.count()
    asked = asked.repartition(max(1, count))
    return blocks.coalesce(_SHARES if count < _MANY else 1).join(asked.hint("shuffle_replicate_nl"), how="cross").mapInPandas(search, schema)


def search_terms(queries: DataFrame, passages: DataFrame, keys: list[str], n: int = 20, by: list[str] | None = None) -> DataFrame:
    """``sparse_search`` of passages that are rows of ``listed_terms``, or of ``keys, tokens`` with tokens as often as they occur.

    Nearly every query shares some common token with nearly every passage, so joining by tokens would make a row for each of these pairs. Instead blocks
    of passages meet blocks of queries. Products with the terms that many of both have are one product of matrices, other terms are added singly; only
    pairs that may be among the best ``n`` are then scored exactly. Of passages with ``own`` (tokens, or null where all are) the result has in ``shared``,
    put together by spaces, the tokens of the query that are among them.
    """
    by, marked = by or [], "own" in passages.columns
    schema = f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{k} {dict(passages.dtypes)[k]}" for k in keys) + ", score double" + ", shared string" * marked
    places = [keys.index(k) for k in by]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, tuple[_Keys, dict[bytes, _Best]]] = {}
        asked: dict[bytes, _Terms] = {}
        last = None, None, 0
        for batch in batches:
            for block, questions in zip(batch["block"], batch["asked"], strict=True):
                q = asked.get(questions) or asked.setdefault(questions, _Terms(questions))
                if last[0] != block:
                    own = _Terms(block)
                    known, bests = groups.setdefault(tuple(own.keys[0][i] for i in places), (_Keys(), {}))
                    last = block, own, known.add(own.keys)
                best = bests.get(questions) or bests.setdefault(questions, _Best(len(q.keys), n, known, (int(q.sizes.max()) + 7) // 8 if marked else 0))
                _score(last[1], q, best, last[2])
        for known, bests in groups.values():
            for questions, best in bests.items():
                query, at, score, bits = best.rows()
                ids = [asked[questions].keys[i][0] for i in query]
                found = list(zip(*(known.keys[i] for i in at), strict=True)) or [[] for _ in keys]
                shared = {"shared": pd.Series(_shared(asked[questions], query, bits), dtype=object)} if marked else {}
                yield pd.DataFrame({"query_id": pd.Series(ids, dtype=object), **{k: pd.Series(v, dtype=object) for k, v in zip(keys, found, strict=True)}, "score": score, **shared})

    blocks = materialize(_term_blocks(passages, keys, by), "blocks")
    listed = queries.filter("token is not null").groupBy("query_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("w").alias("ws"))
    return top(_crossed(blocks, _term_blocks(listed, ["query_id"], []).withColumnRenamed("block", "asked"), search, schema), ["query_id", *by], n, keys)


def _shared(q: _Terms, query: np.ndarray, bits: np.ndarray) -> list[str]:
    """The tokens of queries that are marked by bits, in the order of a query's entries."""
    texts, tokens, step = [], pa.array(q.tokens, pa.string()), max(1, _CELLS // bits.shape[1])
    for i in range(0, len(query), step):
        row, bit = np.nonzero(np.unpackbits(bits[i : i + step], axis=1, bitorder="little"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(query[i : i + step])))]).astype(np.int32)
        marked = tokens.take(pa.array(q.token[q.first[query[i : i + step]][row] + bit]))
        texts += pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), marked), " ").to_pylist()
    return texts


def _score(passages: _Terms, q: _Terms, best: _Best, before: int) -> None:
    """Adds to ``best`` the passages of a block, whose keys are numbered from ``before``; if ``best`` carries bytes, with a bit for each entry of the query, set if the passage has it as its own."""
    of = np.fromiter((q.number.get(t, -1) for t in passages.tokens), dtype=np.int64, count=len(passages.tokens))
    # columns of the terms that both have
    shared = np.full(len(q.tokens), -1)
    shared[of[of >= 0]] = np.arange((of >= 0).sum())
    column, width = np.append(shared, -1)[of], int((of >= 0).sum())
    if not width:
        return
    asked = shared[q.token]
    q_row, q_col, q_w = q.row[asked >= 0], asked[asked >= 0], q.w[asked >= 0]
    q_bit = (np.arange(len(q.row)) - q.first[q.row])[asked >= 0]
    q_size = np.bincount(q_row, minlength=len(q.sizes))
    q_first, q_often = np.cumsum(q_size) - q_size, np.bincount(q_col, minlength=width)
    total = np.bincount(q_row, np.abs(q_w), len(q.sizes))
    step = max(1, _CELLS // width)
    for start in range(0, len(passages.sizes), step):
        size = min(step, len(passages.sizes) - start)
        a, b = passages.first[start], passages.first[start + size - 1] + passages.sizes[start + size - 1]
        own = column[passages.token[a:b]]
        row, col, w = passages.row[a:b][own >= 0] - start, own[own >= 0], passages.w[a:b][own >= 0]
        if not len(row):
            continue
        table = np.zeros((size, width))
        table[row, col] = w
        kept = passages.own[a:b][own >= 0]
        others = row[~kept] * width + col[~kept]
        often = np.bincount(col, minlength=width)
        common = q_often * often > 0.003 * len(q.sizes) * size
        number = np.where(common, np.cumsum(common) - 1, -1)
        dense = number[q_col] >= 0
        matrix = np.zeros((len(q.sizes), int(common.sum())), dtype=np.float32)
        matrix[q_row[dense], number[q_col[dense]]] = q_w[dense]
        scores = matrix @ table[:, common].astype(np.float32).T
        by_col = np.argsort(col, kind="stable")
        first = np.cumsum(often) - often
        held = often[q_col[~dense]]
        flat = by_col[np.repeat(first[q_col[~dense]] - (np.cumsum(held) - held), held) + np.arange(held.sum())]
        np.add.at(scores.reshape(-1), np.repeat(q_row[~dense], held) * size + row[flat], (np.repeat(q_w[~dense], held) * w[flat]).astype(np.float32))
        # of single precision, and 6 decimals
        margin = total * np.abs(w).max() * (matrix.shape[1] + q_size.max() + 8) * 2.0**-23 + 2e-6
        if w.min() > 0 and q_w.min() > 0:
            cut = np.maximum(_raised(best.least, scores, best.n, margin), 1e-30)
        else:
            cut = best.least - margin
        near = np.flatnonzero(scores >= cut.astype(np.float32)[:, None])
        for i in range(0, len(near), 100_000):
            query, at = np.divmod(near[i : i + 100_000], size)
            some = q_size[query] > 0
            query, at = query[some], at[some]
            if not len(query):
                continue
            held = q_size[query]
            begin = np.cumsum(held) - held
            flat = np.repeat(q_first[query] - begin, held) + np.arange(held.sum())
            weight = table[np.repeat(at, held), q_col[flat]]
            # whole numbers, so the sum is exact whatever its order
            parts = np.add.reduceat(np.floor(q_w[flat] * weight * 1e9 + 0.5), begin)
            hit = np.logical_or.reduceat(weight != 0, begin)
            score = np.floor(parts / 1000 + 0.5) / 1e6
            hit &= score >= best.least[query]
            bits = None
            if best.width:
                has = (weight != 0) & np.repeat(hit, held)
                if len(others):
                    has &= ~np.isin(np.repeat(at, held) * width + q_col[flat], others)
                bits, bit = np.zeros((int(hit.sum()), best.width), dtype=np.uint8), q_bit[flat[has]]
                np.bitwise_or.at(bits, (np.repeat(np.cumsum(hit) - 1, held)[has], bit // 8), (1 << bit % 8).astype(np.uint8))
            best.add(query[hit], before + start + at[hit], score[hit], bits)


def _packed(vectors: DataFrame, id_col: str, vector_col: str, prefix: str, group_col: str | None = None) -> DataFrame:
    """Vectors packed into blocks of at most ``_BLOCK`` rows of one group; rows without id or vector are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, rows in batch.groupby("g", dropna=False):
                for i in range(0, len(rows), _BLOCK):
                    part = rows.iloc[i : i + _BLOCK]
                    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in part["v"]])
                    yield pd.DataFrame({f"{prefix}_group": [group], f"{prefix}_ids": [part["i"].tolist()], f"{prefix}_matrix": [matrix.tobytes()]})

    group = F.col(group_col).cast("string") if group_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("string").alias("i"), F.col(vector_col).alias("v"), group.alias("g")).filter("v is not null and i is not null")
    return rows.mapInPandas(pack, f"{prefix}_group string, {prefix}_ids array<string>, {prefix}_matrix binary")


def dense_search(queries: DataFrame, corpus: DataFrame, id_col: str, vector_col: str, n: int = 20, query_col: str | None = None, group_col: str | None = None) -> DataFrame:
    """``query_id, group, id, score, rank``: exact cosine neighbours of each query among all rows (of each group), itself left out.

    Both sides are packed into blocks; a pair of blocks is one matrix product of which only what may be among the best ``n`` is
    worked out exactly, and what is shuffled is ``n`` rows for each query and share of the corpus. Ids are strings.
    """
    return _near(_packed(queries, query_col or id_col, vector_col, "q"), materialize(_packed(corpus, id_col, vector_col, "c", group_col), "vectors"), n)


def _near(q: DataFrame, c: DataFrame, n: int) -> DataFrame:
    """The search of ``dense_search`` over vectors that are packed already and, those of the corpus, written."""
    ship(q.sparkSession)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[str | None, tuple[_Keys, dict[tuple, _Best]]] = {}
        asked: dict[tuple, tuple] = {}
        last, own = (None, None), None
        for batch in batches:
            for group, q_ids, q_matrix, c_ids, c_matrix in zip(batch["c_group"], batch["q_ids"], batch["q_matrix"], batch["c_ids"], batch["c_matrix"], strict=True):
                ids = tuple(q_ids)
                questions = asked.get(ids) or asked.setdefault(ids, _unit(q_matrix, len(ids)))
                if last != (group, c_matrix) or list(c_ids) != own[1]:
                    known, bests = groups.setdefault(group, (_Keys(), {}))
                    last, own = (group, c_matrix), (_unit(c_matrix, len(c_ids)), list(c_ids), known.add([(i,) for i in c_ids]))
                best = bests.get(ids) or bests.setdefault(ids, _Best(len(ids), n, known))
                _compare(questions, ids, own[0], own[1], best, own[2])
        for group, (known, bests) in groups.items():
            for ids, best in bests.items():
                query, at, score, _ = best.rows()
                yield pd.DataFrame({"query_id": pd.Series([ids[i] for i in query], dtype=object), "group": pd.Series([group] * len(at), dtype=object), "id": pd.Series([known.keys[i][0] for i in at], dtype=object), "score": score})

    found = _crossed(c, q.select("q_ids", "q_matrix"), search, "query_id string, group string, id string, score double")
    return top(found, ["query_id", "group"], n, ["id"])


def _unit(matrix: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a block, their lengths, and the vectors of length 1 in single precision."""
    m = np.frombuffer(matrix).reshape(rows, -1)
    norm = np.maximum(np.linalg.norm(m, axis=1), 1e-12)
    return m, norm, (m / norm[:, None]).astype(np.float32)


def _compare(q: tuple, q_ids: tuple, c: tuple, c_ids: list, best: _Best, before: int) -> None:
    """Adds to ``best`` the vectors of a block, whose keys are numbered from ``before``, by their cosines."""
    scores = q[2] @ c[2].T
    at_query: dict[str, list[int]] = {}
    for i, x in enumerate(q_ids):
        at_query.setdefault(x, []).append(i)
    for j, x in enumerate(c_ids):
        if x in at_query:
            scores[at_query[x], j] = -np.inf
    # of single precision, and 6 decimals
    margin = np.full(len(q_ids), (q[0].shape[1] + 8) * 2.0**-23 + 2e-6)
    near = np.flatnonzero(scores >= np.maximum(_raised(best.least, scores, best.n, margin), -2).astype(np.float32)[:, None])
    for i in range(0, len(near), 100_000):
        query, at = np.divmod(near[i : i + 100_000], len(c_ids))
        x = np.einsum("ij,ij->i", q[0][query], c[0][at]) / q[1][query] / c[1][at]
        score = np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0
        hit = score >= best.least[query]
        best.add(query[hit], before + at[hit], score[hit])


def fuse(ranked: DataFrame, by: list[str], keys: list[str], n: int = 20, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of the union of ranked lists (``by, keys, rank``)."""
    scored = ranked.groupBy(*by, *keys).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 6).alias("score"))
    return top(scored, by, n, keys)


def rerank(candidates: DataFrame, query_col: str, text_col: str, keys: list[str], n: int = 5) -> DataFrame:
    """The best ``n`` of each query over all collections by the re-ranker, of the distinct tokens of queries and the tokens of texts."""
    scored = candidates.withColumn("score", models.token_score(F.col(query_col), F.col(text_col)))
    return top(scored, ["query_id"], n, keys)


@dataclass(frozen=True)
class Index:
    """The written tables of a passage store: ``passages``, their ``terms`` (of ``listed_terms``), their ``vectors`` packed in blocks of a collection."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One of the tables."""
        return spark.read.parquet(f"{self.path}/{name}")


_KEYS = ["collection", "passage_id"]


def build_index(passages: DataFrame, path: str, embedder: models.Embedder | None = None) -> Index:
    """Tokenise and embed ``passages`` (``collection, passage_id, text``, each once) and write what a search reads. Ids of passages are strings."""
    return append_to_index(Index(path), passages, embedder)


def append_to_index(index: Index, passages: DataFrame, embedder: models.Embedder | None = None) -> Index:
    """Add the passages that an index lacks; what it has stays as it is, so appending again changes nothing."""
    spark = passages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/passages")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        passages = passages.join(index.table(spark, "passages").select(*_KEYS), _KEYS, "left_anti")
    write = lambda rows, name: rows.write.mode("append").option("compression", "zstd").parquet(f"{index.path}/{name}")
    with scratch(spark):
        new = materialize(passages.select(*_KEYS, "text"), "new")
        write(term_lists(new, _KEYS, "text"), "terms")
        vectors = new.select(*_KEYS, models.embed(F.col("text"), embedder or models.HashEmbedder()).alias("v"))
        ship(spark)
        write(_packed(vectors, "passage_id", "v", "c", "collection"), "vectors")
        # last, since this table says what the index has
        write(new, "passages")
    return index


def index_of(rows: DataFrame, passages: Callable[[], DataFrame]) -> Index:
    """The index of the files that ``rows`` reads, built on first use in an application and again when a file has changed."""
    spark = rows.sparkSession
    key = hashlib.sha256(repr((stamps(spark, *rows.inputFiles()), rows.columns)).encode()).hexdigest()[:24]
    known = spark.sparkContext.__dict__.setdefault("_millrace_indexes", {})
    if key not in known:
        known[key] = build_index(passages(), f"{scratch_folder(spark)}/index-{key}-{uuid.uuid4().hex}")
    return known[key]


def retrieve(questions: DataFrame, passages: DataFrame, variations: int = 3, prefetch: int = 20, fused: int = 20, kept: int = 5) -> DataFrame:
    """``retrieve_from`` an index of ``passages`` that is only built for these questions."""
    index = build_index(passages, f"{scratch_folder(passages.sparkSession)}/index-{uuid.uuid4().hex}")
    return retrieve_from(index, questions, variations, prefetch, fused, kept)


def retrieve_from(index: Index, questions: DataFrame, variations: int = 3, prefetch: int = 20, fused: int = 20, kept: int = 5) -> DataFrame:
    """Federated hybrid retrieval in one plan.

    ``questions``: ``query_id, question, response`` (a model's variations or null). Each variation gives a dense list and all texts together one sparse list for each
    collection; the lists are fused for each collection, the fused passages of all collections re-ranked.
    """
    spark = questions.sparkSession
    listed, vectors = index.table(spark, "terms"), index.table(spark, "vectors")
    asked = questions.select("query_id", "question", models.expansions(F.col("question"), F.col("response"), variations).alias("texts"))
    # the question stands among its variations, so it counts twice in the term weights
    terms = term_weights(asked.select("query_id", F.explode(F.concat(F.array("question"), F.col("texts"))).alias("text")), ["query_id"], "text")
    sparse = search_terms(terms, listed, _KEYS, prefetch, ["collection"])
    q = asked.select("query_id", F.posexplode("texts").alias("variation", "text")).select(
        F.concat_ws("\u0001", "query_id", "variation").alias("qv"), models.embed(F.col("text"), models.HashEmbedder()).alias("v")
    )
    near = _near(_packed(q, "qv", "v", "q"), vectors, prefetch)
    dense = near.select(F.substring_index("query_id", "\u0001", 1).cast(questions.schema["query_id"].dataType).alias("query_id"), F.col("group").alias("collection"), F.col("id").alias("passage_id"), "rank")
    lists = sparse.select("query_id", *_KEYS, "rank").unionByName(dense)
    best = fuse(lists, ["query_id", "collection"], ["passage_id"], fused).select("query_id", *_KEYS)
    # the index has the tokens of the passages, those of a question are worked out once; a question has fewer, so they come to the passages.
    # tokens have no space, and a text of them is a fraction of an array in a shuffle
    words = F.array_join(F.array_distinct(X.tokens(F.col("question"))), " ")
    held = listed.select(*_KEYS, F.array_join("tokens", " ").alias("held"))
    full = best.join(questions.select("query_id", words.alias("words")), "query_id").join(held, _KEYS, "left")
    scored = full.withColumn("score", models.token_score(F.split("words", " "), F.split(F.coalesce("held", F.lit("")), " "))).drop("words", "held")
    return top(scored, ["query_id"], kept, _KEYS)


def with_parents(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the parent's content, or the child's own copy where the parent is gone."""
    own = parents.select(*keys, F.col("content").alias("parent_content"))
    return children.join(own, keys, "left").withColumn("content", F.coalesce("parent_content", "text"))


#: What the display of a cut passage leaves at its end: half a tag, entity or character, or marks that something is missing.
_DEBRIS = r"\s*(?:\[?(?:\.\.\.|…)\]?|\x{FFFD}|<[a-z/]*|&[a-z0-9#]*)?\s*$"


def with_displayed_parents(shown: DataFrame, parents: DataFrame, keys: list[str], near: int = 60) -> DataFrame:
    """Adds ``content``: that of the parent that a displayed ``text`` (cut, with debris of the cut) begins, or the text itself where there is none.

    ``shown`` has ``keys, source, text``, ``parents`` has ``source, content``. The first ``near`` characters only find candidates;
    a parent has to begin with the whole text. Of several, which the text can't tell apart, the smallest is taken.
    """
    key = lambda t: F.xxhash64("source", F.left(t, F.lit(near)))
    of = parents.filter("source is not null and content is not null").select(key(F.col("content")).alias("_k"), F.col("source").alias("_source"), F.col("content").alias("_content")).distinct()
    keyed = shown.withColumn("_k", F.when(F.col("source").isNotNull() & F.col("text").isNotNull(), key(F.col("text"))))
    some = F.col("_k").isNotNull()
    plain = F.regexp_replace("text", _DEBRIS, "")
    begins = (F.col("source") == F.col("_source")) & (F.startswith("_content", "text") | ((plain != "") & F.startswith("_content", plain)))
    # rows without a key, of which there may be many, bypass the join
    found = keyed.filter(some).join(of, "_k", "left").groupBy(*keys, "source", "text").agg(F.min(F.when(begins, F.col("_content"))).alias("_parent"))
    rest = keyed.filter(~some).select(*keys, "source", "text", F.lit(None).cast("string").alias("_parent"))
    return found.unionByName(rest).withColumn("content", F.coalesce("_parent", "text")).drop("_parent")


def near_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``query, name``: the names near each query (``text.is_near_name``); ``queries`` has ``query``, ``names`` has ``name``, each once.

    Where a word contains another it also contains its first three letters, and a stem of four begins with three. So a query meets the names
    that have the first letters of one of its words anywhere, and those of which it has the first letters of a word; blank ones meet all.
    """
    words = lambda c: X.words(X.plain_words(F.col(c)))
    begins = lambda ws: F.transform(ws, lambda w: F.left(w, F.lit(3)))
    parts = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(w, i, n))))
    inside = lambda ws: F.flatten(F.transform(ws, parts))
    key = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    blank = lambda kind, ws: F.when(F.size(ws) == 0, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    q, n = words("query"), words("name")
    asked = queries.select("query", F.explode(F.array_distinct(F.concat(key("a", begins(q)), key("b", inside(q)), blank("c", q), F.array(F.lit("d"))))).alias("k"))
    known = names.select("name", F.explode(F.array_distinct(F.concat(key("a", inside(n)), key("b", begins(n)), F.array(F.lit("c")), blank("d", n)))).alias("k"))
    return asked.join(known, "k").select("query", "name").distinct().filter(X.is_near_name(F.col("query"), F.col("name")))
