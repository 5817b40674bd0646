"""Splitting documents into parents and children with a strategy chosen from their statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import models
from millrace.plans.session import ship


@dataclass(frozen=True)
class Sizes:
    """Units per parent, and per child with their overlap."""

    paragraphs: tuple[int, int, int] = (4, 1, 0)
    sentences: tuple[int, int, int] = (8, 3, 1)
    words: tuple[int, int, int] = (400, 120, 30)
    section_tokens: int = 700
    child_tokens: tuple[int, int] = (150, 30)


def statistics(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds counts of paragraphs, sentences and words, and words per paragraph and sentence; null counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    counted = documents.withColumns({"n_paragraphs": F.size(X.paragraphs(t)), "n_sentences": F.size(X.sentences(t)), "n_words": F.size(X.words(t))})
    per = lambda c: F.col("n_words") / F.greatest(F.lit(1), F.col(c))
    return counted.withColumns({"words_per_paragraph": per("n_paragraphs"), "words_per_sentence": per("n_sentences")})


def strategy(stats: DataFrame) -> DataFrame:
    """Adds ``strategy``: ``paragraph``, ``sentence`` or ``semantic_tokens``."""
    chosen = (
        F.when((F.col("n_paragraphs") >= 10) & F.col("words_per_paragraph").between(40, 200), "paragraph")
        .when((F.col("n_sentences") >= 20) & F.col("words_per_sentence").between(10, 60), "sentence")
        .otherwise("semantic_tokens")
    )
    return stats.withColumn("strategy", chosen)


_UNITS = {"paragraph": (X.paragraphs, "\n\n", "paragraphs"), "sentence": (X.sentences, " ", "sentences"), "word": (X.words, " ", "words")}


def parent_texts(text: Column, kind: str, sizes: Sizes = Sizes()) -> Column:
    """Parents of one kind of unit, without overlap."""
    split, joint, name = _UNITS[kind]
    return X.windows(split(F.coalesce(text, F.lit(""))), getattr(sizes, name)[0], 0, joint)


def child_texts(text: Column, kind: str, sizes: Sizes = Sizes()) -> Column:
    """Children of one kind of unit, overlapping."""
    split, joint, name = _UNITS[kind]
    _, size, overlap = getattr(sizes, name)
    return X.windows(split(F.coalesce(text, F.lit(""))), size, overlap, joint)


_HEADER = re.compile(r"^(#{1,3})\s+(.*\S)\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """Markdown sections with the headers above them; each keeps its header line, headers in code fences don't count."""
    out: list[tuple[list[str], dict[str, str]]] = []
    headers: dict[int, str] = {}
    fenced = False
    for line in text.split("\n"):
        fenced ^= bool(_FENCE.match(line))
        found = None if fenced else _HEADER.match(line)
        if found:
            level = len(found[1])
            headers = {k: v for k, v in headers.items() if k < level} | {level: found[2]}
        if found or not out:
            out.append(([], {f"Header {k}": v for k, v in headers.items()}))
        out[-1][0].append(line)
    return [("\n".join(lines).strip(), meta) for lines, meta in out if "\n".join(lines).strip()]


def cut_recursively(text: str, limit: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ".", " ", "")) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the coarsest separator that allows it, overlapping by up to ``overlap``."""
    if len(text) <= limit:
        return [text] if text.strip() else []
    separator = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(separator) + 1 :] or ("",)
    units = list(text) if separator == "" else [u + separator for u in text.split(separator)[:-1]] + [text.rsplit(separator, 1)[-1]]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for unit in units:
        if len(unit) > limit:
            if held:
                out.append("".join(held))
            held, size = [], 0
            out += cut_recursively(unit, limit, overlap, finer)
            continue
        if size + len(unit) > limit and held:
            out.append("".join(held))
            while held and (size > overlap or size + len(unit) > limit):
                size -= len(held.pop(0))
        held.append(unit)
        size += len(unit)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def _semantic(tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                n = 0
                for body, headers in sections(text or ""):
                    parts = cut_recursively(body, tokens * 4, 200) if len(re.findall(r"\w+", body)) > tokens else [body]
                    for part in parts:
                        rows.append((key, n, part, headers))
                        n += 1
            yield pd.DataFrame(rows, columns=["key", "parent_idx", "content", "headers"])

    return run


def semantic_parents(documents: DataFrame, key: str, text_col: str = "text", tokens: int = 700) -> DataFrame:
    """``key, parent_idx, content, headers`` by Markdown header, long sections cut recursively. The only chunker in Python."""
    ship(documents.sparkSession)
    return documents.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text")).mapInPandas(
        _semantic(tokens), "key string, parent_idx int, content string, headers map<string,string>"
    )


def build_parents(documents: DataFrame, key: str, text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """``key, strategy, parent_idx, content``: every document by the strategy of its own statistics."""
    chosen = strategy(statistics(documents.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))))
    unit = lambda name, kind: (
        chosen.filter(F.col("strategy") == name).select("key", "strategy", F.posexplode(parent_texts(F.col("text"), kind, sizes)).alias("parent_idx", "content"))
    )
    semantic = semantic_parents(chosen.filter("strategy = 'semantic_tokens'"), "key", "text", sizes.section_tokens)
    return unit("paragraph", "paragraph").unionByName(unit("sentence", "sentence")).unionByName(semantic.select("key", F.lit("semantic_tokens").alias("strategy"), "parent_idx", "content"))


def build_children(parents: DataFrame, sizes: Sizes = Sizes(), make: Callable[[], models.Tokenizer] | None = None) -> DataFrame:
    """``key, strategy, parent_idx, parent_id, chunk_index, text``; blank children are left out, their index stays free.

    ``make`` gives the tokenizer of the semantic strategy's children; without one words stand for tokens.
    """
    content = F.col("content")
    size, overlap = sizes.child_tokens
    tokens = models.token_windows(content, make, size, overlap) if make else X.windows(X.words(content), size, overlap, " ")
    made = F.when(F.col("strategy") == "paragraph", child_texts(content, "paragraph", sizes)).when(F.col("strategy") == "sentence", child_texts(content, "sentence", sizes)).otherwise(tokens)
    out = parents.select("key", "strategy", "parent_idx", X.parent_id(content, F.col("parent_idx")).alias("parent_id"), F.posexplode(made).alias("chunk_index", "text"))
    return out.withColumn("text", X.strip_space("text")).filter("text != ''")
