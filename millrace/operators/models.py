"""Model seams with deterministic defaults: embedding, re-ranking, expansion and summaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.plans.session import ship


_TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


class Embedder(Protocol):
    """Turns texts into vectors of one size; loaded in the Python worker, called a batch at a time."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed token hashing, so whole numbers; the same on every machine, and in SQL: the first eight hexadecimal digits of a token's MD5."""

    #: Tokens whose places a worker keeps; when full it begins anew.
    KEPT = 200_000

    def __init__(self, size: int = 64):
        self.size, self._known = size, {}

    def _place(self, token: str) -> tuple[int, int]:
        h = int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        if len(self._known) >= self.KEPT:
            self._known.clear()
        self._known[token] = found = (h % self.size, 1 if h >> 31 else -1)
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows, places, signs = [], [], []
        for i, t in enumerate(texts):
            for token in _TOKENS.findall((t or "").lower()):
                at, sign = self._known.get(token) or self._place(token)
                rows.append(i)
                places.append(at)
                signs.append(sign)
        flat = np.bincount(np.array(rows, dtype=np.int64) * self.size + np.array(places, dtype=np.int64), signs, len(texts) * self.size) if rows else np.zeros(len(texts) * self.size)
        return flat.reshape(len(texts), self.size).astype(np.float32)


def embed(text: Column, model: Embedder, batch: int = 64, attempts: int = 5) -> Column:
    """Vectors of a text column; batches that fail are tried again, then the task fails and Spark retries it."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in series:
            vectors = []
            for i in range(0, len(part), batch):
                for left in range(attempts, 0, -1):
                    try:
                        vectors += list(model([t or "" for t in part.iloc[i : i + batch]]))
                        break
                    except Exception:
                        if left == 1:
                            raise
            yield pd.Series(vectors)

    ship(SparkSession.active())
    return run(text)


def lexical_score(query: Column, text: Column) -> Column:
    """The default re-ranker: share of the query's distinct tokens that the text has; 0 for an empty query."""
    return token_score(F.array_distinct(X.tokens(query)), X.tokens(text))


def token_score(query: Column, text: Column) -> Column:
    """``lexical_score`` of tokens that are worked out already, those of the query distinct."""
    return F.round(F.coalesce(F.size(F.array_intersect(query, text)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0)), 6)


def expansions(query: Column, response: Column, n: int = 3) -> Column:
    """The query followed by up to ``n`` distinct cleaned lines of a model's response; null or blank responses leave the query."""
    lines = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), X.strip_space), lambda x: x != "")
    clean = F.transform(F.slice(lines, F.lit(1), F.lit(n + 2)), lambda x: X.strip_space(F.regexp_replace(x, r"^[\d.)\-*]+\s*", "")))
    return F.concat(F.array(query), F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), F.lit(1), F.lit(n)))


def summary_of(content: Column, response: Column) -> Column:
    """``summary, target_question`` from a labelled response, else the beginning of the content and a fixed question."""
    return F.struct(
        F.coalesce(X.labelled_line(response, "SUMMARY"), X.shortened(content, 200)).alias("summary"),
        F.coalesce(X.labelled_line(response, "TARGET_QUESTION"), F.lit("Nội dung đoạn văn là gì?")).alias("target_question"),
    )


class Tokenizer(Protocol):
    """Splits a text into token ids and back; made in the Python worker."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class WordTokenizer:
    """Words with the space before them as tokens, numbered as they come; for where no vocabulary is at hand."""

    def __init__(self):
        self._ids: dict[str, int] = {}
        self._words: list[str] = []

    def encode(self, text: str) -> list[int]:
        out = []
        for word in re.findall(r"\s*\S+|\s+$", text):
            if word not in self._ids:
                self._ids[word] = len(self._words)
                self._words.append(word)
            out.append(self._ids[word])
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self._words[i] for i in ids)


class VocabularyTokenizer:
    """A public byte-level vocabulary file, read by the public library; the pattern is that of the vocabulary."""

    def __init__(self, path: str, pattern: str = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self._encoding.decode(ids)


def token_windows(text: Column, make: Callable[[], Tokenizer], size: int = 150, overlap: int = 30) -> Column:
    """Windows of ``size`` tokens, each after the first beginning ``overlap`` tokens before the end of the one before; the last ends with the text. Null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")

    @F.pandas_udf("array<string>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for part in series:
            out = []
            for t in part:
                ids = own.encode(t) if isinstance(t, str) else []
                out.append([own.decode(ids[i : i + size]) for i in range(0, max(1, len(ids) - overlap), size - overlap)] if ids else [])
            yield pd.Series(out)

    ship(SparkSession.active())
    return run(text)


#: Embedders by the beginning of a model's name; the longest that fits is taken.
_EMBEDDERS: dict[str, Callable[[str], Embedder]] = {"": lambda name: HashEmbedder(), "hash-": lambda name: HashEmbedder(int(name.rpartition("-")[2]))}


def register_embedder(prefix: str, make: Callable[[str], Embedder]) -> None:
    """Models whose name begins with ``prefix`` are made by ``make`` from their name."""
    _EMBEDDERS[prefix] = make


def embedder(name: str) -> Embedder:
    """The embedder of a model's name; ``hash-<size>`` and names that nothing was registered for give the deterministic default."""
    return _EMBEDDERS[max((p for p in _EMBEDDERS if name.startswith(p)), key=len)](name)
