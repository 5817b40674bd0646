"""Encoding texts with a public byte-level BPE vocabulary.

Prefix dynamic programming: for each byte prefix of a pre-token the one *valid last token* is stored.
Two tokens are compatible when merging their joined bytes gives these two tokens back; a sequence is the
vocabulary's encoding exactly when all its neighbours are compatible, so each prefix has
one valid last token, found from the longest matching suffix down, and following the stored tokens
back from the end gives the ids. The table grows by appending: an append or an edit only
needs prefixes from the pre-token in which it falls (``PrefixText``).

Defined results: a null and an empty text both give an empty list; strings that look like special tokens
are ordinary text; lone surrogates are encoded as the replacement character. Repeated rows stay repeated;
extra columns are kept. The vocabulary is a file named by a parameter and is loaded
once per Python worker; it isn't part of the repository.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on every node, and the file's name.
FOLDER, NAME = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's table of pre-tokens already encoded; it is emptied when full.
KEPT = 200_000


def vocabulary_path(spark) -> str:
    """The vocabulary file: the setting ``spark.millrace.tokenizer``, or the default place."""
    return spark.conf.get("spark.millrace.tokenizer", os.path.join(FOLDER, NAME))


class Encoder:
    """A vocabulary and what has been worked out with it."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self.word = {rank: word for word, rank in self.ranks.items()}
        self.split = regex.compile(PATTERN)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def _merge(self, word: bytes) -> list[bytes]:
        """Plain merging by lowest rank; used on at most two tokens at a time."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; a left of -1 is the beginning."""
        if (found := self._pairs.get((left, right))) is None:
            if len(self._pairs) > 4 * KEPT:
                self._pairs.clear()
            words = [self.word[right]] if left < 0 else [self.word[left], self.word[right]]
            found = self._pairs[left, right] = self._merge(b"".join(words)) == words
        return found

    def last_tokens(self, word: bytes, table: list[int] | None = None) -> list[int]:
        """The valid last token of each prefix of ``word``; a table of a shorter prefix is continued."""
        table = [] if table is None else table
        for end in range(len(table) + 1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(word[start:end])
                if token is not None and self.compatible(table[start - 1] if start else -1, token):
                    table.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return table

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (found := self._known.get(piece)) is None:
            word = piece.encode("utf-8", "replace")
            if (whole := self.ranks.get(word)) is not None and self.compatible(-1, whole):
                found = (whole,)
            else:
                table, end, ids = self.last_tokens(word), len(word), []
                while end:
                    ids.append(table[end - 1])
                    end -= len(self.word[table[end - 1]])
                found = tuple(reversed(ids))
            if len(piece) <= 64:
                if len(self._known) >= KEPT:
                    self._known.clear()
                self._known[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        ids: list[int] = []
        known, piece = self._known, self.piece
        for part in self.split.findall(text or ""):
            ids += known.get(part) or piece(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return b"".join(self.word[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


class PrefixText:
    """A text with its encoding, kept up to date under appends and edits.

    Pre-tokens before the change are kept; from the change on the text is split again until a boundary
    meets one of the old split, after which the old pre-tokens are kept, too.
    """

    def __init__(self, path: str, text: str = ""):
        self._encoder = encoder(path)
        self.text = text
        self._starts = [m.start() for m in self._encoder.split.finditer(text)]

    def ids(self) -> list[int]:
        """The ids of the text as it is now."""
        ends = [*self._starts[1:], len(self.text)][: len(self._starts)]
        return [i for a, b in zip(self._starts, ends, strict=True) for i in self._encoder.piece(self.text[a:b])]

    def append(self, more: str) -> int:
        """Add text at the end; returns how many pre-tokens were split again."""
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]``; returns how many pre-tokens were split again."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        # a pre-token looks at most one character past its end, so the two before the change may differ
        first = max(0, bisect_left(self._starts, start) - 2)
        at = self._starts[first] if self._starts else 0
        old = self._starts
        fresh: list[int] = []
        keep: list[int] = []
        for m in self._encoder.split.finditer(text, at):
            where = m.start()
            if where > start + len(new):
                i = bisect_left(old, where - shift)
                if i < len(old) and old[i] == where - shift:
                    keep = [s + shift for s in old[i:]]
                    break
            fresh.append(where)
        self._starts = old[:first] + fresh + keep
        self.text = text
        return len(fresh)


def ids_column(text: Column, path: str) -> Column:
    """The ids of a text column, as an Arrow-batched function."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield batch.map(lambda t: own.encode(t) if isinstance(t, str) else [])

    return encode(text)


def count_column(text: Column, path: str) -> Column:
    """The number of ids of a text column; the ids stay in the worker."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield batch.map(lambda t: len(own.encode(t)) if isinstance(t, str) else 0).astype("int32")

    return count(text)


def encode_corpus(documents: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``documents`` with the ids of ``text_col`` in ``out_col``; no shuffle."""
    return documents.withColumn(out_col, ids_column(F.col(text_col), path))
