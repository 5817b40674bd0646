"""Splitting oversized items at natural boundaries.

Dynamic programming chooses the cut positions of an item: every boundary has a penalty (none
after a paragraph, more after a line, a sentence, a clause or a word, most inside a word),
pieces that differ from the even size cost the square of the difference, and no piece may be longer
than the limit. Each piece after the first begins exactly ``overlap`` characters before the
end of the piece before it, so dropping the overlap and joining gives the item back. The result is the cheapest over all
boundaries of all kinds.

Lengths are Unicode code points. Defined results: a null, empty or short item is not oversized and
yields no piece; a text without any boundary is cut between characters, never before a combining
mark if another place is in reach; repeated rows of an item give its pieces once; if one id is
stored with several oversized contents each has its own ``version``, from 1 in the order of the
contents' hashes; without an id every distinct content is an item of its own. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.plans.session import ship

LIMIT, OVERLAP = 2800, 200

#: Boundaries from the best to the worst: name, penalty, what ends just before the cut.
_KINDS = (
    ("paragraph", 0.0, re.compile(r"\n[ \t]*\n\s*")),
    ("line", 1.0, re.compile(r"\n")),
    ("sentence", 2.0, re.compile(r"[.!?…]+[\"'”’)\]]*\s+")),
    ("clause", 6.0, re.compile(r"[,;:|]\s+")),
    ("word", 12.0, re.compile(r"\s+")),
)
_INSIDE, _MARK = 60.0, 400.0
#: Cost of one more piece, and the weight of an uneven size.
_PIECE, _UNEVEN = 8.0, 10.0


#: How many kinds are tried first, and the least penalty of those left out: sentences and better, words and better, all characters.
_LEVELS = ((3, 6.0), (5, _INSIDE), (6, np.inf))


def _boundaries(text: str, kinds: int = 6) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Positions, penalties and kinds, ascending, of the ``kinds`` best kinds; the sixth is every place between two characters."""
    best: dict[int, tuple[float, str]] = {}
    if kinds > len(_KINDS):
        best = {p: (_MARK if unicodedata.combining(text[p]) else _INSIDE, "character") for p in range(1, len(text))}
    for name, cost, pattern in reversed(_KINDS[:kinds]):
        for m in pattern.finditer(text):
            best[m.end()] = (cost, name)
    best.pop(0, None)
    best.pop(len(text), None)
    at = sorted(best)
    return np.array(at, dtype=np.int64), np.array([best[p][0] for p in at]), [best[p][1] for p in at]


def _cheapest(text: str, kinds: int, limit: int, overlap: int) -> tuple[float, list[tuple[int, str]]]:
    """The least cost over the boundaries of some kinds, and the ends of the pieces with the kind of each cut; infinite if there is no way."""
    size, step = len(text), limit - overlap
    at, cost, names = _boundaries(text, kinds)
    inside = at > overlap
    at, cost, names = at[inside], cost[inside], [k for k, ok in zip(names, inside, strict=True) if ok]
    at, cost, names = np.append(at, size), np.append(cost, 0.0), [*names, "end"]
    even = (size - overlap) / -(-(size - overlap) // step)
    total, back = np.full(len(at), np.inf), np.full(len(at), -1, dtype=np.int64)
    low = np.searchsorted(at, at - step)
    for j in range(len(at)):
        if at[j] <= limit:
            total[j] = cost[j] + _PIECE + _UNEVEN * ((at[j] - overlap - even) / even) ** 2
        if (k := low[j]) < j:
            way = total[k:j] + _UNEVEN * ((at[j] - at[k:j] - even) / even) ** 2
            i = int(np.argmin(way))
            if (found := way[i] + cost[j] + _PIECE) < total[j]:
                total[j], back[j] = found, k + i
    ends, j = [], len(at) - 1
    while j >= 0 and total[-1] < np.inf:
        ends.append((int(at[j]), names[j]))
        j = int(back[j])
    return float(total[-1]), ends[::-1]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``(start, end, kind of the cut at the end)`` of each piece of ``text``: the cheapest way over all boundaries, characters included.

    The better kinds are tried alone first. A way that uses another kind costs at least that kind's penalty and the least number of
    pieces, so a way that is no dearer than this is the cheapest of all and the rest needn't be looked at.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size, "end")] if size else []
    fewest = -(-(size - overlap) // (limit - overlap))
    for kinds, next_penalty in _LEVELS:
        total, ends = _cheapest(text, kinds, limit, overlap)
        if total <= next_penalty + fewest * _PIECE:
            break
    return [(max(0, ends[n - 1][0] - overlap) if n else 0, end, kind) for n, (end, kind) in enumerate(ends)]


_SCHEMA = "field string, item_id string, version int, piece_no int, pieces int, start_at int, end_at int, cut_at string, text string"


def split_items(items: DataFrame, field: str, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the oversized texts of one column, in order."""
    ship(items.sparkSession)
    long = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter(F.length("text") > limit).withColumn("h", F.xxhash64("text"))
    # few rows but long ones to work on: a fixed number of partitions isn't merged at run time
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = long.filter("item_id is not null").repartition(parts, "item_id").dropDuplicates(["item_id", "h", "text"])
    once = named.withColumn("version", F.row_number().over(W.partitionBy("item_id").orderBy("h", "text"))).drop("h")
    # items without an id have nothing in common, so they are spread by their text
    unnamed = long.filter("item_id is null").repartition(parts, "h").dropDuplicates(["h", "text"])
    once = once.unionByName(unnamed.select("item_id", "text", F.lit(1).alias("version")))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text, version in zip(batch["item_id"], batch["text"], batch["version"], strict=True):
                parts = cut(text, limit, overlap)
                rows += [(field, item, version, n, len(parts), a, b, kind, text[a:b]) for n, (a, b, kind) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return once.mapInPandas(pieces, _SCHEMA)


def oversized(text: Column, limit: int = LIMIT) -> Column:
    """Whether a text has more than ``limit`` characters."""
    return F.coalesce(F.length(text) > limit, F.lit(False))
