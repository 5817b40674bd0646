"""Finding texts that were cut by a field's limit or in transfer.

A backward character n-gram model compares, for the last characters of a value, how often the same
characters are an end (of a value, a line or a sentence) with how often the text goes on after them. Orders from 2 to 25
characters are interpolated from the shortest to the longest. In columns of short values the question is put in
two: whether a word ends here, by characters, and whether a value ends after this word, by characters and by a word-wise
view in which rare words are one class, so that a name or product seen nowhere else at an end
doesn't speak against a complete value. The log-odds are held against a threshold for each column and
language: the valley between the cut and the complete values. The threshold of a group is drawn towards that of its column, and
that of a column towards a fixed one, the more the fewer values there are (``SHRINK`` values count half), at every size alike.
The language is that of the whole value.

Debris of a cut (``…``, broken escapes and tags, replacement characters) is taken off before, and what remains decides.

How it runs: texts are made distinct; the hashed contexts of their ends are combined to a bit set of about 16 bits a context
(2 MB to 32 MB, the only thing sent to the workers); one pass over all distinct texts counts the contexts in that set, summed within each
task before the shuffle; counts and ends meet in a join on the hash. Beyond some 17 million contexts the set stays at 32 MB and lets more of
the n-grams through that no end has, which costs shuffle but changes no result. Contexts and texts that a large part of the
values share are answered from a broadcast of the 1,000 commonest and not shuffled to one task.

Defined results: null and blank values are not cut; a value that ends at the end of a sentence isn't cut,
whatever its length or marks; repeated values are scored once and reported for each record. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.language import language_of
from millrace.plans.session import lookup, materialize, ship

ORDERS = (2, 4, 6, 9, 13, 18, 25)
#: Places in the chain of interpolation: short characters, word-wise contexts, long characters, the whole end.
CHARS = {2: 0, 4: 1, 6: 2, 9: 3, 13: 7, 18: 8, 25: 9}
SKELETON = {2: 4, 3: 5, 4: 6}
WHOLE = 10
#: Characters of an end that are looked at, and those that make two ends the same.
SEEN, SAME = 160, 40
#: Least and most bits of the set of contexts, and bits for each context.
BITS_LEAST, BITS_MOST, BITS_EACH = 1 << 24, 1 << 28, 16
#: Weight of the shorter context when a longer one is read.
PULL = 1.0
#: A word is rare if fewer than this share of a column's distinct values have it; with it no more
#: than (words per value / share) words are frequent.
RARE = 0.01
#: Values whose valley counts as much as the threshold of the column, or the fixed one, does.
SHRINK = 200
#: For passages and for short values: the fixed threshold, and the range in which a valley is looked for.
DEFAULT, LOW, HIGH = -0.5, -1.0, 0.5
DEFAULT_SHORT, LOW_SHORT, HIGH_SHORT = -2.0, -3.0, -1.0

_DEBRIS = re.compile(
    r"(?:�+|(?:%[0-9A-Fa-f]{2})*%[0-9A-Fa-f]{0,2}|(?:%[0-9A-Fa-f]{2})+|&#?\w{0,6}|</?[a-zA-Z][^<>\s]*>|<[a-zA-Z/][^<>\s]*|\s*[\[(]?(?:\.\.\.+|…)[\])]?|\\u?[0-9a-fA-F]{0,4})$"
)
_MARKS = re.compile(r"(?:\s*\[[^\[\]\n]*\d\])+(?=[.!?]|\s|$)")
_RUN = re.compile(r"([.!?…])[.!?…\s]+$")
_WORD = re.compile(r"\d[\d.,/:\-]*\d|\d|\w+|\n|[^\w\s]")
_NUMBER = re.compile(r"\d.*")
_PAD, _END = 2, 3
_TERMINAL = np.array([ord(c) for c in ".!?…;"], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def settle(text: str) -> str:
    """A text as the model reads it: composed, without debris and repeated marks at its end, lower case."""
    text = unicodedata.normalize("NFC", text).rstrip()
    for _ in range(4):
        bare = _DEBRIS.sub("", text).rstrip()
        if bare == text:
            break
        text = bare
    if "[" in text:
        text = _MARKS.sub("", text)
    return _RUN.sub(r"\1", text).lower()


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each after 25 pads and before an end; digits are one class."""
    pad = chr(_PAD) * ORDERS[-1]
    joined = "".join(f"{pad}{t}{chr(_END)}" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes


def _mix(hashes: np.ndarray, place: int, salt: int) -> np.ndarray:
    h = (hashes ^ np.uint64((place + 1) * 0x2545F4914F6CDD1D & (2**64 - 1))) * np.uint64(salt * 2 + 0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(31))) * _BASE


def _char_hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the hash of the characters up to each position, grown from the order before."""
    total, power = np.zeros(len(codes), np.uint64), np.ones(1, np.uint64)
    for back in range(ORDERS[-1]):
        total[back:] += codes[: len(codes) - back] * power
        power = power * _BASE
        if back + 1 in CHARS:
            yield CHARS[back + 1], total


def _char_ends(codes: np.ndarray) -> np.ndarray:
    """Whether a value, line or sentence ends after each position, with or without its mark."""
    after, then = np.append(codes[1:], _END), np.append(codes[2:], [_END, _END])
    over = lambda x: (x == _END) | (x == 10)
    space = lambda x: over(x) | (x == 32) | (x == 9)
    mark = np.isin(codes, _TERMINAL)
    return over(after) | (mark & space(after)) | (np.append(mark[1:], False) & space(then)) | ((after == 32) & over(then))


def _word_ends(codes: np.ndarray) -> np.ndarray:
    """Whether no letter or digit follows a position."""
    kinds, inverse = np.unique(codes, return_inverse=True)
    letter = np.array([(c := chr(int(k))).isalnum() or unicodedata.combining(c) > 0 for k in kinds])[inverse]
    return ~np.append(letter[1:], False)


class Skeleton:
    """The word-wise view: frequent words and signs as they are, numbers and rare words as classes."""

    def __init__(self, frequent: set[str]):
        self._frequent, self._known = frequent, {}

    def ids(self, text: str) -> list[int]:
        found = []
        for word in _WORD.findall(text):
            if (i := self._known.get(word)) is None:
                kind = "0" if word[0].isdigit() else word if not word[0].isalpha() or word in self._frequent else "W"
                i = zlib.crc32(kind.encode()) + 16
                if len(self._known) < 100_000:
                    self._known[word] = i
            found.append(i)
        return found

    def codes(self, texts: list[str]) -> np.ndarray:
        flat: list[int] = []
        for t in texts:
            flat += [_PAD] * 4
            flat += self.ids(t)
            flat.append(_END)
        return np.array(flat, dtype=np.uint64)

    @staticmethod
    def hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        total, power = np.zeros(len(codes), np.uint64), np.ones(1, np.uint64)
        for back in range(4):
            total[back:] += codes[: len(codes) - back] * power
            power = power * _BASE
            if back + 1 in SKELETON:
                yield SKELETON[back + 1], total

    @staticmethod
    def ends(codes: np.ndarray) -> np.ndarray:
        stops = np.array([zlib.crc32(c.encode()) + 16 for c in ".!?…;\n"], dtype=np.uint64)
        after = np.append(codes[1:], _END)
        return np.isin(codes, stops) | np.isin(after, stops) | (after == _END)


def _salt(field: str) -> int:
    """Columns of one table share their counts."""
    return zlib.crc32(field.split(".")[0].encode() if field.startswith("sources.") else field.encode())


def _end_contexts(frequent: dict[str, set[str]]):
    """Maps the ends of distinct values to the hashes of their contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views = {f: Skeleton(w) for f, w in frequent.items()}
        for batch in batches:
            out = np.zeros((len(batch), WHOLE + 1), dtype=np.uint64)
            for field, rows in batch.groupby("field").indices.items():
                salt = _salt(field)
                texts = [settle(t[-SEEN:]) for t in batch["text"].iloc[rows]]
                codes = _codes(texts)
                last = np.flatnonzero(codes == _END) - 1
                for place, h in _char_hashes(codes):
                    out[rows, place] = _mix(h[last], place, salt)
                if field in views:
                    codes = views[field].codes(texts)
                    last = np.flatnonzero(codes == _END) - 1
                    for place, h in views[field].hashes(codes):
                        out[rows, place] = _mix(h[last], place, salt)
                out[rows, WHOLE] = [zlib.crc32(t[-SAME:].encode("utf-8", "replace")) + (zlib.adler32(t[-SAME:].encode("utf-8", "replace")) << 32) for t in texts]
                out[rows, WHOLE] = _mix(out[rows, WHOLE], WHOLE, salt)
            yield batch.drop(columns="text").assign(lang=[language_of(t) for t in batch["text"]], contexts=list(out.view(np.int64)))

    return run


def _count(frequent: dict[str, set[str]], shared):
    """Counts, over whole texts, the contexts that are in the bit set (a broadcast)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, bits = {f: Skeleton(w) for f, w in frequent.items()}, shared.value
        n_bits = np.uint64(len(bits) * 8)
        held: list[tuple[np.ndarray, ...]] = []

        def pack(parts):
            h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return h, *[np.bincount(inverse, np.concatenate([p[k] for p in parts])) for k in (1, 2, 3)]

        def wanted(h: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
            at = h % n_bits
            ok = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if ok.any():
                own, inverse = np.unique(h[ok], return_inverse=True)
                held.append((own, np.bincount(inverse, ends[ok]), np.bincount(inverse, stops[ok]), np.bincount(inverse).astype(float)))

        def count(field: str, texts: list[str]) -> None:
            salt, codes = _salt(field), _codes(texts)
            text = (codes != _PAD) & (codes != _END)
            ends, stops = _char_ends(codes)[text].astype(float), _word_ends(codes)[text].astype(float)
            for place, h in _char_hashes(codes):
                wanted(_mix(h[text], place, salt), ends, stops)
            if field in views:
                codes = views[field].codes(texts)
                text = (codes != _PAD) & (codes != _END)
                ends = views[field].ends(codes)[text].astype(float)
                for place, h in views[field].hashes(codes):
                    wanted(_mix(h[text], place, salt), ends, np.ones(len(ends)))
            whole = [zlib.crc32(t[-SAME:].encode("utf-8", "replace")) + (zlib.adler32(t[-SAME:].encode("utf-8", "replace")) << 32) for t in texts]
            wanted(_mix(np.array(whole, dtype=np.uint64), WHOLE, salt), *np.ones((2, len(texts))))

        for batch in batches:
            for field, rows in batch.groupby("field").indices.items():
                texts, size = [], 0
                for t in batch["text"].iloc[rows]:
                    texts.append(settle(t))
                    size += len(texts[-1])
                    if size > 500_000:
                        count(field, texts)
                        texts, size = [], 0
                if texts:
                    count(field, texts)
            if sum(len(p[0]) for p in held) > 3_000_000:
                held[:] = [pack(held)]
        if held:
            h, e, b, t = pack(held)
            for i in range(0, len(h), 200_000):
                yield pd.DataFrame({"h": h[i : i + 200_000].view(np.int64), "e": e[i : i + 200_000].astype("int64"), "b": b[i : i + 200_000].astype("int64"), "t": t[i : i + 200_000].astype("int64")})

    return run


def _frequent(distinct: DataFrame, fields: list[str]) -> dict[str, set[str]]:
    """The words that at least ``RARE`` of a column's values have; at most words per value / ``RARE`` of them."""
    if not fields:
        return {}
    some = distinct.filter(F.col("field").isin(*fields))
    size = {r["field"]: r["n"] for r in some.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = some.select("field", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w+\b"), F.lit(0)))).alias("word"))
    found: dict[str, set[str]] = {f: set() for f in fields}
    at_least = F.lit(3)
    for field, n in size.items():
        at_least = F.when(F.col("field") == field, F.greatest(F.lit(3.0), F.lit(RARE * n))).otherwise(at_least)
    for r in words.groupBy("field", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least).collect():
        found[r["field"]].add(unicodedata.normalize("NFC", r["word"]))
    return found


def _bits(contexts: DataFrame) -> np.ndarray:
    """The bit set of all contexts of ends: 64-bit words are combined in Spark, at most ``BITS_MOST / 64`` rows come here."""
    n = contexts.count() * (WHOLE + 1) * BITS_EACH
    size = min(BITS_MOST, max(BITS_LEAST, 1 << max(0, n - 1).bit_length()))
    bit = F.expr(f"pmod(h, {size})")  # a power of two divides 2**64, so this is the remainder of the unsigned value
    rows = (
        contexts.select(F.explode("contexts").alias("h"))
        .select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {size}) & 63 as int))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    words = np.zeros(size // 64, dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return words.view(np.uint8).copy()


def _log_odds(pairs: Column, word_wise: Column) -> Column:
    """The interpolated log-odds of end against continuation, without the value's own end.

    The own end, and those of values that end alike, are the count of the whole end.
    """
    alike = F.coalesce(F.get(F.filter(pairs, lambda p: p["place"] == WHOLE), F.lit(0))["e"], F.lit(0))
    chain = F.array_sort(F.filter(pairs, lambda p: p["place"] < WHOLE))

    def rate(top: str, of: str, start: float, places: tuple[int, ...] | None) -> Column:
        used = chain if places is None else F.filter(chain, lambda c: c["place"].isin(*places))

        def step(p, c):
            n, all_ = F.greatest(c[top] - alike, F.lit(0)), F.greatest(c[of] - alike, F.lit(0))
            return (F.least(n, all_) + F.lit(PULL) * p) / (all_ + F.lit(PULL))

        return F.aggregate(used, F.lit(start), step)

    of_word = rate("b", "t", 0.25, tuple(CHARS[n] for n in (2, 4, 6, 9, 13)))
    of_value = rate("e", "b", 0.05, (*(CHARS[n] for n in (2, 4, 6, 9)), *SKELETON.values(), CHARS[18], CHARS[25]))
    p = F.when(word_wise, of_word * of_value).otherwise(rate("e", "t", 0.05, None))
    return F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(F.lit(1.0) - p, F.lit(1e-9)))


def end_scores(values: DataFrame, word_wise: list[str]) -> DataFrame:
    """Scores every distinct value of ``values`` (``field, text``): ``field, th, th2, n, lang, log_odds, bar``.

    ``th`` and ``th2`` are the hashes of the text by which a record finds its score, ``n`` is how many records have it; ``bar`` is the threshold of
    the value's column and language. ``word_wise`` names the columns of short values.
    """
    spark = values.sparkSession
    ship(spark)
    spoken = values.filter(F.length(F.regexp_replace("text", r"[\s\p{Z}\p{C}]", "")) > 0)
    distinct = materialize(
        spoken.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")).select("field", "text", F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), "n"), "texts"
    )
    frequent = _frequent(distinct, word_wise)
    contexts = materialize(distinct.mapInPandas(_end_contexts(frequent), "field string, th bigint, th2 int, n bigint, lang string, contexts array<bigint>"), "ends")
    counts = (
        distinct.select("field", "text")
        .mapInPandas(_count(frequent, spark.sparkContext.broadcast(_bits(contexts))), "h bigint, e bigint, b bigint, t bigint")
        .groupBy("h")
        .agg(F.sum("e").alias("e"), F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("t").alias("weight"))
    )
    counts = materialize(counts, "counts")
    asked = contexts.select("field", "th", "th2", "n", "lang", F.posexplode("contexts").alias("place", "h"))
    short = F.col("field").isin(*word_wise) if word_wise else F.lit(False)
    asked = asked.filter(~F.col("place").isin(*SKELETON.values()) | short)
    # the last two characters of a value are those of many
    scored = (
        lookup(asked, counts, ["h"], "weight", ["th", "th2"])
        .groupBy("field", "th", "th2", "n", "lang")
        .agg(_log_odds(F.collect_list(F.struct("place", "e", "b", "t")), short).alias("log_odds"))
    )
    scored = materialize(scored, "scores")
    return scored.withColumn("bar", _bars(scored, word_wise))


def _valley(bins: dict[int, int], short: bool) -> float:
    """Where a histogram of half units is lowest within the range of its kind of column; of several places the one nearest the fixed threshold."""
    low, high, usual = (LOW_SHORT, HIGH_SHORT, DEFAULT_SHORT) if short else (LOW, HIGH, DEFAULT)
    depth = lambda b: bins.get(b - 1, 0) + bins.get(b, 0)
    return min(range(int(low * 2), int(high * 2) + 1), key=lambda b: (depth(b), abs(b / 2 - usual))) / 2


def _thresholds(found: dict[tuple[str, str], dict[int, int]], word_wise: list[str]) -> dict[tuple[str, str], float]:
    """The threshold of each column and language: its valley, drawn towards the column's, which is drawn towards the fixed one."""
    columns: dict[str, dict[int, int]] = {}
    for (field, _), bins in found.items():
        whole = columns.setdefault(field, {})
        for b, n in bins.items():
            whole[b] = whole.get(b, 0) + n
    draw = lambda own, n, to: (n * own + SHRINK * to) / (n + SHRINK)
    usual = {f: draw(_valley(bins, f in word_wise), sum(bins.values()), DEFAULT_SHORT if f in word_wise else DEFAULT) for f, bins in columns.items()}
    return {(f, lang): draw(_valley(bins, f in word_wise), sum(bins.values()), usual[f]) for (f, lang), bins in found.items()}


def _bars(scored: DataFrame, word_wise: list[str]) -> Column:
    """A threshold for each column and language from a histogram of half units (a few dozen rows a group)."""
    half = F.greatest(F.least(F.floor(F.col("log_odds") * 2), F.lit(20)), F.lit(-20)).cast("int")
    found: dict[tuple[str, str], dict[int, int]] = {}
    for r in scored.groupBy("field", "lang", half.alias("half")).agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault((r["field"], r["lang"]), {})[r["half"]] = r["n"]
    bar = F.lit(DEFAULT)
    for (field, lang), at in sorted(_thresholds(found, word_wise).items()):
        bar = F.when((F.col("field") == field) & (F.col("lang") == lang), F.lit(at)).otherwise(bar)
    return bar


def marked_values(values: DataFrame, word_wise: list[str]) -> DataFrame:
    """``values`` (with at least ``field, record_id, source_rank, text``) with ``was_cut``; other columns are kept."""
    scores = end_scores(values.select("field", "text"), word_wise)
    cut = scores.filter("log_odds < bar").select("field", "th", "th2", "n", F.lit(True).alias("was_cut"))
    keyed = values.withColumns({"th": F.xxhash64("text"), "th2": F.hash("text")})
    found = lookup(keyed, cut, ["field", "th", "th2"], "n", ["record_id", "source_rank"])
    return found.drop("th", "th2").withColumn("was_cut", F.coalesce("was_cut", F.lit(False)))


def cut_values(values: DataFrame, word_wise: list[str]) -> DataFrame:
    """``values`` restricted to those that were cut; other columns are kept."""
    return marked_values(values, word_wise).filter("was_cut").drop("was_cut")


def displayed_values(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """``field, record_id, source_rank, source, text`` of the columns that have a limit."""
    shown = messages.select(F.col("id").alias("record_id"), F.explode("sources").alias("s")).filter("s is not null")
    both = shown.select(
        "record_id",
        F.col("s.rank").alias("source_rank"),
        F.col("s.source").alias("source"),
        F.explode(F.array(F.struct(F.lit("sources.content").alias("field"), F.col("s.content").alias("text")), F.struct(F.lit("sources.summary").alias("field"), F.col("s.summary").alias("text")))).alias("v"),
    )
    asked = feedback.select(
        F.lit("feedback.question").alias("field"), F.col("feedback_id").cast("string").alias("record_id"), F.lit(0).alias("source_rank"), F.lit("feedback").alias("source"), F.col("question").alias("text")
    )
    return both.select("v.field", "record_id", "source_rank", "source", "v.text").unionByName(asked).filter("text is not null")


WORD_WISE = ["feedback.question"]


def rates(marked: DataFrame) -> DataFrame:
    """``source, field, n_values, n_cut, share_cut`` of ``marked_values``: how often each source's values are cut, a record's value counted once.

    Values without a source are a group of their own.
    """
    once = marked.groupBy("source", "field", "record_id", "source_rank").agg(F.max("was_cut").alias("was_cut"))
    return once.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("was_cut").alias("n_cut"), (F.count_if("was_cut") / F.count(F.lit(1))).alias("share_cut")
    )
