"""Text column functions shared by routing, chunking, indexing and retrieval. None is a UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of whitespace in the sense of ``str.strip`` and ``str.split``.
_SPACE = r"(?U)\s+"


def _fold_map() -> tuple[str, str]:
    """Letters of the Latin blocks with their base letter, built from Unicode decompositions."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base.isascii() and base.isalpha() and len(letter) == 1:
            found[letter] = base
    found |= {"đ": "d", "Đ": "D", "œ": "o", "æ": "a", "ø": "o", "ł": "l"}
    return "".join(found), "".join(found.values())


_FROM, _TO = _fold_map()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` refers to it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_space(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case without accents, for composed and decomposed Unicode alike. Null stays null."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), _FROM, _TO)


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks, digits of any kind and underscores."""
    return F.regexp_extract_all(F.lower(strip_space(text)), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences after whitespace is collapsed; a cut follows ``.``, ``!`` or ``?``."""
    flat = strip_space(F.regexp_replace(text, _SPACE, " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


TABLE_START, TABLE_END = "<!--TABLE_START-->", "<!--TABLE_END-->"


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines; a marked table block is one paragraph; a text without either is one."""
    # blank lines inside a table block are shielded, then blocks are set off by blank lines
    blocks = F.split(text, rf"(?s)(?={TABLE_START}.*?{TABLE_END})|(?<={TABLE_END})")
    parts = F.flatten(
        F.transform(blocks, lambda b: F.when(b.startswith(TABLE_START) & b.endswith(TABLE_END), F.array(b)).otherwise(F.split(b, r"\n\s*\n+")))
    )
    return F.filter(F.transform(parts, strip_space), lambda p: p != "")


def windows(units: Column, size: int, overlap: int, joint: str) -> Column:
    """Overlapping groups of ``size`` units, joined. The step is ``size - overlap``; a group that would hold only overlap is left out."""
    if size <= overlap:
        raise ValueError("a window must be larger than its overlap")

    def groups(u: Column) -> Column:
        n = F.size(u)
        # the first group always, a later one at s only if s + overlap < n
        last = F.greatest(F.lit(0), F.floor((n - overlap - 1) / (size - overlap))).cast("int") * (size - overlap)
        joined = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda s: F.array_join(F.slice(u, s + 1, F.lit(size)), joint))
        return F.when(n > 0, joined).otherwise(F.array().cast("array<string>"))

    return once(units, groups)


def plain_words(text: Column) -> Column:
    """Lower case, signs to spaces, spaces squeezed; null becomes empty."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return strip_space(F.regexp_replace(spaced, _SPACE, " "))


def collection_name(name: Column, default: str = "rag_chatbot") -> Column:
    """A store-safe name: letters, digits, ``_`` and ``-``, 3 to 63 characters, alphanumeric at both ends."""
    s = F.regexp_replace(F.regexp_replace(strip_space(name), r"[^a-zA-Z0-9_-]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(F.length(s) < 3, F.rpad(s, 3, "x")).otherwise(s)
    s = F.when(s.rlike("^[^a-zA-Z0-9]"), F.concat(F.lit("c"), s)).otherwise(s)
    s = F.when(s.rlike("[^a-zA-Z0-9]$"), F.concat(s, F.lit("1"))).otherwise(s)
    bare = F.regexp_replace(F.regexp_replace(strip_space(F.coalesce(name, F.lit(""))), r"[^a-zA-Z0-9_-]", "_"), "_", "")
    return F.when(bare == "", F.lit(default)).otherwise(F.left(s, F.lit(63)))


def name_case(name: Column) -> Column:
    """Words with a leading digit in lower case, words in capitals with one capital, the rest as it is."""
    def one(w):
        capitals = (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)
        return F.when(w.rlike("^[0-9]"), F.lower(w)).when(capitals, F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))).otherwise(w)

    return F.array_join(F.transform(words(name), one), " ")


def is_near_name(query: Column, name: Column) -> Column:
    """Whether a name is near a query: two query words (or the only one) and name words contain one another, or a long single word shares its first four letters."""

    def near(q: Column, n: Column) -> Column:
        matched = F.size(F.filter(q, lambda x: F.exists(n, lambda y: y.contains(x) | x.contains(y))))
        stem = (F.length(F.get(q, F.lit(0))) >= 5) & F.exists(n, lambda y: y.contains(F.left(F.get(q, F.lit(0)), F.lit(4))))
        return F.when((F.size(q) == 0) | (F.size(n) == 0), True).when(F.size(q) >= 2, matched >= 2).otherwise((matched > 0) | stem)

    return once(words(plain_words(query)), lambda q: once(words(plain_words(name)), lambda n: near(q, n)))


def parent_id(content: Column, position: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the content followed by its position."""
    return F.left(F.sha2(F.concat(content, position.cast("string")), 256), F.lit(16))


def shortened(text: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, with a mark if anything was left off."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def labelled_line(text: Column, label: str) -> Column:
    """What follows a label at the beginning of a line, any case; of several lines the last; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^{label}:(.*)$"), F.lit(1))
    return F.nullif(strip_space(F.try_element_at(found, F.lit(-1))), F.lit(""))


def without_citations(text: Column) -> Column:
    """Text without ``[Source n]`` marks, HTML-escaped, bold marks as tags, line ends as breaks."""
    bare = F.regexp_replace(text, r"(?i)\s*\[Source\s*\d+\]", "")
    safe = F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.regexp_replace(safe, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), F.lit("\n"), F.lit("<br/>"))


def file_kind(path: Column) -> Column:
    """``pdf``, ``docx`` or null by the suffix of a path, any case."""
    return F.when(path.rlike(r"(?i)\.pdf$"), "pdf").when(path.rlike(r"(?i)\.docx?$"), "docx")
