"""Language of short texts from marker words and letters, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import fold

#: Frequent function words, folded; a word of two of these languages is in neither list unless it is far likelier in one.
WORDS = {
    "vi": "cua khong duoc thuoc nguoi voi cho mot cac trong khi nen dung uong lieu ngay gio theo tai phai moi toi ban bao nhieu hoac den nay vi giam truoc sau neu benh va co bi thi nhu la chua nhung minh ho muc lan rat ra thay so hon qua dang cung ai nao sao gi".split(),
    "en": "the of and is to in for with be it at or not this take dose day days if when after before does what how can are you my under by must there that than from each every may should which your was has have no".split(),
    "fr": "le les des est et en pour du une un au aux par dans avec ne pas chez il ou que qui votre prenez afin avant je quels quelle sont ce se jours peut dose toute plus vous cela sur combien comment apres faut doit".split(),
}
#: Letters that hardly occur outside the language, with what one of them counts.
LETTERS = {"vi": "[ăđơưĩũạ-ỹ]", "fr": "[çœëïûÿ]|\\b[ldjnmtsc]['’]|[éèêà](?=[a-z]{2})"}

#: Languages that texts aren't expected in but answers may be: frequent words, folded, that none of those above have.
OTHER_WORDS = {
    "es": "el los las del una por para como pero puede debe esta este usted dias tomar tome tambien muy cuando antes despues sus segun sobre hasta".split(),
    "de": "der das und ist nicht sie eine einen auf fur von zu dem wird werden oder bei nach konnen sollte tag mal tabletten auch sich wenn".split(),
    "pt": "os uma pela pelo deve tambem voce seu sua antes depois mais ate dos das pode tomar muito quando sobre".split(),
    "it": "gli della delle dei una puo deve sono prima dopo anche piu giorni compressa ogni quando per non nel alla questo".split(),
}
#: Scripts whose letters aren't Latin. Fixed values.
SCRIPTS = {"cyrl": r"\p{IsCyrillic}", "han": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "hang": r"\p{IsHangul}", "arab": r"\p{IsArabic}", "thai": r"\p{IsThai}", "grek": r"\p{IsGreek}", "hebr": r"\p{IsHebrew}", "deva": r"\p{IsDevanagari}"}

#: The blocks of all these scripts and of some others.
_BEYOND_LATIN = r"[\x{370}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFE}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]"


def script_of(text: Column) -> Column:
    """The script that at least half of a text's letters have: a name of ``SCRIPTS``, ``latn``, or null for a text without letters."""
    text = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    found = F.lit("latn")
    for name, pattern in SCRIPTS.items():
        found = F.when(2 * F.regexp_count(text, F.lit(pattern)) >= letters, F.lit(name)).otherwise(found)
    # most texts have no letter of the blocks in which all these scripts lie, which one search of a few ranges tells
    foreign = text.rlike(_BEYOND_LATIN)
    return F.when(foreign, found).when(text.rlike(r"\p{L}"), F.lit("latn"))


def language_scores(text: Column, folded: Column | None = None, others: bool = False) -> dict[str, Column]:
    """How strongly a text speaks for each language; all 0 for null, empty and wordless texts. ``folded`` saves folding again; ``others`` adds those of ``OTHER_WORDS``."""
    lower, words = F.coalesce(F.lower(text), F.lit("")), F.split(F.coalesce(fold(text) if folded is None else folded, F.lit("")), r"[^\p{L}]+")
    scores = {}
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    for name, listed in WORDS.items():
        scores[name] = count(listed) + F.regexp_count(lower, F.lit(LETTERS[name])) if name in LETTERS else count(listed)
    if others:
        # words of the usual languages are no others', so where they are a third of all no other language can have twice as many
        open_ = 3 * F.greatest(*scores.values()) <= F.size(words)
        scores |= {name: F.when(open_, count(listed)).otherwise(0) for name, listed in OTHER_WORDS.items()}
    return scores


_LANGUAGES = tuple(WORDS)
#: In which of the languages a word is listed.
_LISTED = {w: tuple(i for i, k in enumerate(_LANGUAGES) if w in WORDS[k]) for listed in WORDS.values() for w in listed}
_MARKS = {i: re.compile(LETTERS[k]) for i, k in enumerate(_LANGUAGES) if k in LETTERS}
_ACCENTS, _WORD = re.compile(r"[\u0300-\u036f]+"), re.compile(r"[^\W\d_]+")


def language_of(text: str) -> str:
    """``vi``, ``en`` or ``fr``, or ``?`` where none leads; the same lists as in ``language_scores``, for Python workers."""
    lower = text.lower()
    scores = [len(_MARKS[i].findall(lower)) if i in _MARKS else 0 for i in range(len(_LANGUAGES))]
    plain = lower if lower.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFD", lower.replace("đ", "d")))
    for found in map(_LISTED.get, _WORD.findall(plain)):
        if found:
            for i in found:
                scores[i] += 1
    first, second = sorted(scores, reverse=True)[:2]
    return _LANGUAGES[scores.index(first)] if first > second else "?"
