"""Personal data in free text: bootstrapped contextual extraction and redaction.

Seeds that can be told by their form alone (a written-out mailbox, a mobile number, a surname with given names, a house
number with a street) and plain counterexamples (order codes, hotlines, product names) start it. Each
candidate is linked to the lexical patterns in which it stands (words before and after, its own beginning and
form). Spark scores the graph of patterns and candidates in rounds: a pattern's confidence is the mean of its
candidates' scores, a candidate's score is the chance given by its patterns' log-odds against the usual chance of its
kind (patterns overlap, so each counts in part). Candidates that no seed covers are found by confident patterns. From
accepted names a lexicon of name words is learned (words that at least two of them have; it stays a table), and a second
pass finds names that are not capitalised. ``held_out_recall`` tells how many instances the patterns find without their seeds.

How it runs: a candidate carries the hashes of its patterns and stays in its partition, so in a round only the sums of each pattern are
shuffled, combined within each task before, however many candidates have it. Patterns that meet their candidates are broadcast up to
``PATTERNS`` of them (a few dozen MB), beyond that they are joined with the commonest taken out of the shuffle. Patterns that fewer candidates
have than count at all are left out from the beginning.

Each found instance is replaced by ``[KIND]``; all else stays as it was, character by character. Values that are the same
are worked on once.

Defined results: null and empty values have no instances and stay null or empty; overlapping instances are
replaced once (longest first); decomposed texts are matched in composed form and replaced in their own; repeated
rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import lookup, materialize, ship

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Rounds of scoring, least number of scored candidates of a pattern that counts, and the score from which one is accepted.
ROUNDS, SUPPORT, ACCEPT = 3, 3, 0.6
#: What a candidate without a seed counts, against 1, when patterns are judged.
DERIVED = 0.3
#: A word is in the name lexicon if at least so many accepted names have it, however many names there are.
LEXICON_LEAST = 2
#: Patterns that are broadcast at most.
PATTERNS = 500_000

#: Common surnames, folded.
SURNAMES = set(
    "nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly dinh mai dao doan trinh truong lam ha cao phung quach chu luong tang thai to luu ta kieu vuong trieu la".split()
)
#: Words that introduce a person, folded; the end of what stands before a name.
_INTRO = re.compile(
    r"(?:\b(?:toi|minh|em|chau|con) ten(?: la)?|\bten (?:toi |minh |em )?la|\b(?:bac si|duoc si|bs|ds|ong|ba|co|chu|bac|anh|chi|em|cau|di)|\bbenh nhan|\bky ten ?:?|\bdung ten|\bmy name is|\bi am|\bthis is|\bje m'appelle|\bje suis|\bsigned|\b(?:dr|mr|mrs|ms|miss|mme|m|prof)\.?|"
    r"\bpatiente? ?:?|\b(?:regards|thanks|sincerely|cordialement|merci) ?,|\bfile is under|\baunt,|\buncle,|\bmother,|\bfather,)\s*$"
)
_NOT_NAME = set("kid plus forte f mg ml vx dh cccd cmnd bhyt ok alo zalo hotline".split())

#: Words after which an address has ended, folded.
_STOP = r"(?!(?:co|bi|nhe|roi|va|thi|la|de|cho|khi|xin|giup|bac|lieu|uong|lo|hoat|toi|minh|em|ban|nha|kho|quay|tram|which|what|how|can|is|please|last|next|got|et|est|a)\b)"
_TOWN = rf"(?:,\s*{_STOP}[^\W\d_][\w'-]*(?:[ -]{_STOP}[^\W\d_][\w'-]*)?)"
_PART = rf"(?:\s*,?\s*(?:p\.|phuong|q\.|quan|xa|huyen|thi tran|thi xa|tp\.?|thanh pho|tinh|thon|ap|khu pho|to dan pho|tang|lau|phong|can ho|toa|block)\s*\w+(?:\s+{_STOP}[^\W\d_]\w*)?)"
_EN_STREET = r"(?:road|street|lane|close|avenue|drive|court|square|place|terrace|crescent|way|row|rd|st|ave)"
_FR_STREET = r"(?:rue|impasse|avenue|boulevard|chemin|allee|place|quai|route|passage|cours|square)"
#: Addresses on folded lower-case text: those that are seeds, and a looser form that patterns have to support.
_ADDRESS = [
    (1, re.compile(rf"\b(?:so nha|nha so)\s*\d+[\w/]*{_PART}*{_TOWN}?")),
    (1, re.compile(rf"\bso\s*\d+[\w/]*\s+(?:duong|pho|ngo|hem)\s+\w+(?:\s+\w+)?{_PART}*")),
    (1, re.compile(rf"\b(?:ngo|hem|ngach|kiet)\s*\d+[\w/]*\s*,?\s*(?:pho|duong|ngo|hem)\s+\w+(?:\s+\w+)?{_PART}*{_TOWN}?")),
    (1, re.compile(rf"\b(?:chung cu|toa nha|khu tap the|can ho)\s+[^\W\d_]\w*(?:\s+[^\W\d_]\w*)?(?:\s*,?\s*(?:tang|lau|phong|can|can ho|block)\s*\w+)+{_PART}*{_TOWN}?")),
    (1, re.compile(rf"\b\d+(?:/\d+[a-z]?)+\s+[^\W\d_]\w*(?:\s+[^\W\d_]\w*){{0,2}}{_PART}+")),
    (1, re.compile(rf"\b\d+[a-z]?\s+(?:duong|pho)\s+[^\W\d_]\w*(?:\s+[^\W\d_]\w*)?{_PART}*")),
    (None, re.compile(rf"\b\d+[a-z]?\s+[^\W\d_]\w*(?:\s+[^\W\d_]\w*){{0,2}}\s*,\s*(?:quan|q\.|phuong|p\.|huyen|tp\.)\s*\w+{_PART}*")),
    (1, re.compile(rf"\b\d+[a-z]?,?\s+(?:[a-z][\w'-]*\s+){{1,3}}{_EN_STREET}\b(?:\s*,\s*(?:flat|apt|apartment|unit|suite|floor)\.?\s*\w+)?(?:,\s*[^\W\d_]\w+)?")),
    (1, re.compile(rf"\b\d+(?:\s*(?:bis|ter))?,?\s+{_FR_STREET}\s+(?:(?:de|du|des|la|le|les)\s+|[ld]')*[\w'-]+(?:\s*,\s*(?:batiment|bat\.?|appartement|appt\.?|etage)\s*\w+)?")),
]
_EMAIL = re.compile(
    r"[\w+-]+(?:\.[\w+-]+)*\s*(?:@|[\[(]\s*(?:at|a còng|a cong|arobase|@)\s*[\])])\s*[\w-]+(?:(?:\.|\s*[\[(]\s*(?:dot|chấm|cham|point)\s*[\])]\s*)[\w-]+)*(?:\.|\s*[\[(]\s*(?:dot|chấm|cham|point)\s*[\])]\s*)[a-z]{2,}(?![\w-])",
    re.I,
)
_DIGIT_WORDS = {
    w: d
    for d, listed in enumerate(
        ("không khong zero oh zéro", "một mot mốt one un", "hai two deux", "ba three trois", "bốn bon tư four quatre", "năm nam lăm five cinq", "sáu sau six", "bảy bay bẩy seven sept", "tám tam eight huit", "chín chin nine neuf")
    )
    for w in listed.split()
}
_WORD_NUMBER = re.compile(r"\b(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r")(?:[\s,-]+(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r")){7,14}\b", re.I)
_NUMBER = re.compile(r"(?<![\w/@.-])(?:[A-Z]{2} ?(?=\d(?: ?\d){12}(?!\d))|[A-Z](?=\d{7,8}(?!\d)))?(?:\(?\+?|\+)[\dO](?:(?:\) ?| ?\(|[ .-])?[\dO]){5,17}(?![\w/@]|[.,]\d)")
_CAPITAL = re.compile(r"(?:\p{Lu}\.|\p{Lu}[\p{L}'’-]*)(?:[ \t]+(?:\p{Lu}\.|\p{Lu}[\p{L}'’-]*)){0,4}")
_SYLLABLE = re.compile(r"(?:ngh?|nh|ch|gh?|kh|ph|qu|th|tr|gi|[bcdhklmnprstvx])?[aeiouy]{1,3}(?:ng|nh|ch|[cmnpt])?")
#: What stands before the number of a thing, and before that of a person's papers, folded.
_GOODS = re.compile(r"\b(?:van don|ma vach|ma don|don hang|ma hang|so dang ky|van ban|kien hang|goi hang|buu kien|tracking|barcode|bar code|parcel|order|shipment|invoice|colis|commande|facture|code-barres|code|serial|batch|lot|lo)\b[^.;,]{0,12}$")
_PAPERS = re.compile(r"\b(?:cccd|cmnd|can cuoc|chung minh|ho chieu|bhyt|bao hiem|giay to|dinh danh|passport|passeport|identity|id no|id card|insurance|identite|carte vitale|securite sociale|health card)\b\.?[^.;,]{0,24}$")
_WORD = re.compile(r"[\p{L}']+")
_TOKEN = re.compile(r"<[A-Z_]+>|[\p{L}\p{M}']+|\d+|[^\w\s]")


def _fold_same(text: str) -> str:
    """Folded text of the same length as the composed ``text``."""
    out = []
    for c in text:
        base = unicodedata.normalize("NFD", c)[0].lower()
        out.append("d" if base == "đ" else base if len(base) == 1 else c)
    return "".join(out)


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The composed text, and where each of its characters begins in ``text`` if they differ."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        part = unicodedata.normalize("NFC", text[i:j])
        out.append(part)
        at += [i] * len(part)
        i = j
    return "".join(out), [*at, len(text)]


def _digits(surface: str) -> str:
    return re.sub(r"\D", "", surface.replace("O", "0"))


def _number(surface: str) -> tuple[list[tuple[str, int | None]], str]:
    """Kinds that a number may be, each a seed, a counterexample or open, and its form."""
    # a letter O in front of a mobile number is a zero
    letters = "" if re.match(r"O\d{3}", surface) else re.match(r"[A-Z]*", surface)[0]
    digits, plus = _digits(surface[len(letters) :]), "+" in surface
    n = len(digits)
    form = f"{letters or ''}{n}{'+' if plus else ''}"
    if letters:
        # a passport is a letter and seven digits; a health card two letters, a digit, two digits and ten more
        if re.fullmatch(r"[A-Z]\d{7,8}", letters + digits) or re.fullmatch(r"[A-Z]{2}\d{13}", letters + digits):
            return [("ID_NUMBER", 1)], form
        return ([("ID_NUMBER", None)] if 7 <= n <= 15 else []), form
    if re.match(r"(?:1800|1900|0800|0900|800)", digits) and n <= 11 and not plus:
        return [("PHONE", 0)], form
    kinds: list[tuple[str, int | None]] = []
    if (plus and 10 <= n <= 13) or re.fullmatch(r"84[35789]\d{8}", digits) or re.fullmatch(r"0[35789]\d{8}", digits) or re.fullmatch(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", surface):
        kinds.append(("PHONE", 1))
    elif n in (10, 11):
        kinds.append(("PHONE", None))
    elif n == 9 or n in (12, 13):
        kinds.append(("ID_NUMBER", None))
    return kinds, form


def _spans(text: str) -> list[tuple[str, int, int, int | None, str]]:
    """Candidates with a form of their own: kind, start, end, seed, form."""
    found: list[tuple[str, int, int, int | None, str]] = []
    taken = [False] * len(text)

    def take(kind, a, b, seed, form):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            found.append((kind, a, b, seed, form))

    for m in _EMAIL.finditer(text):
        take("EMAIL", m.start(), m.end(), 1, "mail")
    folded = _fold_same(text)
    for seed, pattern in _ADDRESS:
        for m in pattern.finditer(folded):
            end = m.end()
            while end > m.start() and not folded[end - 1].isalnum():
                end -= 1
            take("ADDRESS", m.start(), end, seed, "strict" if seed else "loose")
    for m in _WORD_NUMBER.finditer(text):
        number = "".join(str(_DIGIT_WORDS[w]) for w in re.split(r"[\s,-]+", m[0].lower()))
        take("PHONE", m.start(), m.end(), 1 if re.fullmatch(r"0[35789]\d{8}|84[35789]\d{8}", number) else None, f"words{len(number)}")
    for m in _NUMBER.finditer(text):
        kinds, form = _number(m[0].strip())
        for kind, seed in kinds:
            if kind == "ID_NUMBER" and seed is None:
                left = folded[max(0, m.start() - 50) : m.start()]
                seed = 0 if _GOODS.search(left) else 1 if _PAPERS.search(left) else None
            take(kind, m.start(), m.start() + len(m[0].rstrip(" .-(")), seed, form + ":" + _digits(m[0])[:3] + "/" + re.sub(r"\d", "0", m[0].strip()))
    return found


def _around(text: str, spans: list[tuple], start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to three tokens before and after a place; other candidates are one token each."""

    def tokens(a: int, b: int) -> list[str]:
        out, at = [], a
        for kind, s, e, *_ in sorted((x for x in spans if a <= x[1] and x[2] <= b), key=lambda x: x[1]):
            out += _TOKEN.findall(_fold_same(text[at:s])) + [f"<{kind}>"]
            at = e
        return out + _TOKEN.findall(_fold_same(text[at:b]))

    clean = lambda ts: ["0" if t.isdigit() else t for t in ts]
    return clean((["<s>"] + tokens(max(0, start - 60), start))[-3:] if start < 60 else tokens(max(0, start - 60), start)[-3:]), clean((tokens(end, min(len(text), end + 60)) + ["</s>"])[:3])


def _features(kind: str, before: list[str], after: list[str], form: str, words: list[str]) -> list[str]:
    b1, b2, b3 = before[-1:], before[-2:], before[-3:]
    a1, a2 = after[:1], after[:2]
    # at the edge of a text the longer contexts say no more than the shorter
    made = [f"B{n} {' '.join(b)}" for n, b in ((1, b1), (2, b2), (3, b3)) if n == 1 or len(b) == n]
    made += [f"MASK {form.partition('/')[2]}"] if "/" in form else []
    made += [f"A1 {' '.join(a1)}", *([f"A2 {' '.join(a2)}"] if len(a2) == 2 else []), f"AB {' '.join(b1)}|{' '.join(a1)}", f"AB2 {' '.join(b2)}|{' '.join(a2)}", f"FORM {form.partition('/')[0]}"]
    if words:
        # a word that is a name among others may be a common word alone
        made += [f"WORD {words[0]}", f"WORD {words[-1]}", f"N {min(len(words), 4)}"] if len(words) > 1 else [f"ONLY {words[0]} {form == 'begin'}", "N 1"]
    return [f"{kind} {m}" for m in dict.fromkeys(made)]


def _capital_names(text: str, spans: list[tuple]) -> list[tuple]:
    """Capitalised runs outside other candidates, with their seeds."""
    out = []
    covered = sorted((s, e) for _, s, e, *_ in spans)
    for m in _CAPITAL.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, e in covered) or (a and text[a - 1] in "/-_.@&0123456789") or re.match(r"\p{Lu}['’]\p{Ll}", m[0]):
            continue
        words = [w.strip(".'’-") for w in m[0].split()]
        folded = [_fold_same(w) for w in words]
        begins = a == 0 or re.search(r"[.!?:\n]\s*$", text[:a]) is not None
        # a common word that only begins a sentence isn't part of a name
        while len(words) > 1 and begins and folded[0] not in SURNAMES and len(words[0]) > 1 and re.search(r"^(?:don|hoi|toi|nho|benh|ky|could|please|patient|my|dr|regards|thanks|asking|text|call|je|le|la|the|bac|uong|lo|em|cho)$", folded[0]):
            a += len(m[0].split()[0]) + (len(text[a:b]) - len(text[a:b].split(None, 1)[0]) - len(text[a:b].split(None, 1)[1]))
            words, folded, begins = words[1:], folded[1:], False
        while folded and folded[0] in {"dr", "mr", "mrs", "ms", "mme", "prof", "bs", "ds"} and len(words) > 1:
            a += len(text[a:b]) - len(text[a:b].split(None, 1)[1])
            words, folded = words[1:], folded[1:]
        if b < len(text) and text[b - 1] == "." and len(words[-1]) > 1:
            b -= 1
        left = _fold_same(text[max(0, a - 30) : a])
        seed = None
        if any(f in _NOT_NAME for f in folded) or re.match(r"\s*(?:\d+ ?mg\b|24\b|kid\b|plus\b|forte\b|f\b|mg\b)", text[b : b + 8], re.I):
            seed = 0
        elif _INTRO.search(left) or (folded[0] in SURNAMES and 2 <= len(words) <= 5 and all(_SYLLABLE.fullmatch(f) for f in folded)):
            seed = 1
        elif begins and len(words) <= 4 and any(b <= s <= b + 4 and k in ("PHONE", "ID_NUMBER", "ADDRESS", "EMAIL") and own != 0 and re.fullmatch(r"\s*[,;/–-]\s*", text[b:s]) for k, s, _, own, _ in spans):
            # the first of a list of somebody's data
            seed = 1
        elif begins and len(words) == 1 and re.match(r"\s*(?:$|[.!?,;:])", text[b:]) and not any(b <= s <= b + 4 for s, _ in covered):
            seed = 0
        elif re.search(r"\b(?:o|tai|tu|den|chi nhanh|nha thuoc|cong ty|hang|thuoc|dung|uong|lo|san pham|the)\s*$", left):
            seed = 0
        shape = "upper" if m[0].isupper() and len(m[0]) > 3 else "begin" if begins and len(words) == 1 else "initial" if any(len(w) == 1 for w in words) else "title"
        out.append(("NAME", a, b, seed, shape, folded))
    return out


_CANDIDATE = "vid bigint, n bigint, kind string, start_at int, end_at int, seed int, begins boolean, name_words array<string>, features array<string>"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CANDIDATE.split(", ")]).astype({"seed": "Int32"})


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for vid, n, raw in zip(batch["vid"], batch["n"], batch["text"], strict=True):
            text, _ = _composed(raw)
            spans = _spans(text)
            for kind, a, b, seed, form in spans:
                before, after = _around(text, [x for x in spans if (x[1], x[2]) != (a, b)], a, b)
                rows.append((vid, n, kind, a, b, seed, False, [], _features(kind, before, after, form, [])))
            for kind, a, b, seed, shape, _ in _capital_names(text, spans):
                before, after = _around(text, spans, a, b)
                words = re.findall(r"[\p{L}]+", text[a:b].lower())
                rows.append((vid, n, kind, a, b, seed, shape == "begin" and len(words) == 1, words, _features(kind, before, after, shape, words)))
        yield _frame(rows)


def _hashed(candidates: DataFrame) -> DataFrame:
    """Candidates with ``cid`` and, for ``features``, ``edges``: the hashes of their patterns and what each counts."""
    # what a candidate is made of says more than its place, of which several features say the same
    part = lambda f: F.when(f.rlike("^[A-Z_]+ (?:WORD|ONLY|FORM|MASK) "), 0.8).otherwise(0.4).cast("float")
    edges = F.transform("features", lambda f: F.struct(F.xxhash64(f).alias("f"), part(f).alias("part")))
    return candidates.withColumns({"cid": F.xxhash64("vid", "kind", "start_at", "end_at"), "edges": edges}).drop("features")


def _met(edges: DataFrame, patterns: DataFrame, n_patterns: int) -> DataFrame:
    """``edges`` (with ``f``) with the columns of ``patterns`` (``f, n, ...``, each pattern once), null where there is none."""
    if n_patterns <= PATTERNS:
        return edges.join(F.broadcast(patterns.drop("n")), "f", "left")
    return lookup(edges, patterns, ["f"], "n", ["cid"])


def _logit(p):
    kept = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return F.log(kept / (1 - kept))


def _scored(candidates: DataFrame, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of the candidates (of ``_hashed``), written out, and the patterns of the last round: ``f, n, kind, usual, confidence``.

    ``given`` are patterns learned before, used for the first round.
    """
    nodes = candidates.select("cid", "kind", "seed", "edges")
    spread = lambda rows, *more: rows.select("cid", "kind", "seed", *more, F.explode("edges").alias("e")).select("cid", "kind", "seed", *more, "e.f", "e.part")
    if given is None:
        # a pattern that fewer candidates have than count is of no use in any round
        some = materialize(spread(nodes).groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).withColumn("kept", F.lit(True)), "known")
    else:
        some = given.select("f", "n", F.lit(True).alias("kept"))
    own = ["cid", "kind"]
    # shuffled once, so that all rounds find a candidate's rows together; what is lost with an executor is worked out again from the tables before
    nodes = _met(spread(nodes), some, some.count()).groupBy(*own).agg(F.max("seed").alias("seed"), F.collect_list(F.when(F.col("kept"), F.struct("f", "part"))).alias("edges")).persist()
    scores = nodes.select("cid", "kind", "seed", F.col("seed").cast("double").alias("score"))
    patterns, n_patterns = given, given.count() if given is not None else 0
    for turn in range(ROUNDS):
        if turn or given is None:
            # a candidate without a seed counts in part; at most one row for each kind comes here
            trust = F.when(F.col("seed").isNotNull(), 1.0).otherwise(DERIVED)
            known = scores.filter("score is not null").withColumn("trust", trust)
            usual = {r["kind"]: (r["n"], r["score"] / r["n"]) for r in known.groupBy("kind").agg(F.sum("trust").alias("n"), F.sum(F.col("trust") * F.col("score")).alias("score")).collect()}
            base = F.lit(None).cast("double")
            for name, (n, chance) in usual.items():
                if n >= SUPPORT:
                    base = F.when(F.col("kind") == name, F.lit(chance)).otherwise(base)
            sums = spread(nodes.join(known.select(*own, "score", "trust"), own), "score", "trust").groupBy("f", "kind").agg(F.sum("trust").alias("n"), F.sum(F.col("trust") * F.col("score")).alias("score"))
            usable = sums.filter(F.col("n") >= SUPPORT).withColumn("usual", base).filter("usual is not null")
            patterns = materialize(usable.select("f", "n", "kind", "usual", ((F.col("score") + 2 * F.col("usual")) / (F.col("n") + 2)).alias("confidence")), "patterns")
            n_patterns = patterns.count()
        chances = {r["kind"]: r["usual"] for r in patterns.groupBy("kind").agg(F.max("usual").alias("usual")).collect()}
        base = F.lit(None).cast("double")
        for name, chance in chances.items():
            base = F.when(F.col("kind") == name, F.lit(chance)).otherwise(base)
        says = F.sum(F.col("part") * (_logit(F.col("confidence")) - _logit(F.col("usual"))))
        told = _met(spread(nodes), patterns.select("f", "n", "usual", "confidence"), n_patterns).groupBy(*own).agg(F.coalesce(says, F.lit(0.0)).alias("says"))
        whole = nodes.select(*own, "seed").join(told, own, "left")
        scores = whole.select("cid", "kind", "seed", F.coalesce(F.col("seed").cast("double"), 1 / (1 + F.exp(-F.coalesce("says", F.lit(0.0)) - _logit(base)))).alias("score"))
    scored = materialize(candidates.drop("edges").join(scores.select(*own, "score"), own, "left").drop("cid"), "scored")
    nodes.unpersist()
    return scored, patterns


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of each value, in lower case."""
    for batch in batches:
        rows = [(vid, w) for vid, raw in zip(batch["vid"], batch["text"], strict=True) for w in {m.lower() for m in _WORD.findall(_composed(raw)[0])}]
        yield pd.DataFrame(rows, columns=["vid", "w"])


def _lower_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finds names that aren't capitalised: runs of words of the lexicon, alone only after an introduction.

    ``words`` and ``firsts`` are those of the lexicon's words that the value has, ``spans`` its candidates with a form of their own.
    """
    for batch in batches:
        rows = []
        for vid, n, raw, known, leading, given in zip(batch["vid"], batch["n"], batch["text"], batch["words"], batch["firsts"], batch["spans"], strict=True):
            text, _ = _composed(raw)
            words, firsts = set(known), set(leading)
            tokens = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
            spans = [(x["kind"], x["start_at"], x["end_at"]) for x in given] if given is not None else []
            i = 0
            while i < len(tokens):
                a, _, word = tokens[i]
                j = i
                while j < len(tokens) and j - i < 5 and tokens[j][2].lower() in words and (j == i or text[tokens[j - 1][1] : tokens[j][0]].isspace()):
                    j += 1
                if j == i or any(s < tokens[j - 1][1] and a < e for _, s, e in spans):
                    i += 1
                    continue
                b = tokens[j - 1][1]
                intro = _INTRO.search(_fold_same(text[max(0, a - 30) : a])) is not None
                run_words = [t[2].lower() for t in tokens[i:j]]
                if text[a:b].islower() and (intro or (len(run_words) > 1 and word.lower() in firsts)):
                    before, after = _around(text, spans, a, b)
                    seed = 1 if intro and len(run_words) > 1 and word.lower() in firsts else None
                    rows.append((vid, n, "NAME", a, b, seed, False, run_words, _features("NAME", before, after, "lower", run_words)))
                i = j
        yield _frame(rows)


def _lexicon(names: DataFrame) -> DataFrame:
    """``w, n, is_first, is_word``: words of accepted names, how many have it, whether enough names begin with it, and whether it counts as part of one."""
    both = names.select(F.explode(F.expr("transform(name_words, (w, i) -> struct(w, i = 0 as first))")).alias("w")).groupBy("w.w", "w.first").agg(F.count(F.lit(1)).alias("n"))
    return both.filter(F.col("n") >= LEXICON_LEAST).groupBy("w").agg(F.sum("n").alias("n"), F.bool_or("first").alias("is_first"), (F.max(F.length("w")) > 1).alias("is_word"))


def _with_lexicon(values: DataFrame, lexicon: DataFrame, spans: DataFrame) -> DataFrame:
    """``vid, n, text, words, firsts, spans``: the values that have words of the lexicon, with these and their candidates of other kinds."""
    # only decomposed texts have to be composed first
    marks = F.col("text").rlike(r"\p{M}")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']+"), F.lit(0)))
    said = values.filter(~marks).select("vid", F.explode(words).alias("w")).unionByName(values.filter(marks).select("vid", "text").mapInPandas(_words, "vid bigint, w string"))
    known = lookup(said, lexicon, ["w"], "n", ["vid"]).filter("is_word or is_first").groupBy("vid").agg(
        F.collect_list(F.when(F.col("is_word"), F.col("w"))).alias("words"), F.collect_list(F.when(F.col("is_first"), F.col("w"))).alias("firsts")
    )
    other = spans.filter("kind != 'NAME'").groupBy("vid").agg(F.collect_list(F.struct("kind", "start_at", "end_at")).alias("spans"))
    return values.join(known, "vid").join(other, "vid", "left").select("vid", "n", "text", "words", "firsts", "spans")


def texts_of(feedback: DataFrame) -> DataFrame:
    """``feedback_id, field, text`` of the two columns of free text."""
    return feedback.select("feedback_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("question", "comment")])).alias("v")).select("feedback_id", "v.*")


def _values(texts: DataFrame) -> DataFrame:
    """``vid, n, text``: each text once, with how many records have it; ``vid`` is its 64-bit hash."""
    ship(texts.sparkSession)
    return materialize(texts.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("text").alias("vid"), "n", "text"), "values")


def instances(texts: DataFrame) -> DataFrame:
    """``vid, n, kind, start_at, end_at, score`` of the accepted instances in distinct texts; places are in the composed text.

    ``vid`` is the 64-bit hash of the text, ``n`` how many records have it.
    """
    values = _values(texts)
    candidates = materialize(_hashed(values.mapInPandas(_candidates, _CANDIDATE)), "candidates")
    scored, patterns = _scored(candidates)
    accepted = scored.filter(F.coalesce("score", F.lit(0.0)) >= ACCEPT)
    lexicon = _lexicon(accepted.filter("kind = 'NAME' and size(name_words) > 0 and (seed = 1 or size(name_words) > 1)"))
    lexicon = materialize(lexicon, "lexicon")
    # the capital of a word alone that begins a sentence says nothing ("Giá" is a price): such a word has to be known from names
    alone = (F.col("kind") == "NAME") & (F.size("name_words") == 1) & (F.coalesce("seed", F.lit(0)) != 1)
    single = accepted.filter(alone).withColumn("w", F.get("name_words", F.lit(0)))
    known = lookup(single, lexicon.filter("is_word").select("w", "n", "is_word").withColumnRenamed("n", "names"), ["w"], "names", ["vid", "start_at"]).filter(F.coalesce("is_word", F.lit(False)) | ~F.col("begins"))
    accepted = accepted.filter(~alone).unionByName(known.select(*accepted.columns))
    lower = materialize(_hashed(_with_lexicon(values, lexicon, candidates).mapInPandas(_lower_names, _CANDIDATE)), "lower")
    more, _ = _scored(lower, patterns)
    found = accepted.unionByName(more.filter(F.coalesce("score", F.lit(0.0)) >= ACCEPT))
    return found.select("vid", "n", "kind", "start_at", "end_at", "score").distinct()


def held_out_recall(texts: DataFrame, share: float = 0.5) -> DataFrame:
    """``kind, held_out, found``: of the positive seeds, ``share`` lose theirs, and how many of these the patterns of the others still accept."""
    candidates = materialize(_hashed(_values(texts).mapInPandas(_candidates, _CANDIDATE)), "candidates")
    held = (F.pmod(F.xxhash64("cid", F.lit("held out")), F.lit(1000)) < share * 1000) & (F.coalesce("seed", F.lit(0)) == 1)
    marked = candidates.withColumn("held", held).withColumn("seed", F.when(~held, F.col("seed")))
    scored, _ = _scored(marked)
    return scored.filter("held").groupBy("kind").agg(F.count(F.lit(1)).alias("held_out"), F.count_if(F.coalesce("score", F.lit(0.0)) >= ACCEPT).alias("found"))


def found_kinds(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``feedback_id, field, kind``: the kinds of which a value has at least one instance."""
    kinds = found.groupBy("vid").agg(F.max("n").alias("n"), F.collect_set("kind").alias("kinds"))
    # empty values, of which there may be many, would share a key
    some = texts.filter(F.length("text") > 0).select("feedback_id", "field", F.xxhash64("text").alias("vid"))
    return lookup(some, kinds, ["vid"], "n", ["feedback_id", "field"]).select("feedback_id", "field", F.explode("kinds").alias("kind")).distinct()


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind; spans count in the composed text, longer ones first."""
    if not text or not spans:
        return text
    _, at = _composed(text)
    used: list[tuple[int, int, str]] = []
    for kind, a, b in sorted(spans, key=lambda x: (-(x[2] - x[1]), x[1], x[0])):
        if all(b <= s or e <= a for s, e, _ in used):
            used.append((a, b, kind))
    for a, b, kind in sorted(used, reverse=True):
        a, b = (at[a], at[b]) if at else (a, b)
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``feedback_id, field, text, redacted``: every value with its instances replaced."""
    ship(texts.sparkSession)
    spans = found.groupBy("vid").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("kind", "start_at", "end_at"))).alias("spans"))
    some = F.coalesce(F.length("text") > 0, F.lit(False))
    rows = texts.select("feedback_id", "field", "text")
    joined = lookup(rows.filter(some).withColumn("vid", F.xxhash64("text")), spans, ["vid"], "n", ["feedback_id", "field"])

    @F.pandas_udf("string")
    def replace(values: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(s["kind"], s["start_at"], s["end_at"]) for s in p] if p is not None else []) for t, p in zip(values, places, strict=True)])

    replaced = joined.select("feedback_id", "field", "text", replace("text", "spans").alias("redacted"))
    return replaced.unionByName(rows.filter(~some).withColumn("redacted", F.col("text")))
