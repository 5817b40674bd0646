"""Abusive, hateful and sexual content by a chain of classifiers.

Texts are cut into passages (sentences, at most 240 characters with an overlap of 80, so the whole text is read).
Each passage is read in two views, with and without accents, after spelling tricks are undone: look-alike digits
and signs, letters set apart, repeated letters, hidden letters. Features are hashed character 4-grams of both views and 5-grams of
the one without accents, without spaces, and nothing else: no list of words takes part in a score.

The chain predicts abuse, hate, sexual content and then harm in general; each link is a logistic model that also
sees the probabilities of the links before it, which in training are predicted out of fold. It is trained
on the passages of reviewed documents (at most ``LABELLED`` of them, those with the lowest hash of their id) and on
a few built-in seeds, of which each is one example.

A verdict is about a document and not about a passage, and reviewers err. So passages are labelled in ``ROUNDS`` rounds: in each
document that was found harmful the passage that looks worst is the witness, and so is every other that looks as bad; a model
fitted on the witnesses against all passages of harmless documents then judges each passage out of fold. A witness that this
model doesn't believe, or a passage of a harmless document that it is sure of, is a reviewer's slip and takes no part. The first round
looks at the mean log-odds of a passage's n-grams over documents. Verdicts don't name a category, so witnesses get theirs from models of
the three categories that begin with the seeds and are fitted again on the witnesses they are surest of.

Defined results: null and blank texts score 0; without labels the seeds alone train the model; of
repeated ``doc_id`` the highest score counts, in training the smallest text; a score is that of the worst passage; extra columns are ignored.
"""

from __future__ import annotations

import re as plain_re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import ship

CATEGORIES = ("abuse", "hate", "sexual", "harmful")
#: Reviewed documents used for training at most, hash slots of features, folds, steps of a fit, rounds of labelling, and the score from which a document is reported.
LABELLED, BITS, FOLDS, STEPS, ROUNDS, BAR = 6000, 18, 2, 25, 2, 0.5
LONG, OVERLAP = 240, 80
#: Assumed share of harmful passages, and documents that a feature's rate is shrunk by.
PREVALENCE, SHRINK = 0.08, 4.0
#: Passages whose scores a worker keeps; when full it begins anew.
KEPT = 200_000

#: A few common words and phrases of each category: examples to begin with. Fixed values.
SEEDS = {
    "abuse": (
        "you idiot|you moron|bastard|asshole|bitch|scumbag|piece of shit|son of a bitch|fuck you|go to hell|i will kill you|shut your mouth|"
        "đồ ngu|đồ khốn|đồ chó|thằng ngu|con khốn|câm mồm|cút đi|đụ mẹ mày|tao giết mày|đánh chết mày|connard|salaud|ta gueule|fils de pute|va te faire foutre|je vais te tuer"
    ),
    "hate": (
        "vermin|subhuman|filthy savages|inferior race|exterminate them|they should all die|scum of society|go back to your country|"
        "lũ mọi rợ|bọn súc vật|giống hạ đẳng|cặn bã xã hội|diệt sạch chúng nó|loài ký sinh|cút về nước|sale race|sous-hommes|vermine|retourne dans ton pays|il faut les exterminer"
    ),
    "sexual": (
        "porn|send nudes|blowjob|you slut|pussy|so horny|sex tonight|suck my dick|phim sex|ảnh nóng|gái gọi|lên giường với anh|bú cu|nứng quá|địt nhau|gái dâm|plan cul|film porno|photos nues|baiser avec moi|grosse salope"
    ),
}
#: Examples of clinical, legal, neutral and merely angry passages. Fixed values.
HARMLESS = (
    "Ask the patient about sexual health in private.|This cream is for external use in the genital area.|The nurse was insulted by a visitor and filed a complaint.|Discrimination of any group is forbidden by law.|"
    "Terrible service, I want my money back.|The pills did nothing at all, I am furious.|The disinfectant kills germs.|Thuốc tránh thai không phòng được bệnh lây qua đường tình dục.|Nhân viên bị khách chửi nên đã báo quản lý.|"
    "Cấm phân biệt đối xử với người bệnh.|Dịch vụ quá kém, tôi rất bực mình.|Thuốc sát trùng diệt khuẩn nhanh.|Les rapports sexuels sont déconseillés pendant le traitement.|Service lamentable, je suis très déçu."
)

_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l", "ı": "i"})
_INVISIBLE = re.compile(r"[\p{Cf}\p{Mn}--[\u0300-\u0323\u0327\u031B]]", re.V1)
_MIXED = re.compile(r"(?<![\p{L}\d])(?=[^\s]*[\p{L}])[\p{L}\d@$!|€£ı*_.·-]*[\d@$!|€£ı][\p{L}\d@$!|€£ı*_.·-]*")
_APART = re.compile(r"(?<![\p{L}*])\p{L}(?:[\s.\-_*·,/]{1,2}[\p{L}*]){2,}(?![\p{L}*])")
_INNER = re.compile(r"(?<=\p{L})[*#_·.\-~^+=](?=\p{L})")
_RUNS = plain_re.compile(r"([^\W\d_])\1+")
_CODE = plain_re.compile(r"[\d.,/-]+(?:mg|g|ml|h|kg|mcg|cm|mm|km|l|k|th|st|nd|rd)?|[a-z]{1,3}-?\d{3,}[\d-]*")
_NOT_LETTER, _NOT_WORD = re.compile(r"[^\p{L}*]"), plain_re.compile(r"(?:[^\w*']|[\d_])+")
#: Cheap tests that a passage may hold one of the tricks; the patterns above then decide.
_MAY_MIX = plain_re.compile(r"[^\W\d_][*_.·-]*[\d@$!|€£ı]|[\d@$!|€£ı][*_.·-]*[^\W\d_]")
_MAY_PART = plain_re.compile(r"(?<![^\W\d_])[^\W\d_][\s.\-_*·,/]{1,2}[^\W\d_*]?[\s.\-_*·,/]{1,2}")
_MAY_HIDE = plain_re.compile(r"[*#_·.\-~^+=]")
_LETTER, _ACCENTS = plain_re.compile(r"[^\W\d_]"), plain_re.compile(r"[\u0300-\u036f]+")
#: Ends of sentences (letters set apart by full stops are none), lines, tabs and cells.
_CUT = re.compile(r"(?<=[.!?…])(?!(?<=(?<!\p{L})\p{L}\.)\s+\p{L}(?:[\s.]|$))\s+|\n+|\t+|\s+\|\s+")
#: Numbers of two and more digits, which are alike.
_NUMBER = plain_re.compile(r"(?<![^\s(])\d+(?:[.,/:-]?\d)+(?=[\s.,;:)%]|$)")


def passages(text: str | None) -> list[str]:
    """The passages of a text; together they cover all of it that has letters."""
    out = []
    for part in _CUT.split(text or ""):
        part = part.strip()
        if len(part) <= LONG:
            # numbers and signs alone say nothing
            if _LETTER.search(part):
                out.append(part)
            continue
        start = 0
        while True:
            end = min(len(part), start + LONG)
            if end < len(part):
                space = part.rfind(" ", start + LONG // 2, end)
                end = space if space > 0 else end
            out.append(part[start:end])
            if end == len(part):
                break
            start = end - OVERLAP
    return out


def _bare(passage: str) -> str:
    """A passage in lower case with look-alikes, letters set apart and hidden letters undone; other signs are as they were."""
    text = passage.lower() if passage.isascii() else unicodedata.normalize("NFC", _INVISIBLE.sub("", unicodedata.normalize("NFKC", passage))).lower()
    if _MAY_MIX.search(text):
        text = _MIXED.sub(lambda m: m[0] if _CODE.fullmatch(m[0]) else m[0].translate(_LOOKS), text)
    if _MAY_PART.search(text):
        text = _APART.sub(lambda m: _NOT_LETTER.sub("", m[0]), text)
    if _MAY_HIDE.search(text):
        text = _INNER.sub(lambda m: "*" if m[0] in "*#^~" else "", text)
    return text


def _plain(text: str) -> str:
    """A text without accents."""
    return text if text.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFD", text.replace("đ", "d")))


def undo(passage: str) -> tuple[str, str]:
    """A passage with its spelling tricks undone, as words: with accents and without; repeated letters are one, hidden letters ``*``."""
    text = _RUNS.sub(r"\1", _NOT_WORD.sub(" ", _bare(passage))).strip()
    return text, _plain(text)


@dataclass
class Features:
    """Hashed n-grams of passages, flat, with where each passage begins and the root of how many it has in all."""

    slots: np.ndarray
    starts: np.ndarray
    root: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.slots)))

    def kept(self, keep: np.ndarray) -> Features:
        """Only the slots that ``keep`` has; slot 0 stays, so every passage has one."""
        ok = keep[self.slots] | (self.slots == 0)
        before = np.concatenate([[0], np.cumsum(ok)])
        return Features(self.slots[ok], before[self.starts], self.root)


def features(texts: list[str]) -> Features:
    """Features of passages; every passage has at least slot 0. Worked out for 2,000 passages at a time."""
    parts = [_features(texts[i : i + 2000]) for i in range(0, len(texts), 2000)] or [_features([])]
    offsets = np.cumsum([0, *(len(p.slots) for p in parts[:-1])])
    return Features(np.concatenate([p.slots for p in parts]), np.concatenate([p.starts + o for p, o in zip(parts, offsets, strict=True)]), np.concatenate([p.root for p in parts]))


def _features(texts: list[str]) -> Features:
    # both views as one string, the one with accents only where it differs: a begin, the letters without spaces, an end
    flat = []
    for t in texts:
        a = _NOT_WORD.sub("", _bare(t))
        p = _plain(a)
        flat.append(("" if a == p else f"\x02{a}\x03") + f"\x04{p}\x05")
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    # what is repeated is one, also across words, since a letter set apart may be the same as the next one
    once = np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(once)])
    ends = np.cumsum([len(f) for f in flat])
    sizes = before[ends] - before[ends - [len(f) for f in flat]] if flat else np.zeros(0, dtype=np.int64)
    codes = codes[once]
    owner = np.repeat(np.arange(len(texts)), sizes)
    marks = np.cumsum(codes == 4)
    # 0 in the view with accents and 1 in the one without
    plain = (marks > owner).astype(np.uint64)
    kept_slots, kept_owner = [np.zeros(len(texts), dtype=np.int32)], [np.arange(len(texts))]
    for n in (4, 5):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + codes[k : len(codes) - n + 1 + k]
        same = (owner[n - 1 :] == owner[: len(h)]) & (plain[n - 1 :] == plain[: len(h)]) & (plain[: len(h)] >= n - 4)
        h = (h ^ (plain[: len(h)] << np.uint64(40)) ^ np.uint64(n << 50)) * np.uint64(0x9E3779B97F4A7C15)
        kept_slots.append((h[same] >> np.uint64(64 - BITS)).astype(np.int32))
        kept_owner.append(owner[: len(h)][same])
    slots, owners = np.concatenate(kept_slots), np.concatenate(kept_owner)
    order = np.argsort(owners, kind="stable")
    slots, owners = slots[order], owners[order]
    starts = np.searchsorted(owners, np.arange(len(texts)))
    return Features(slots, starts, np.sqrt(np.diff(np.append(starts, len(slots)))))


Link = tuple[np.ndarray, np.ndarray]


def _margin(x: Features, extra: np.ndarray, link: Link) -> np.ndarray:
    w, v = link
    return np.add.reduceat(w[x.slots], x.starts) / x.root + extra @ v[:-1] + v[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Features, extra: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Link:
    """A logistic model by full-batch adaptive steps with decay; weights of slots, and of the probabilities given and the bias."""
    w, v = np.zeros(1 << BITS, dtype=np.float32), np.zeros(extra.shape[1] + 1)
    v[-1] = -2.0
    if not (weight * (y > 0.5)).any():
        return w, np.append(v[:-1], -6.0)
    used = weight > 0
    x, extra, y, weight = _rows(x, used), extra[used], y[used], weight[used]
    # the slots that occur, numbered anew; slot 0, which all passages have, says nothing
    names = np.flatnonzero(np.bincount(x.slots, minlength=1 << BITS))
    new = np.zeros(1 << BITS, dtype=np.int32)
    new[names] = np.arange(len(names))
    slots = new[x.slots]
    says, sizes = (names > 0).astype(np.float64), x.sizes
    x = Features(slots, x.starts, x.root)
    u = np.zeros(len(names))
    mu, su, mv, sv = np.zeros_like(u), np.zeros_like(u), np.zeros_like(v), np.zeros_like(v)
    # examples hold far more harm than texts do: positives count for PREVALENCE of the whole
    share = np.where(y > 0.5, PREVALENCE / max(weight[y > 0.5].sum(), 1e-9), (1 - PREVALENCE) / max(weight[y <= 0.5].sum(), 1e-9))
    scale = weight * share
    for step in range(1, STEPS + 1):
        r = (_sigmoid(_margin(x, extra, (u, v))) - y) * scale
        gu = np.bincount(slots, np.repeat(r / x.root, sizes), len(names)) * says + 2e-6 * u
        gv = np.append(extra.T @ r, r.sum())
        for g, m, s, p, rate in ((gu, mu, su, u, 0.15), (gv, mv, sv, v, 0.2)):
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-7)
        # a passage of which nothing is known is harmful with the usual chance at most
        v[-1] = min(v[-1], np.log(PREVALENCE / (1 - PREVALENCE)))
    w[names] = u
    return w, v


def _rows(x: Features, keep: np.ndarray) -> Features:
    """Only the passages that ``keep`` has."""
    sizes = x.sizes
    ok = np.repeat(keep, sizes)
    return Features(x.slots[ok], np.concatenate([[0], np.cumsum(sizes[keep])[:-1]]).astype(np.int64), x.root[keep])


def _out_of_fold(x: Features, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The probability of each passage by a model that hasn't seen its fold."""
    out = np.zeros(len(y))
    for f in range(FOLDS):
        link = _fit(x, extra, y, weight * (fold != f))
        out[fold == f] = _sigmoid(_margin(x, extra, link))[fold == f]
    return out


def _chain_fit(x: Features, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> list[Link]:
    """The links in order; each gets the earlier links' probabilities, out of fold."""
    links, extra = [], np.zeros((len(y), 0))
    for k in range(len(CATEGORIES)):
        links.append(_fit(x, extra, y[:, k], weight))
        if k + 1 < len(CATEGORIES):
            extra = np.column_stack([extra, _out_of_fold(x, extra, y[:, k], weight, fold)])
    return links


def _chain(x: Features, links: list[Link]) -> np.ndarray:
    """Probabilities of the categories of each passage."""
    out = np.zeros((len(x.starts), 0))
    for link in links:
        out = np.column_stack([out, _sigmoid(_margin(x, out, link))])
    return out


@dataclass
class Reviewed:
    """Distinct passages of reviewed documents (``-1``: seeds), and in which documents (``of``) which of them (``at``) stand."""

    texts: list[str]
    at: np.ndarray
    of: np.ndarray
    verdict: np.ndarray


def reviewed(texts: list[str | None], verdicts: list[float]) -> Reviewed:
    """The passages of documents with their verdicts; passages that read the same after their tricks are undone are one."""
    known: dict[str, int] = {}
    own: list[str] = []
    pairs: set[tuple[int, int]] = set()
    for d, text in enumerate(texts):
        for p in passages(text):
            i = known.setdefault(undo(p)[0], len(own))
            if i == len(own):
                own.append(p)
            pairs.add((i, d))
    both = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return Reviewed(own, both[:, 0], both[:, 1], np.array(verdicts, dtype=np.float64))


def _rates(x: Features, r: Reviewed, own: np.ndarray) -> np.ndarray:
    """The mean over a passage's n-grams of their log-odds of standing in documents that were found harmful.

    ``own`` are the labels of the passages after the reviewed ones; each counts as a document.
    """
    n, sizes = len(r.texts), x.sizes
    verdict = np.concatenate([r.verdict, own])
    at, of = np.concatenate([r.at, n + np.arange(len(own))]), np.concatenate([r.of, len(r.verdict) + np.arange(len(own))])
    bad, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    # 250 documents at a time, so that what is spread out stays small
    for first in range(0, len(verdict), 250):
        inside = (of >= first) & (of < first + 250)
        reps = sizes[at[inside]]
        flat = np.repeat(x.starts[at[inside]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        both = np.unique(x.slots[flat].astype(np.int64) * 250 + np.repeat(of[inside] - first, reps))
        slot, told = both // 250, verdict[first + both % 250]
        bad += np.bincount(slot, told, 1 << BITS)
        good += np.bincount(slot, 1 - told, 1 << BITS)
    usual = min(max(verdict.mean(), 0.02), 0.98)
    odds = np.log((bad + SHRINK * usual) / (good + SHRINK * (1 - usual))) - np.log(usual / (1 - usual))
    return np.add.reduceat(odds[x.slots], x.starts) / sizes


def _witnesses(r: Reviewed, n: int, looks: np.ndarray) -> np.ndarray:
    """Whether a passage is the one that looks worst in a document that was found harmful."""
    found = np.zeros(n, dtype=bool)
    bad = r.verdict[r.of] > 0.5
    at, of = r.at[bad], r.of[bad]
    order = np.lexsort((looks[at], of))
    last = np.append(of[order][1:] != of[order][:-1], True) if len(order) else np.zeros(0, dtype=bool)
    found[at[order][last]] = True
    return found


def fit(r: Reviewed) -> list[Link]:
    """The chain, fitted on reviewed passages and the seeds."""
    seeds = [(s, k) for k, c in enumerate(CATEGORIES[:3]) for s in SEEDS[c].split("|")]
    plain = HARMLESS.split("|")
    n, m = len(r.texts), len(seeds)
    texts = [*r.texts, *(s for s, _ in seeds), *plain]
    x = features(texts)
    looks = _rates(x, r, np.repeat([1.0, 0.0], [m, len(plain)]))
    # n-grams of one passage alone teach nothing, but for those of the seeds
    keep = np.zeros(1 << BITS, dtype=np.int64)
    for first in range(0, len(texts), 2000):
        own = slice(x.starts[first], x.starts[first + 2000] if first + 2000 < len(texts) else None)
        keep += np.bincount(np.unique(np.repeat(np.arange(len(x.sizes[first : first + 2000])), x.sizes[first : first + 2000]) * (1 << BITS) + x.slots[own]) % (1 << BITS), minlength=1 << BITS)
    keep = keep >= 2
    keep[x.slots[x.starts[n] :]] = True
    x = x.kept(keep)
    fold = np.array([zlib.crc32(undo(t)[1].encode("utf-8", "replace")) % FOLDS for t in texts])
    none = np.zeros((len(texts), 0))
    seed = np.zeros((len(texts), 4))
    for i, (_, k) in enumerate(seeds):
        seed[n + i, [k, 3]] = 1
    bad, good = np.bincount(r.at, r.verdict[r.of] > 0.5, n), np.bincount(r.at, r.verdict[r.of] < 0.5, n)
    harmful, weight = seed[:, 3].copy(), np.ones(len(texts))
    for turn in range(ROUNDS + 1):
        witness = _witnesses(r, n, looks[:n]) & (bad > good)
        if turn == 0:
            worst = looks[:n][witness]
            harmful[:n] = (bad > good) & (looks[:n] > max(0.0, np.median(worst) / 2 if len(worst) else 0.0)) & (witness | (looks[:n] >= (np.median(worst) if len(worst) else 0)))
        else:
            harmful[:n] = (bad > good) & (looks[:n] > 0.5)
        # what stands in several harmless documents is harmless; of one or two the reviewer may have erred
        slip = (good <= 2) & (looks[:n] > 0.8) & (turn > 0)
        weight[:n] = np.where(harmful[:n] > 0, np.log2(1 + bad), np.where((good > 0) & ~slip, np.log2(1 + good), 0.0))
        if turn < ROUNDS:
            looks = _out_of_fold(x, none, harmful, weight, fold)
    label = np.column_stack([seed[:, :3], harmful])
    # categories of the witnesses, among harmful passages alone: from the seeds on, in each round those that the models are surest of
    among = np.flatnonzero((weight > 0) & (harmful > 0))
    own, kinds, is_seed = _rows(x, (weight > 0) & (harmful > 0)), label[among], seed[among, 3] > 0
    known = is_seed.copy()
    for _ in range(ROUNDS if len(among) > m else 0):
        by = np.column_stack([_sigmoid(_margin(own, none[among], _fit(own, none[among], kinds[:, k], known.astype(np.float64)))) for k in range(3)])
        kinds[~is_seed, :3] = np.eye(3)[by.argmax(1)][~is_seed]
        known = is_seed | (by.max(1) >= np.median(by.max(1)[~is_seed]))
    label[among] = kinds
    return _chain_fit(x, label, weight, fold)


def train(documents: DataFrame, labels: DataFrame) -> list[Link]:
    """Fits the chain on the reviewed documents of the sample and the seeds; train once and ``save`` to score many tables."""
    ship(documents.sparkSession)
    verdicts = labels.filter("harmful is not null and doc_id is not null").select("doc_id", "reviewer", "harmful").distinct().groupBy("doc_id").agg(F.avg("harmful").alias("verdict"))
    sample = verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # at most LABELLED rows come to the driver
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "verdict").agg(F.min("text").alias("text")).filter("text is not null").orderBy("doc_id").toPandas()
    return fit(reviewed(rows["text"].tolist(), rows["verdict"].tolist()))


def save(links: list[Link], path: str) -> None:
    """Write a fitted chain to a file."""
    with open(path, "wb") as out:
        np.savez_compressed(out, bits=BITS, **{f"{part}{k}": a for k, link in enumerate(links) for part, a in zip("wv", link, strict=True)})


def load(path: str) -> list[Link]:
    """A chain that ``save`` wrote."""
    with np.load(path) as kept:
        if int(kept["bits"]) != BITS:
            raise ValueError("the chain was fitted with other features")
        return [(kept[f"w{k}"], kept[f"v{k}"]) for k in range(len(CATEGORIES))]


class Scorer:
    """Scores texts and keeps the scores of passages, most of which are said more than once."""

    def __init__(self, links: list[Link]):
        self._links, self._known = links, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The worst scores of each text; numbers of two and more digits are alike."""
        out = np.zeros((len(texts), len(CATEGORIES)), dtype=np.float32)
        parts: dict[str, list[int]] = {}
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            for p in passages(_NUMBER.sub("00", text)):
                if (row := self._known.get(p)) is not None:
                    np.maximum(out[i], row, out=out[i])
                elif (held := parts.get(p)) is not None:
                    held.append(i)
                else:
                    parts[p] = [i]
                    size += len(p)
            if size > 400_000:
                self._settle(parts, out)
                parts, size = {}, 0
        self._settle(parts, out)
        return out

    def _settle(self, parts: dict[str, list[int]], out: np.ndarray) -> None:
        if not parts:
            return
        rows = _chain(features(list(parts)), self._links).astype(np.float32)
        np.maximum.at(out, np.concatenate(list(parts.values())), np.repeat(rows, [len(v) for v in parts.values()], axis=0))
        if len(self._known) + len(parts) > KEPT:
            self._known.clear()
        self._known.update(zip(parts, rows, strict=True))


def score(documents: DataFrame, links: list[Link]) -> DataFrame:
    """``doc_id, source, abuse, hate, sexual, score``: of each document's worst passages; ``score`` is that of harm in general."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(links)  # 4 MB, of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = scorer([t if isinstance(t, str) else None for t in batch["text"]]).astype(np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], **{c: out[:, k] for k, c in enumerate((*CATEGORIES[:3], "score"))}})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, abuse double, hate double, sexual double, score double")


def rates(scored: DataFrame, bar: float = BAR) -> DataFrame:
    """``source, n_documents, n_harmful, rate, n_abuse, n_hate, n_sexual`` of each source; a null source is a group."""
    over = lambda c: F.sum((F.col(c) >= bar).cast("bigint"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), over("score").alias("n_harmful"), (over("score") / F.count(F.lit(1))).alias("rate"), over("abuse").alias("n_abuse"), over("hate").alias("n_hate"), over("sexual").alias("n_sexual")
    )
