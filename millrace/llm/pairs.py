"""Defects of question-answer pairs by ordered rules.

``empty``, ``copy``, ``refusal``, ``truncated`` and ``other_language`` are tested in this order; every one
that holds is emitted by ``defects``, and ``first_defect`` keeps the first. All rules are column expressions over whole texts, but for
abrupt endings, which the end model of ``truncation`` decides from how all answers and questions end. The language differs if the
dominant Unicode scripts do, or if the answer has the marker words of another language than the question's.

Pairs that are the same are worked on once; records find the defects of their pair by its hash, those of the commonest pairs from a broadcast.

Defined results: a null or blank question can't be copied and has no language, so only the rules about the answer
alone apply; a null answer is empty; repeated rows give one row; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fold
from millrace.llm.language import language_scores, script_of
from millrace.llm.truncation import end_scores
from millrace.plans.session import lookup, materialize, ship

DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")

#: What stands for no value, and bare labels, folded and without punctuation. Fixed values.
PLACEHOLDERS = (
    "null", "none", "nil", "nan", "na", "n", "n a", "undefined", "empty", "blank", "missing", "void", "tbd", "tba", "todo", "string", "text", "output", "result", "trong", "rong", "vide", "neant",
    "answer", "the answer", "no answer", "ai answer", "reply", "response", "no content", "content", "assistant", "bot", "ai",
    "tra loi", "cau tra loi", "dap", "dap an", "noi dung", "khong co noi dung", "chua co noi dung", "reponse", "la reponse", "sans reponse",
)

#: Marks of sources, tags, entities.
_SOURCE = r"(?i)\[[^\[\]\n]*\d\s*\]|\(\s*(?:source|nguồn|nguon)\s*\d+\s*\)"
_MARKUP = r"</?[a-zA-Z!][^<>\n]*>|&#?\w{1,8};"

#: Wordings around a repeated question, folded.
_WRAP = (
    r"^(?:(?:ban|anh|chi|anh chi|quy khach|nguoi dung) (?:vua |dang |da |muon )*(?:hoi|muon biet|can biet)(?: ve| la| rang| toi)*|cau hoi(?: cua ban| cua anh chi| cua quy khach)*(?: la)*|noi dung cau hoi|"
    r"you (?:have |just |are )*(?:asked|asking|asks|ask|want to know|would like to know)(?: about| me)*|(?:the |your |user )*question(?: is| was| asked)*|the user asks|vous (?:avez |m avez |nous )*(?:demande|demandez|voulez savoir|souhaitez savoir)|"
    r"(?:votre |la )*question(?: est| posee)*|q|hoi|dap|answer|tra loi|cau tra loi|reponse|about|ve viec|ve cau hoi|regarding|concernant|a propos)\b"
)

#: Declining or not being able to tell, folded; ``.`` stands for punctuation that was kept.
_REFUSE = (
    r"khong the (?:tra loi|ket luan|tu van|cung cap|ho tro|giup|dua ra|xac dinh|dam nhan|thuc hien)",
    r"(?:xin|tu choi) (?:phep )?(?:khong|tu choi)? ?(?:tra loi|cung cap|tu van|dua ra)",
    r"khong (?:duoc phep|co quyen|du tham quyen|co kha nang|the nao) ?(?:tu van|tra loi|cung cap|dua ra|ho tro)?",
    r"vuot qua (?:kha nang|pham vi|tham quyen)|ngoai (?:kha nang|pham vi|tham quyen)",
    r"(?:chua|khong) (?:co|tim thay|tim duoc|nam duoc|thay)(?: duoc)? (?:du lieu|thong tin|noi dung|tai lieu|ket qua|cau tra loi)",
    r"\b(?:khong|chua) (?:co|du|co du) (?:ngu canh|can cu|co so|thong tin|du lieu|tai lieu|dieu kien)\b",
    r"\bno (?:[a-z]+ )?(?:context|information|data|answer|source|document|result|match|basis)s? (?:was |were |is |are |could be |has been |have been )?(?:found|available|given|provided|for|about)\b|\b(?:not enough|insufficient|too little) (?:context|information|data)\b",
    r"\b(?:won t|will not|wouldn t|would not) (?:be able to )?(?:provide|give|share|answer|discuss|comment|say|advise)\b|\bno basis\b",
    r"\bpas assez d |\b(?:contexte|informations?|donnees) (?:insuffisante?s?|manquante?s?)\b|\baucune? [a-z]+ (?:n a ete|n est|ne)\b",
    r"(?:nguon|tai lieu|tai lieu tham khao|nguon tham khao|ngu canh|he thong)[^.]{0,30} khong (?:de cap|noi|tim thay|co|nhac|cho biet|du)\b",
    r"\b(?:toi|minh|em) (?:khong ro|khong biet|chiu|khong chac|chua ro|chua biet)\b|^khong (?:ro|biet)\b",
    r"\b(?:can ?not|can ?t|could not|couldn t|unable to|not able to|am not allowed to|not permitted to) (?:[a-z]+ ){0,2}(?:answer|advise|help|assist|provide|tell|say|conclude|comment|comply|discuss|determine|respond|support|do that|be of)\b",
    r"\bnot (?:permitted|allowed|authori[sz]ed|able|qualified|in a position) to\b",
    r"\b(?:would|d) (?:rather|prefer) not\b|\bprefer not to\b|\bdecline to\b|\bmust decline\b|\brefuse to\b|\bhave to decline\b|\bwon t (?:answer|be able)\b|\bwill not (?:answer|provide)\b",
    r"\b(?:beyond|outside)(?: of)? (?:me\b|my|what i|the scope|our|my scope)",
    r"\b(?:have|has|found|find|there is|contains?) (?:no|nothing|not enough|insufficient)\b ?(?:data|information|info|details|relevant|answer|about|on|in)?",
    r"\b(?:do not|don t|does not|did not|didn t) (?:mention|have|know|contain|cover|say|find|state|provide)\b|\bnothing can be concluded\b|\bi am not sure\b|\bno idea\b|\bnot mentioned\b|\bnot covered\b",
    r"\b(?:ne|n) (?:peux|puis|pouvons|peut|sais|savons|suis|sommes|dispose|disposons|ai|avons|est|figure|mentionnent?|trouve)[^.]{0,40}\b(?:pas|aucune?|rien|point)\b|\bje ne (?:sais|peux)\b|\bn (?:ai|avons|a|y a) (?:aucune?|pas|rien)\b",
    r"\b(?:ne|n) (?:mentionnent?|contient|contiennent|trouve|a|ont|permet|permettent|est|sont|donne|donnent|parlent?|evoquent?)\b[^.]{0,30}\b(?:pas|rien|aucune?)\b|\brien (?:trouve|de pertinent|ne peut|ne permet)\b|\baucune? (?:donnee|information|element|reponse|resultat)\b",
    r"\b(?:depasse|hors de|en dehors de|au dela de)[^.]{0,30}\b(?:domaine|cadre|ressort|capacites?|competences?|portee|perimetre|moi|champ|possibilites)\b|\bme depasse\b|\bje (?:prefere|prefererais) ne pas\b|\bje (?:refuse|decline)\b|\b(?:pas|non) (?:autorisee?|habilitee?)\b",
)
_REFUSAL = "|".join(f"(?:{p})" for p in _REFUSE)
#: What may stand beside a refusal without being an answer: regrets, closings and pointers elsewhere.
_POLITE = (
    r"(?:(?:day|do) la (?:mot )?(?:van de|cau hoi|chu de|dieu) [a-z ]*+|this is (?:a|an) [a-z ]*?(?:matter|question|topic|issue)[a-z ]*+|(?:good|great) question|c est une? [a-z ]*?(?:question|sujet|point)[a-z ]*+|bonne question|"
    r"(?:thanh that |rat |that |chan thanh )*(?:xin loi|tiec|rat tiec)(?: ban| anh chi| quy khach)*|ve (?:cau hoi|van de|dieu) nay|vi ly do an toan|(?:mong|xin) (?:ban|anh chi|quy khach)? ?(?:thong cam|luong thu)|vui long [a-z ]*+|"
    r"(?:ban|anh chi)? ?(?:nen|hay|co the|vui long) (?:hoi|gap|lien he|tham khao|thu)[a-z ]*+|(?:ban )?hoi (?:bac si|duoc si)[a-z ]*+|(?:nen )?xin phep dung[a-z ]*+|cam on[a-z0-9 ]*+|xin cam on|hen gap lai|"
    r"(?:i am |i m |we are |very |so )*(?:sorry|afraid)[a-z ]*+|unfortunately|i apologi[sz]e|apologies|my apologies|on this point|please [a-z ]*+|(?:you should |better )*(?:ask|see|consult|contact|talk to|speak to|try)[a-z ]*+|(?:and )?have to stop here|for safety reasons?|thank you[a-z0-9 ]*+|thanks|"
    r"(?:je suis |nous sommes )*(?:vraiment )?desolee?s?|malheureusement|sur ce point|pardon|veuillez[a-z ]*+|merci[a-z0-9 ]*+|(?:demandez|voyez|consultez|contactez|adressez|essayez|reessayez|interrogez)[a-z ]*+|pour des raisons de securite|et je dois m arreter[a-z ]*+)"
)

#: Asking for an answer in a language, folded.
_ASKS = r"(?:tieng (?:anh|viet|phap)|\b(?:in|into|to) (?:english|vietnamese|french)\b|\ben (?:anglais|francais|vietnamien)\b|\b(?:english|vietnamese|french|anglais|francais|vietnamien) (?:please|answer|version|s il)|translate|\bdich (?:sang|giup|ra|cau)|traduire|traduis)"


def _bare(text: Column) -> Column:
    """A text without marks of sources and markup."""
    return F.regexp_replace(F.regexp_replace(text, _SOURCE, " "), _MARKUP, " ")


def _plain(folded: Column) -> Column:
    """Folded words separated by one space, sentences by `` . ``."""
    marked = F.regexp_replace(folded, r"(?:[!?…]+|\.(?=\D|$)|[\n;]+)", " . ")
    return F.trim(F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}.]+", " "), r"(?: \.)+(?= |$)", " ."))


def _word_list(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda w: (w != ".") & (w != ""))


def _grams(words: Column) -> Column:
    """Neighbouring words; a single word stands for itself."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n < 2, words).otherwise(F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(1))))


def _empty(folded: Column) -> Column:
    left = F.trim(F.regexp_replace(F.coalesce(folded, F.lit("")), r"[^\p{L}\p{N}]+", " "))
    # letters that show nothing (fillers) count as nothing
    left = F.trim(F.regexp_replace(left, r"[ᅟᅠㅤﾠ⠀]+", " "))
    return (left == "") | left.isin(*PLACEHOLDERS)


def _told(answer: Column) -> Column:
    """The words of a plain answer without the wording around a repeated question."""
    return _word_list(F.regexp_replace(F.trim(F.regexp_replace(answer, _WRAP, "")), _WRAP, ""))


def _last(question: Column) -> Column:
    """The words of a plain question's last sentence."""
    return _word_list(F.regexp_extract(question, r"(?:^|\. )([^.]+)[ .]*$", 1))


def _copy(asked: Column, told: Column, last: Column) -> Column:
    known, own = _grams(asked), F.array_distinct(_grams(told))
    new = F.array_except(own, known)
    # joints between repetitions make pairs that the question lacks
    again = F.floor(F.size(told) / F.greatest(F.size(asked), F.lit(1)))
    # a question may be repeated as a whole or from its last sentence
    covered = lambda words: F.size(F.array_except(_grams(words), own)) <= F.size(_grams(words)) * 0.2
    fresh = F.array_except(told, asked)
    return (F.size(asked) > 0) & (F.size(told) > 0) & (F.size(fresh) <= F.size(told) * 0.05) & (F.size(new) <= again + F.size(told) * 0.1) & (covered(asked) | (covered(last) & (F.size(last) >= 3)))


def _refusal(plain: Column) -> Column:
    parts = F.filter(F.split(plain, r" \.(?: |$)"), lambda p: F.length(p) > 0)
    polite = rf"^(?:{_POLITE}|\s)*$"
    # a refusal that goes on with something else does answer; the first sentence that says something ends the search
    answers = F.exists(parts, lambda p: ~p.rlike(polite) & ~p.rlike(_REFUSAL))
    return ~answers & F.exists(parts, lambda p: p.rlike(_REFUSAL)) & ~plain.rlike(r"\b(?:but|mais|nhung) (?:here|in general|usually|the rest|voici|en general|sau day|nhin chung|thong thuong|phan con lai)")


#: Opening and closing delimiters, and faces made of brackets.
_DELIMITERS = (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”"))
_FACES = r"[:;=8xX]['’]?-?[()\[\]{}]+|[()\[\]{}]+-?[:;=](?!\w)"


def _unclosed(answer: Column) -> Column:
    """A bracket, code fence or quotation that was opened and isn't closed to the end of the answer, and what a cut leaves."""
    plain = F.regexp_replace(answer, _FACES, " ")
    open_at_end = F.lit(False)
    for a, b in _DELIMITERS:
        # closing marks without an opening one ("1)") don't count against those that follow
        last = plain.rlike(rf"\{a}[^\{a}\{b}]*$")
        more = F.size(F.split(plain, rf"\{a}")) > F.size(F.split(plain, rf"\{b}"))
        open_at_end = open_at_end | (plain.contains(a) & (last | more))
    fences = F.regexp_count(answer, F.lit("```"))
    return open_at_end | answer.rlike(r"(?:�|%[0-9A-F]{2}%?|&#?\w{0,6}|<[a-zA-Z/][^<>]*)$") | (fences % 2 == 1)


def _other_language(asked: dict[str, Column], told: dict[str, Column], asked_script: Column, told_script: Column, folded_question: Column) -> Column:
    differs = F.coalesce(asked_script != told_script, F.lit(False))
    for name, own in told.items():
        rest = F.greatest(*[s for k, s in told.items() if k != name])
        asked_rest = F.greatest(*[s for k, s in asked.items() if k != name])
        # the answer is clearly in this language, the question clearly in another
        differs = differs | ((own >= 3) & (own >= 2 * rest) & (asked_rest >= 2) & (asked_rest >= 2 * asked[name]))
    return differs & ~F.coalesce(folded_question, F.lit("")).rlike(_ASKS)


def defects(feedback: DataFrame) -> DataFrame:
    """``feedback_id, defect, rank``: every defect of every pair; ``rank`` is the rule's place in the order."""
    ship(feedback.sparkSession)
    rows = feedback.select("feedback_id", "question", "answer").filter("feedback_id is not null")
    keys = {"p1": F.xxhash64("question", "answer"), "p2": F.hash(F.coalesce("answer", F.lit("")), F.coalesce("question", F.lit("")), F.col("answer").isNull())}
    pairs = materialize(rows.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n")).withColumns(keys), "pairs")
    tested = materialize(_tested(pairs), "tested").select("p1", "p2", "n", "found").filter(F.size("found") > 0)
    # what one pair has is two hashes and a few words
    met = lookup(rows.withColumns(keys).select("feedback_id", "p1", "p2"), tested, ["p1", "p2"], "n", ["feedback_id"])
    return met.select("feedback_id", F.explode("found").alias("d")).select("feedback_id", "d.defect", "d.rank").distinct()


def _tested(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``question, answer, p1, p2, n``, each once) with ``found``: their defects with the rules' places."""
    values = pairs.select(F.lit("feedback.answer").alias("field"), F.col("answer").alias("text")).unionByName(
        pairs.select(F.lit("feedback.question").alias("field"), F.col("question").alias("text"))
    )
    scores = end_scores(values.filter("text is not null"), ["feedback.answer", "feedback.question"])
    cut = scores.filter("field = 'feedback.answer' and log_odds < bar").select("th", "th2", "n", F.lit(True).alias("abrupt"))
    # null answers, of which there may be many, don't share a key, nor do the commonest answers
    keyed = lookup(pairs.withColumns({"th": F.when(F.col("answer").isNotNull(), F.xxhash64("answer")), "th2": F.when(F.col("answer").isNotNull(), F.hash("answer"))}), cut, ["th", "th2"], "n", ["p1", "p2"])
    q, a, no = F.col("question"), F.col("answer"), F.lit(False)
    of = ["p1", "p2", "n"]
    # worked out once: each step is read several times by the next, so the planner keeps them apart
    folded = keyed.select(*of, "question", "answer", "abrupt", fold(_bare(q)).alias("fq"), fold(_bare(a)).alias("fa"))
    plain = folded.select("*", _plain(F.col("fq")).alias("pq"), _plain(F.col("fa")).alias("pa"))
    asked, told = language_scores(q, F.col("fq"), True), language_scores(F.regexp_replace(a, _SOURCE, " "), F.col("fa"), True)
    listed = plain.select(
        "*", _word_list(F.col("pq")).alias("asked"), _told(F.col("pa")).alias("told"), _last(F.col("pq")).alias("last"), script_of(q).alias("q_script"), script_of(a).alias("a_script"),
        *[c.alias(f"q_{k}") for k, c in asked.items()], *[c.alias(f"a_{k}") for k, c in told.items()],
    )
    tested = listed.select(
        *of,
        F.coalesce(_empty(F.col("fa")), F.lit(True)).alias("empty"),
        F.coalesce(_copy(F.col("asked"), F.col("told"), F.col("last")), no).alias("copy"),
        F.coalesce(_refusal(F.col("pa")), no).alias("refusal"),
        # a word with a full stop after it ends, however short the answer
        ((F.coalesce(F.col("abrupt"), no) & ~a.rlike(r"\p{L}[.!?…]+[\"'”»)\]]*\s*$")) | F.coalesce(_unclosed(a), no)).alias("truncated"),
        F.coalesce(_other_language({k: F.col(f"q_{k}") for k in asked}, {k: F.col(f"a_{k}") for k in told}, F.col("q_script"), F.col("a_script"), F.col("fq")), no).alias("other_language"),
    )
    found = F.array(*[F.when(F.col(d) & ((F.lit(d) == "empty") | ~F.col("empty")), F.struct(F.lit(d).alias("defect"), F.lit(n).alias("rank"))) for n, d in enumerate(DEFECTS)])
    return tested.select(*of, F.filter(found, lambda x: x.isNotNull()).alias("found"))


def first_defect(found: DataFrame) -> DataFrame:
    """``feedback_id, defect``: the first defect of each pair."""
    return found.groupBy("feedback_id").agg(F.min_by("defect", "rank").alias("defect"))
