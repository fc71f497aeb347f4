"""Broken question and answer pairs.

A batch kernel gives each pair its defect, in this order of precedence: ``empty``, ``copied_question``, ``refusal``,
``other_language``, ``truncated``. It uses

* greedy string tiling of the answer with the question's words;
* a grammar of declining sentences, all sentences of a refusal being declining or polite ones;
* evidence of languages by script and frequent words, without names and quotations;
* a pushdown parser of fences, brackets, quotations, emphasis and list items, whose stack must be empty at the end.

What ends like a list item or heading, without a mark, is complete if its last words end items and sentences elsewhere
in the corpus. These counts are taken over all answers, by the pairs of words that have to be decided.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tongues import other_tongue
from weftgraph.llm.text import CITATION, fold, language_evidence, sentences, without_quotations
from weftgraph.session import cut

# fixed values
_PLACEHOLDERS = set("n/a,n.a,na,tbd,tba,tbc,todo,null,none,nil,nan,undefined,pending,blank,empty,placeholder,xxx,no answer,no answer given,no response,no reply,no output,not available,not applicable,to be determined,to be done,lorem ipsum".split(","))
_LABELS = set("q a question answer you asked your was is so well ok okay the pregunta respuesta frage antwort réponse resposta pergunta вопрос ответ 问题 答案 um hm hmm say".split())
_LABEL_ONLY = re.compile(r"(?:answer|response|reply|antwort|respuesta|réponse|resposta|ответ|答案)\s*[:：]?", re.I)
_TOKEN = re.compile(r"\w+")
_LETTERS = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
#: Log likelihood a word by which another language must beat the question's where only n-grams tell them apart.
TONGUE = 1.0


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only marks, citations, labels or a placeholder."""
    if answer is None:
        return True
    text = re.sub(r"</?\w+\s*/?>|&\w+;", " ", CITATION.sub(" ", fold(answer)))
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text).casefold()
    if not bare or " ".join(bare.split()) in _PLACEHOLDERS:
        return True
    return _LABEL_ONLY.fullmatch(bare) is not None


def tiles(answer: list[str], question: list[str], least: int) -> tuple[list[str], int]:
    """Greedy string tiling: the words of the answer left over, and the number of words of the question covered, by
    common runs of ``least`` words or more.

    The longest run whose words of the answer are still free is taken first; the question may be told again, so its
    words may be in more than one. Lengths of runs come from the run that starts one word later, and runs that lost
    words are cut and queued again, so the time is about n log n in the length of the answer.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(question):
        places.setdefault(w, []).append(j)
    free, seen = [True] * len(answer), [False] * len(question)
    queue, later = [], {}
    for i in range(len(answer) - 1, -1, -1):
        later = {j: later.get(j + 1, 0) + 1 for j in places.get(answer[i], ())}
        j, k = max(later.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if k >= least:
            queue.append((-k, i, j))
    heapq.heapify(queue)
    while queue:
        k, i, j = heapq.heappop(queue)
        own = 0
        while own < -k and free[i + own]:
            own += 1
        if own < -k:
            if own >= least:
                heapq.heappush(queue, (-own, i, j))
            continue
        free[i : i + own] = [False] * own
        seen[j : j + own] = [True] * own
    return [w for w, f in zip(answer, free) if f], seen.count(True)


def is_copy(question: str | None, answer: str) -> bool:
    """Only the question again, whatever stands around it of labels, marks and case."""
    if not question:
        return False
    q = _TOKEN.findall(fold(question).casefold())
    a = _TOKEN.findall(CITATION.sub(" ", fold(answer)).casefold())
    while a and a[0] in _LABELS and (not q or a[0] != q[0]):
        a.pop(0)
    while a and a[-1] in _LABELS and (not q or a[-1] != q[-1]):
        a.pop()
    known = _LABELS.union(q)
    if not q or not a or not all(w in known for w in a):
        return False
    rest, told = tiles(a, q, min(3, len(q)))
    return len(rest) <= 0.2 * len(a) and told >= 0.8 * len(q)


# fixed values: the grammar of declining. A capital word in angle brackets is another rule of the same language.
_GRAMMAR = {
    "en": {
        "declines": r"<INABILITY>.{0,60}?<SPEAK>|<INABILITY> (?:go there|do (?:that|this|so))\b|<DUTY> <REFUSE>|\b(?:i|we) (?:respectfully |politely )?(?:decline|refuse|abstain)\b|<NOTHING>|<OUTSIDE>|\bno comment\b|<OTHERS>|<RULES>|\bnot (?:possible|appropriate) for (?:me|us) to\b|<BLOCKED>|\bnot something (?:that )?(?:i|we)(?:'m| am|'re| are| can| may)\b",
        "INABILITY": r"\b(?:can ?not|can't|could not|couldn't|won't|will not|wouldn't|(?:am|'m|are|'re|is|isn't|be) ?(?:unable|not (?:able|allowed|permitted|willing|authori[sz]ed|comfortable|in a position|something|going))|(?:do not|don't|doesn't|does not) (?:feel (?:able|comfortable)|(?:let|allow|permit) (?:me|us))|may not|must not|(?:'d|would|'ll|will) rather not|prefer not)\b",
        "SPEAK": r"\b(?:help|assist|answer|respond|reply|comment|discuss|talk|speak|provide|say|tell|share|give|advise|complet|continu|fulfil|offer|disclos|process|support|engage|go into|speculat)\w*",
        "DUTY": r"\b(?:have|need|must|going|wish|want|prefer|choose)(?: to)?(?: respectfully| politely| regretfully)*",
        "REFUSE": r"(?:decline|refuse|pass|abstain)\b",
        "NOTHING": r"\bnothing (?:that )?(?:i|we) (?:may|can|could|am|are)\b",
        "OUTSIDE": r"\b(?:outside|beyond|against)\b.{0,20}\b(?:what (?:i|we) (?:may|can|am|are)|my (?:scope|guidelines|remit|role|rules|policy)|the scope)",
        "OTHERS": r"\bask (?:somebody|someone|anyone|another person)(?: else)?\b",
        "RULES": r"\b(?:guidelines|policy|policies|rules|instructions) (?:don't|do not|prevent|forbid|prohibit)",
        "BLOCKED": r"\b(?:request|question|topic) (?:is|was|has been) (?:declined|refused|blocked|not supported)",
        "polite": r"(?:(?:i'm|i am|we're|we are|so|very)? ?(?:sorry|apologi[sz]e|apologies|regrettably|unfortunately)\b.{0,20}|i hope (?:you|that|this).*|take care.*|thanks?\b.*|thank you.*|full stop|good luck.*|best wishes.*|"
        r"(?:please|you (?:should|may|could|can|might want to)|feel free to|do) (?:contact|see|consult|ask|talk to|speak|try|reach|rephrase|turn to|refer|check with|get in touch).*|is there anything else.*|(?:let me know|how else|what else|can i help).*)",
    },
    "es": {"declines": r"\bno (?:puedo|podemos|me es posible|estoy autorizad[oa]|estoy en condiciones)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|abstenerme)\b", "polite": r"lo siento.*|disculp.*|lamento.*"},
    "fr": {
        "declines": r"\bne (?:peux|pouvons|suis) pas\b.{0,60}<SPEAK>|\bdois (?:refuser|décliner|m'abstenir)\b|\bimpossible de (?:répondre|vous aider)",
        "SPEAK": r"\b(?:répondre|aider|dire|donner|fournir|commenter|mesure|autorisé)",
        "polite": r"désolée?.*|pardon.*",
    },
    "de": {
        "declines": r"\b(?:kann|können|darf|dürfen|möchte)\b.{0,80}\bnicht\b.{0,60}<SPEAK>|\bmuss (?:ich )?(?:leider )?(?:ablehnen|mich enthalten)\b",
        "SPEAK": r"\b(?:helfen|antworten|beantworten|sagen|geben|äußern|weiterhelfen|beantwortet)",
        "polite": r"leider.*|es tut mir leid.*|entschuldig.*",
    },
    "pt": {"declines": r"\bnão (?:posso|podemos|consigo|estou autorizad[oa])\b|\bdevo (?:recusar|abster)", "polite": r"desculp.*|lamento.*"},
    "it": {"declines": r"\bnon (?:posso|possiamo|sono (?:in grado|autorizzat[oa])|mi è possibile)\b.{0,60}\b(?:rispondere|aiutar\w*|dire|dare|fornire|commentare|discutere)|\bdevo (?:rifiutare|declinare|astenermi)\b", "polite": r"mi dispiace.*|scus[ai].*|purtroppo.{0,20}"},
    "nl": {"declines": r"\b(?:kan|kunnen|mag|mogen|wil)\b.{0,60}\b(?:niet|geen)\b.{0,60}\b(?:helpen|antwoord\w*|beantwoorden|zeggen|geven|bespreken)|\bmoet (?:ik )?(?:helaas )?(?:weigeren|bedanken)\b", "polite": r"het spijt me.*|sorry.{0,20}|helaas.{0,20}"},
    "zh": {"declines": r"(?:无法|不能|不便|没法|拒绝)(?:回答|提供|帮助|讨论|回应|协助|评论)", "polite": r"抱歉.*|对不起.*"},
    "ja": {"declines": r"(?:お答え|回答|お手伝い|お話し?|提供|コメント|お応え|説明)(?:することは?|は|が)?(?:でき(?:ません|ない|かねます)|いたしかねます|控え)", "polite": r"申し訳(?:ありません|ございません)?.*|すみません.*|ごめんなさい.*|残念ながら.{0,10}"},
    "ko": {"declines": r"(?:답변|대답|도움|제공|말씀|논의|답)\S{0,4} ?\S{0,4} ?(?:수 없|못|어렵|드릴 수 없|할 수 없)", "polite": r"죄송.*|미안.*|유감.*"},
    "ru": {"declines": r"не (?:могу|можем|вправе|буду)\b|вынужден\w* (?:отказать|воздержать)", "polite": r"извин.*|к сожалению.*|простите.*"},
    "ar": {"declines": r"(?:لا|لن) (?:أستطيع|استطيع|يمكنني|يمكننا|نستطيع|أقدر)|(?:لست|غير) (?:قادر|مخول)|أعتذر عن", "polite": r"(?:آسف|عذر|نأسف|للأسف|أعتذر).*"},
}


def _rule(rules: dict[str, str], name: str) -> str:
    """A rule with the rules it names put in."""
    return re.sub(r"<([A-Z]+)>", lambda m: "(?:" + _rule(rules, m.group(1)) + ")", fold(rules[name]))


_DECLINE = re.compile("|".join(_rule(r, "declines") for r in _GRAMMAR.values()))
_POLITE = re.compile("(?:" + "|".join(_rule(r, "polite") for r in _GRAMMAR.values()) + r")[.!。！\s]*")


_CONTRAST = re.compile(r"\b(?:but|however|although)\b,?|;")


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is polite, and one at least declines."""
    text = without_quotations(CITATION.sub(" ", fold(answer.casefold())))
    declined = False
    for s in sentences(text):
        s = s.strip(" \t*_-–—•#>")
        if not re.search(r"\w", s):
            continue
        if _DECLINE.search(s):
            declined = True
            # what follows a contrast must not state anything
            for clause in _CONTRAST.split(s)[1:]:
                if len(clause.split()) >= 4 and not _DECLINE.search(clause) and not _POLITE.fullmatch(clause.strip()):
                    return False
        elif not _POLITE.fullmatch(s):
            return False
    return declined


def in_other_language(question: str | None, answer: str) -> bool:
    """Nearly all words with a language are of another one than the question's."""
    if not question:
        return False
    asked = language_evidence(question)
    if not asked:
        return False
    own, weight = max(asked.items(), key=lambda x: (x[1], x[0]))
    if any(w >= weight for lang, w in asked.items() if lang != own):
        return False
    names = frozenset(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", fold(question).casefold())) if own != "en" else frozenset()
    found = language_evidence(answer, names)
    total = sum(found.values())
    other, most = max(found.items(), key=lambda x: (x[1], x[0]), default=("", 0.0))
    if other != own and most >= 1.5:
        return found[own] <= 0.15 * total and most >= 0.5 * total
    if found[own] > 0.15 * total:
        return False
    # too few words of the lists: the n-grams of all words decide, without names of the question and codes
    asked_words = set(_LETTERS.findall(fold(question).casefold()))
    bare = without_quotations(CITATION.sub(" ", fold(answer)))
    words = list(dict.fromkeys(w.casefold() for w in _LETTERS.findall(bare) if len(w) > 1 and w.casefold() not in asked_words and not w.isupper()))
    tongue = other_tongue(words, own) if len(words) >= 3 else None
    return tongue is not None and tongue[1] >= TONGUE


_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "「": "」", "（": "）", "【": "】"}
_CLOSE = set("".join(_OPEN.values()))
# fixed values: elements whose end must be written; others end with the element around them, or have no end
_PAIRED = "ul ol dl table b i u em strong code pre blockquote div span a h1 h2 h3 h4 h5 h6 sup sub section details summary".split()
_TAG = re.compile(r"<(/?)(" + "|".join(_PAIRED) + r")(?:\s+[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))*\s*>", re.I)
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_INLINE = frozenset(('"', "`", "**", "*"))


def open_parts(text: str) -> list[str]:
    """The stack of a pushdown parser at the end of a text: fences, elements, brackets, quotations, emphasis and code
    that were opened and not closed.

    A fence is closed by one of its own kind and at least its length, and nothing within it counts. An end closes what
    was opened within its part; one without a beginning is passed over. Inline marks end with their item or paragraph.
    """
    stack: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark.group(1).startswith(fence) and not line[mark.end() :].strip():
                fence = ""
            continue
        if mark:
            fence = mark.group(1)
            continue
        if _ITEM.match(line) or not line.strip():
            stack = [s for s in stack if s not in _INLINE]
        i = 0
        while i < len(line):
            ch = line[i]
            tag = _TAG.match(line, i) if ch == "<" else None
            if tag:
                name = f"<{tag.group(2).lower()}>"
                if not tag.group(1):
                    stack.append(name)
                elif name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
                i = tag.end()
                continue
            if ch == "*":
                width = 2 if line.startswith("**", i) else 1
                before, after = line[i - 1 : i] if i else "", line[i + width : i + width + 1]
                kind = "*" * width
                if kind in stack and (width == 2 or not before.isspace()):
                    del stack[len(stack) - 1 - stack[::-1].index(kind) :]
                elif width == 2 or after.isalpha() and not before.isalnum() and before not in ("*", ")", "]"):
                    stack.append(kind)
                i += width
                continue
            if ch in ('"', "`"):
                if ch in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(ch) :]
                elif ch == "`" or i == 0 or not line[i - 1].isalnum():
                    stack.append(ch)
            elif ch in _CLOSE and any(ch in _OPEN.get(s, "") for s in stack):
                while ch not in _OPEN.get(stack.pop(), ""):
                    pass
            elif ch in _OPEN and not (ch == "(" and line[i - 1 : i] in (":", ";")):
                stack.append(ch)
            i += 1
    return [*stack, fence] if fence else stack


_ITEM = re.compile(r"\s*(?:[-*•–—+]|\d{1,3}[.)]|[a-z][.)])(?:\s+|$)")
_STOPS = set(".!?。！？…؟।|")


def unfinished(answer: str) -> tuple[str, str] | None:
    """``("truncated", "")`` if the parser's stack or last word shows a break, ``("words", "prev last")`` if only the
    last words of an item can tell, ``("short", "prev last")`` if those of a very short answer, None if it is complete."""
    text = fold(answer).rstrip()
    if open_parts(text):
        return "truncated", ""
    last = text.split("\n")[-1]
    item = _ITEM.match(last)
    body = last[item.end() :] if item else last
    if not body.strip():
        return "truncated", ""
    end = re.sub(r"[\s\"'”’»」)\]*_`}）】]+$", "", CITATION.sub(lambda m: "]" * len(m.group()), body))
    cited = CITATION.search(body) is not None and CITATION.sub("", body[body.rfind("[") :]).strip(" .") == "" and body.rstrip(" .").endswith("]")
    if cited or not end or end[-1] in _STOPS or text[-1] in ")]）】":
        return None
    if end.endswith(">") and _TAG.search(end):
        return None
    if re.search(r"(?:https?://|www\.)\S+/\S+$|\S+@\S+\.\w+$", end, re.I):
        return None
    if not end[-1].isalnum() and end[-1] not in "%°":
        return "truncated", ""
    words = " ".join(end_words(body)[-2:])
    before = CITATION.sub("", text[: len(text) - len(last)]).rstrip(" \t\n\"'”’)]*_")
    if before[-1:] in _STOPS and before:
        return "truncated", ""
    if item:
        return "words", words
    if len(_TOKEN.findall(text)) <= 3:
        return "short", words
    return "truncated", ""


_PIECE = r"[\p{L}\p{N}]+|[.!?。；;:]|\n|\["


def _plain(text: str) -> str:
    return re.sub(r"[0-9]+", "0", re.sub(r"\b[a-z]{3,6}[0-9]+\b", "sym0", text.lower()))


def end_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", _plain(fold(text)))


def _pieces(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\b[a-z]{3,6}[0-9]+\b", "sym0"), "[0-9]+", "0")
    return F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0))


#: Last words that are looked for in the corpus: up to so many are sent to every task, more are joined by a shuffle.
FEW = 50_000


def _word_ends(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """``prev, last, n, ends`` of the wanted last words: how often they occur and how often an end follows."""
    pieces = answers.select(_pieces(F.col("answer")).alias("p"))
    marks = F.array(*(F.lit(x) for x in (".", "!", "?", "。", "\n", "[")))
    triple = F.transform(
        F.col("p"),
        lambda x, i: F.struct(F.coalesce(F.get("p", i - 1), F.lit("")).alias("prev"), x.alias("last"), F.array_contains(marks, F.get("p", i + 1)).alias("end")),
    )
    lasts = cut(wanted.select("last").distinct())
    rows = pieces.select(F.inline(F.filter(triple, lambda t: t["last"].rlike(r"^[\p{L}\p{N}]"))))
    rows = rows.join(F.broadcast(lasts) if lasts.count() <= FEW else lasts, "last", "left_semi")
    return rows.groupBy("prev", "last").agg(F.count("*").alias("n"), F.count_if(F.coalesce("end", F.lit(False))).alias("ends"))


def _beginnings(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """``last`` of the wanted words of three letters or more that a longer, frequent word of the corpus begins with."""
    counted = answers.select(F.explode(F.filter(_pieces(F.col("answer")), lambda x: x.rlike(r"^\p{L}{4}"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")
    heads = counted.select(F.explode(F.transform(F.sequence(F.lit(3), F.length("w") - 1), lambda k: F.left(F.col("w"), k))).alias("last")).distinct()
    return wanted.where(F.length("last") >= 3).select("last").distinct().join(heads, "last", "left_semi")


def defects(df: DataFrame, id_col: str, question: str, answer: str) -> DataFrame:
    """``id, defect_type`` of each defective pair, one row per distinct (id, question, answer).

    A null, blank or placeholder answer is ``empty``; with a null or empty question only ``empty``, ``refusal`` and
    ``truncated`` can be told; a null id comes out as null. Texts of any length are parsed whole. Exact repeats count
    once; an empty table gives none. Only the three columns are read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(question).alias("question"), F.col(answer).alias("answer")).distinct()
    kind = pa.schema([("id", pa.int64()), ("defect_type", pa.string()), ("prev", pa.string()), ("last", pa.string())])

    def judge(q: str | None, a: str | None) -> tuple[str | None, str | None, str | None]:
        if is_empty(a):
            return "empty", None, None
        if is_copy(q, a):
            return "copied_question", None, None
        if is_refusal(a):
            return "refusal", None, None
        if in_other_language(q, a):
            return "other_language", None, None
        found = unfinished(a)
        if found is None:
            return None, None, None
        if found[0] == "truncated":
            return "truncated", None, None
        words = ["", "", *found[1].split()]
        known = words[-1] in end_words(q or "") or not words[-1].isalpha()
        if found[0] == "short" and known:
            return None, None, None
        return ("asked" if known else found[0]), words[-2], words[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *judge(q, a)) for i, q, a in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            out = [x for x in out if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kind)], schema=kind)

    judged = cut(rows.mapInArrow(run, "id bigint, defect_type string, prev string, last string"))
    undecided = ("words", "asked", "short")
    open_ = judged.where(F.col("defect_type").isin(*undecided)).select("id", "prev", "last", F.col("defect_type").alias("kind"))
    answers = rows.where("answer is not null")
    ends = cut(_word_ends(answers, open_))
    one = ends.groupBy("last").agg(F.sum("n").alias("n1"), F.sum("ends").alias("ends1"))
    begun = _beginnings(answers, open_.where("kind = 'short'").join(one.where("n1 >= 5"), "last", "left_anti"))
    decided = open_.join(ends, ["prev", "last"], "left").join(one, "last", "left").join(begun.withColumn("begun", F.lit(True)), "last", "left")
    rate = F.when(F.col("n") >= 5, F.col("ends") / F.col("n")).when(F.col("n1") >= 5, F.col("ends1") / F.col("n1"))
    # a word that the corpus does not know breaks off, unless it is a number or code or was in the question
    item = F.coalesce(rate < 0.01, F.col("kind") == "words")
    # an answer of a few words may be a name: it breaks off where a known word goes on, or on a word that never ends one
    never = (F.col("prev") != "") & (F.col("n1") >= 100) & (F.col("ends1") < 0.01 * F.col("n1"))
    broken = F.when(F.col("kind") == "short", F.coalesce(never, F.lit(False)) | F.coalesce("begun", F.lit(False))).otherwise(item)
    return judged.where(~F.col("defect_type").isin(*undecided)).select("id", "defect_type").unionAll(decided.where(broken).select("id", F.lit("truncated").alias("defect_type")))
