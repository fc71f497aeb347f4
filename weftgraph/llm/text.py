"""Python-side text helpers for the batch kernels of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from weftgraph.llm.lookalike import parts_table

CITATION = re.compile(r"\[\s*F\s*\d+(?:\s*,\s*F?\s*\d+)*\s*\]", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    return {cp: "".join(map(chr, parts)) for cp, parts in parts_table().items()} | {0x2019: "'", 0x2018: "'", 0x3000: " "}


def fold(text: str) -> str:
    """The look of a text (widths, invisible characters, blanks, look-alike letters), with straight apostrophes."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_folding()))


def without_quotations(text: str) -> str:
    return _QUOTED.sub(" ", text)


# fixed values: frequent words of each language; a word of several languages counts for each in part
FREQUENT = {
    "en": "the of and is are was were to for with in that this these those by on at as it from be been can has have had which what who whose how why or an not but its their they we you your our if than then there does do did will would should about before after between into only also more most may might many some such because while any all each other another same first explain simple words please tell there's causes start join careful when compare comparing patients",
    "es": "el la los las de del que en un una unos unas y o se por para con sin su sus es son fue al lo como más pero no sobre este esta estos estas ese esa hay algún alguna qué cuál cuáles cómo por qué quién dónde entre cuando también muy ya así antes después según otra otro muchas muchos puede pueden debe deben está están ha han ser palabras causa explica",
    "fr": "le la les de des du un une et ou est sont a au aux en dans que qui quel quelle quels quelles pour par avec sans sur ce cette ces son sa ses leur leurs il elle ils elles on nous vous ne pas plus mais comme donc avant après entre beaucoup peut doit été être fait il y existe expliquez cause mots",
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren wird werden zu zum zur von vom mit für auf im in an am als auch nicht nur aber wenn dass bei nach vor über unter zwischen wie was welche welcher welches wer warum gibt es sich sie er wir ihr ihre ich man kann können viele einfach bitte noch mehr hat haben deshalb etwa",
    "pt": "o a os as de do da dos das que em no na nos nas um uma uns umas e ou se por para com sem seu sua seus suas é são foi ao à aos às mais mas não sobre este esta esse essa há algum alguma qual quais como quem onde entre quando também muito já assim antes depois outra outro muitas muitos pode podem deve está estão ser tem explique causa isso",
    "it": "il lo la i gli le di del della dei delle che in un una e o è sono per con su non più ma come questo questa quale perché anche molto essere ha hanno nel nella dal alla",
    "nl": "de het een en of is zijn was van voor met in op aan als niet maar ook dat die dit deze wat welke hoe waarom er naar door over tussen worden wordt kan kunnen heeft hebben veel",
}
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _words in FREQUENT.items():
    for _w in set(_words.split()):
        _WEIGHT.setdefault(_w, {})[_lang] = 1.0
for _w, _langs in _WEIGHT.items():
    for _lang in _langs:
        _langs[_lang] = 1.0 / len(_langs) ** 2


def _script(ch: str) -> str | None:
    o = ord(ch)
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        return "zh"
    if 0x3040 <= o <= 0x30FF:
        return "ja"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF:
        return "ko"
    if 0x0400 <= o <= 0x052F:
        return "ru"
    if 0x0600 <= o <= 0x06FF:
        return "ar"
    if 0x0900 <= o <= 0x097F:
        return "hi"
    if 0x0590 <= o <= 0x05FF:
        return "he"
    if 0x0E00 <= o <= 0x0E7F:
        return "th"
    if 0x03B1 <= o <= 0x03C9:
        return "el"
    return None


@lru_cache(maxsize=1 << 17)
def _word_evidence(word: str) -> tuple[tuple[str, float], ...]:
    scripts = None if word.isascii() else Counter(s for s in map(_script, word) if s)
    if not scripts:
        return tuple(_WEIGHT.get(word, {}).items())
    script, n = scripts.most_common(1)[0]
    if script in ("zh", "ja", "ko", "th"):
        return ((script, n / 2),)
    if n >= 3 or n == len(word):
        return ((script, 1.0),) if script != "el" or len(word) > 2 else ()
    return ()


def language_evidence(text: str, names: frozenset[str] = frozenset()) -> Counter:
    """Evidence for each language, in words; quotations, citations and the words of ``names`` have none."""
    text = fold(without_quotations(CITATION.sub(" ", text)).casefold())
    found: Counter = Counter()
    for word in _WORD.findall(text):
        if word not in names:
            for lang, weight in _word_evidence(word):
                found[lang] += weight
    if found["ja"] and found["zh"]:
        found["ja"] += found.pop("zh")
    return found


def language(text: str) -> str:
    """The language with most evidence, or ``und``."""
    found = language_evidence(text)
    best = max(found.items(), key=lambda x: (x[1], x[0]), default=("und", 0))
    return best[0] if best[1] > 0 else "und"


_END = re.compile(r"(?<=[.!?。！？؟।])[\"'”’)\]]*(?:\s+|(?<=[。！？।]))|\n+")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _END.split(text) if s and s.strip()]
