"""Languages of Latin script by character n-grams.

A naive Bayes model over the n-grams of words (1 to 4 characters with the word's ends, and the whole word), trained at
import on the first article of the Universal Declaration of Human Rights in each language and on the frequent words of
:mod:`weftgraph.llm.text`. It tells that a text is of another language than expected where no word list of it exists.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

# public text: Universal Declaration of Human Rights, article 1
ARTICLE = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Det är inte en av som på för med till också har kan sjukdomen beror",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Det er ikke en af som på for med til også har kan sygdommen skyldes",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Det er ikke en av som på for med til også har kan sykdommen skyldes",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Se on ei että tämä joka myös tauti johtuu",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. To jest nie na do że z jak ale przez oraz choroba jest spowodowana",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. To je není na že jako ale také nemoc je způsobena",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Ez nem hogy egy is a betegség oka",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Este nu o că pe cu pentru care boala este cauzată",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Bu bir değil için olarak daha çok ile hastalık neden olur",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Ini adalah tidak untuk dengan dari pada juga penyakit disebabkan oleh",
}
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [f"={word}"]


@lru_cache(maxsize=1)
def _model() -> tuple[tuple[str, ...], dict[str, list[float]], list[float]]:
    """Languages, log probabilities of each n-gram and of an unknown one."""
    from weftgraph.llm.text import FREQUENT

    langs = tuple(ARTICLE)
    counts = {lang: Counter(g for w in _WORD.findall((ARTICLE[lang] + " " + FREQUENT.get(lang, "")).casefold()) for g in _grams(w)) for lang in langs}
    every = {g for c in counts.values() for g in c}
    total = {lang: sum(c.values()) + 0.5 * len(every) for lang, c in counts.items()}
    return langs, {g: [math.log((counts[lang][g] + 0.5) / total[lang]) for lang in langs] for g in every}, [math.log(0.5 / total[lang]) for lang in langs]


@lru_cache(maxsize=1 << 16)
def _word_scores(word: str) -> tuple[float, ...]:
    """Log likelihoods of a word, per n-gram, so that a long name counts no more than a short word."""
    langs, known, unknown = _model()
    grams = _grams(word)
    sums = [0.0] * len(langs)
    for g in grams:
        for k, v in enumerate(known.get(g, unknown)):
            sums[k] += v
    return tuple(4 * s / len(grams) for s in sums)


def other_tongue(words: list[str], own: str) -> tuple[str, float] | None:
    """The likeliest language of the words and by how much, a word, it beats ``own``; None if ``own`` is the likeliest
    or unknown here."""
    langs, _, _ = _model()
    if own not in langs or not words:
        return None
    sums = [sum(x) for x in zip(*map(_word_scores, words))]
    best = max(range(len(langs)), key=sums.__getitem__)
    return None if langs[best] == own else (langs[best], (sums[best] - sums[langs.index(own)]) / len(words))
