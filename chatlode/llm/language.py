"""Language of a text among those of the archive, by script and by counts of function words."""

from __future__ import annotations

import re

# Frequent function words that tell the Latin-script languages apart.
WORDS = {
    "en": "the of and to is in it that for you was with on are be this i have not at but by from or an as my your if which will would can how what why do does did me please there be looks look about than first their we they has had when before after between more most",
    "de": "der die das und ist nicht ich ein eine einen zu den mit auf für von dem des sich im es wie was warum bitte mein meine wir sie kann würde mir bei nach oder aber wenn auch noch nur als am zur zum über vor hat wird sind war diese dieser einer",
    "fr": "en l'art surtout concerne courte reste première premier d'un d'une n'est j'ai qu'on le la les des et est une un du que qui dans pour pas je il ce sur avec au aux plus ne se ou mon ma mes par comment pourquoi peux tu votre nous vous c'est d'abord qu'il cette son sa été être sont mais si comme",
    "es": "primero trata todo sigue va sea tan el los las y es una un que en de la por para con no se del al lo su como más mi qué cómo por puedes puede si está esta este pero yo sobre antes entre hay ser son fue muy porque donde cuando ya o",
}
#: Languages of each word, as a tuple of places in WORDS.
_OF: dict[str, tuple[int, ...]] = {}
for _i, _v in enumerate(WORDS.values()):
    for _w in set(_v.split()):
        _OF[_w] = (*_OF.get(_w, ()), _i)
_NAMES = tuple(WORDS)
_WIDE = re.compile(r"[぀-ヿ一-鿿]")
_TOKEN = re.compile(r"[a-zà-öø-ÿßœ]+(?:'[a-zà-öø-ÿ]+)?")
_KANA = re.compile(r"[぀-ヿ]+")
_HAN = re.compile(r"[一-鿿]+")
_BLOCK = re.compile(r"```.*?(?:```|$)", re.S)
_SPAN = re.compile(r"`[^`\n]*`|https?://\S+|\S+@\S+")
_MARKS = (("¿¡ñ", "es"), ("ßäöü", "de"), ("çœêèàùîô", "fr"))


def language(text: str) -> tuple[str | None, float]:
    """(language, margin): zh, ja, en, de, fr, es or null; the margin is the lead in function words, or follows the letters of a script."""
    t = _BLOCK.sub(" ", text) if "```" in text else text
    if "`" in t or "@" in t or "://" in t:
        t = _SPAN.sub(" ", t)
    low = t.lower()
    tokens = _TOKEN.findall(low)
    if not t.isascii() and _WIDE.search(t):
        kana, han = sum(map(len, _KANA.findall(t))), sum(map(len, _HAN.findall(t)))
        if (han + kana) * 3 >= sum(map(len, tokens)):
            return ("ja", kana) if kana * 6 >= han else ("zh", han / 8)  # a few characters can be either
    if not tokens:
        return None, 0
    score = [0.0] * len(_NAMES)
    for of in map(_OF.get, tokens):
        if of:
            for k in of:
                score[k] += 1
    if not low.isascii():
        for marks, k in _MARKS:
            score[_NAMES.index(k)] += 0.5 * sum(map(low.count, marks))
    x = max(score)
    y = sorted(score)[-2]
    return (_NAMES[score.index(x)], x - y) if x > y else (None, 0)
