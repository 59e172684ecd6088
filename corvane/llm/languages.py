"""The language of a short text, by script and function words, and the language that a text asks for."""

from __future__ import annotations

import re

#: Frequent function words; fixed values.
WORDS = {
    "en": "the a an and or of to in on at is are was were be been it its this that these those which who what why how when where does do did has have had will would can could should not no nothing for from with without by as if than then there here any all both each every after before but so you your we our they their i only into out about because rather more most one two first next please only yes nobody never longer still called",
    "de": "der die das den dem des ein eine einen einem eines und oder nicht ist sind war wird werden wurde mit von zu zum zur im in auf für aus bei nach ohne als auch nur wenn dass weil wie was wer wo warum welche welcher ich du er sie es wir ihr man kann muss soll hat haben beide alle niemand dazu dabei diese dieser dieses sich sondern noch schon etwa beim seit einer ändern gibt davon gilt kein keine",
    "es": "el la los las un una unos unas y o de del al en con sin por para que qué se su sus es son está están era fue ser no nada como cómo cuando donde dónde cuál qué quién más menos pero porque si lo le les este esta estos estas ahora hay ya muy todos todas dos solo desde después antes entre sobre nadie puedo hace sido ha",
    "fr": "le la les un une des du de et ou en à au aux avec sans pour par que qui quoi dont où ne pas plus se son sa ses ce cette ces est sont était être il elle ils elles on nous vous je tu mais car si comme quand quels quelle quel pourquoi comment tous toutes deux seulement après avant depuis personne n d l qu s c y a été fait puis",
    "pt": "o a os as um uma uns umas e ou de do da dos das em no na nos nas com sem por para que se seu sua seus suas é são está estão era foi ser não nada como quando onde qual quais quem mais menos mas porque pois este esta isso agora há já muito todos todas duas dois só somente desde depois antes entre sobre ninguém pelo pela ao à posso faz foi deveria",
    "it": "il lo la i gli le un uno una e o di del della dei delle in nel nella con senza per che chi non più se suo sua è sono era essere come quando dove quale perché ma anche solo dopo prima questo questa tutti",
}
SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_LANGUAGES_OF = {w: tuple(k for k, s in SETS.items() if w in s) for w in frozenset().union(*SETS.values())}
#: Names of languages in several languages; fixed values.
NAMES = {
    "en": "english|englisch|inglés|anglais|inglês|inglese", "de": "german|deutsch|alemán|allemand|alemão|tedesco", "es": "spanish|spanisch|español|espagnol|espanhol|castellano|spagnolo",
    "fr": "french|französisch|francés|français|francês|francese", "pt": "portuguese|portugiesisch|portugués|portugais|português|portoghese", "it": "italian|italienisch|italiano|italien",
    "zh": "chinese|chinesisch|chino|chinois|chinês|中文", "ja": "japanese|japanisch|japonés|japonais|japonês|日本語", "ru": "russian|russisch|ruso|russe|russo",
}
_ASK = re.compile(r"(?i)\b(?:answer|reply|respond|write|explain|antwort\w*|schreib\w*|respond[ea]\w*|contest[ae]\w*|répond\w*|écri\w*|please|bitte|por favor|s'il)\b[^.?!\n]{0,40}?\b(?:in|auf|en|em|na|no|into)\s+(?P<n>[^\W\d_]+)")
_NAME = {n: k for k, ns in NAMES.items() for n in ns.split("|")}
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`|(?<!\S)\S*[/\\_]\S*|\b\w+\.\w+\b|\b[A-Z]\w*[A-Z]\w*|\bhttps?:\S+", re.S)
_SCRIPTS = [("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[一-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("he", re.compile(r"[֐-׿]"))]


def language(text: str) -> str | None:
    """The language of text, code left out; None if nothing tells."""
    t = _CODE.sub(" ", text)
    letters = len(re.findall(r"[^\W\d_]", t))
    if not letters:
        return None
    for k, p in () if t.isascii() else _SCRIPTS:
        if len(p.findall(t)) >= max(2, 0.2 * letters):
            return k
    score = dict.fromkeys(SETS, 0)
    for w in re.findall(r"[^\W\d_]+", t.lower()):
        for k in _LANGUAGES_OF.get(w, ()):
            score[k] += 1
    best, second = sorted(score.values(), reverse=True)[:2]
    if best == 0 or best == second:
        return None
    return max(score, key=score.get)


def asked_language(question: str) -> str | None:
    """The language that a question asks to be answered in."""
    for m in _ASK.finditer(question):
        if (k := _NAME.get(m["n"].lower())) is not None:
            return k
    return None
