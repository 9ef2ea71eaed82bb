"""Stemmers: the published Porter algorithm for English, and light suffix strippers for other languages."""

from __future__ import annotations

import re

_VOWEL = "aeiou"

SUFFIXES = {
    "french": "issement issements atrices atrice ateurs ateur ations ation ements ement euses euse ments ment ances ance ences ence ités ité ives ive ifs if eux aux ées ée és er ez es é e s".split(),
    "german": "ern em er en es e s".split(),
    "spanish": "amientos amiento imientos imiento aciones ación adoras adora adores ador ancias ancia mente idades idad ivas iva ivos ivo osas osa osos oso es os as o a e".split(),
    "italian": "azioni azione amenti amento mente ità ivi iva ive ivo i e a o".split(),
    "portuguese": "amentos amento ações ação adores ador mente idades idade ivas iva ivos ivo es os as o a e s".split(),
    "dutch": "heden heid ingen ing en e s".split(),
    "danish": "erne erens erne enes ernes ende erende er en et e s".split(),
    "norwegian": "ene ane ande ende et en er ar e a s".split(),
    "swedish": "arna erna orna arnas ande ende ar er or en et a e s".split(),
    "finnish": "issa issä ista istä iin ssa ssä sta stä lla llä lta ltä lle na nä ksi tta ttä t n".split(),
    "hungarian": "ban ben ból ből nak nek val vel hoz hez höz ok ek ök t k".split(),
    "romanian": "ului elor ilor urile ile ii lor ul ea a e i".split(),
    "russian": "ами ями ого его ому ему ыми ими ать ять ить ов ев ей ий ый ой ая яя ое ее ие ые ах ях ам ям ом ем ую юю а я о е и ы у ю ь".split(),
    "arabic": "ها ان ات ون ين يه ية ه ة ي".split(),
    "turkish": "lerin ların leri ları ler lar nin nın nun nün in ın un ün de da den dan i ı u ü".split(),
    "irish": "eanna anna acht íocht ta te a e".split(),
    "hindi": "ियों ाओं ियां ों ें ीं ाएं ी ा े ि ु ो".split(),
    "sorani": "ەکان یەکان ەکە ان ێک ی".split(),
}
LANGUAGES = ("english", *SUFFIXES)


def light_stem(word: str, language: str = "french") -> str:
    """The word without the longest of the language's suffixes that leaves three letters or more."""
    for s in sorted(SUFFIXES.get(language, ()), key=len, reverse=True):
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)]
    return word


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize ion".split()


def porter(w: str) -> str:
    """The stem of a lower-case English word."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if _has_vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = max((s for s in table if w.endswith(s)), key=len, default=None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
