"""The English (Porter2) stemming algorithm, as published at snowballstem.org."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Words with stems of their own, words left alone, and those left after plurals are gone.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_ALONE = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
_STOP_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
# Suffixes of steps 2 and 3 and what they become in region 1.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_ENDS2 = tuple(sorted((*_STEP2, "ogi", "li"), key=len, reverse=True))
_ENDS3 = tuple(sorted((*_STEP3, "ative"), key=len, reverse=True))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_ENDS4 = (*_STEP4, "ion")
_ENDS1B = ("eedly", "ingly", "edly", "eed", "ing", "ed")
_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_REGION_1 = re.compile(r"gener|commun|arsen")
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y")


def _regions(w: str) -> tuple[int, int]:
    m = _REGION_1.match(w) or _REGION.match(w)
    r1 = m.end() if m else len(w)
    m = _REGION.match(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _ALONE:
        return word
    w = word.removeprefix("'")
    w = _CONSONANT_Y.sub(r"\1Y", w) if "y" in w else w
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _STOP_1A:
        return w
    # 1b: -eed, -ed, -ing
    for s in _ENDS1B if w.endswith(_ENDS1B) else ():
        if w.endswith(s):
            if s.startswith("eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif re.search(r"[aeiouy]", w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c: final y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2 and 3: derivational endings in region 1
    for s in _ENDS2 if w.endswith(_ENDS2) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in _LI else w
                else:
                    w = w[: -len(s)] + _STEP2[s]
            break
    for s in _ENDS3 if w.endswith(_ENDS3) else ():
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    # 4: endings in region 2
    for s in _ENDS4 if w.endswith(_ENDS4) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5: final e and l
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
