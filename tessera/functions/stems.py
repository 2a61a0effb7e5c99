"""English stems by the published rules of the Porter2 (Snowball English) algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

# The suffixes, exceptions and letter classes of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

PLURAL, PAST, OWNED = ("sses", "ied", "ies", "us", "ss", "s"), ("eed", "eedly", "ed", "edly", "ing", "ingly"), ("'", "'s", "'s'")
#: Letters in which a word must end for any step to change it.
LAST = frozenset(e[-1] for e in (*PLURAL, *PAST, *OWNED, *STEP_2, *STEP_3, *STEP_4, "y", "Y", "e", "l"))
_STEP_2, _STEP_3 = tuple(STEP_2), tuple(STEP_3)

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, endings: tuple[str, ...]) -> str | None:
    if not word.endswith(endings):
        return None
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    m = re.match("gener|commun|arsen", word) or _REGION.search(word)
    r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _past(word: str, r1: int) -> str:
    """Step 1b: endings of past and gerund."""
    end = _longest(word, PAST)
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    if not end or not any(c in VOWELS for c in word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(DOUBLES):
        return word[:-1]
    return word + "e" if r1 >= len(word) and _SHORT_END.search(word) else word


def _suffixes(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: derivational suffixes, the longest of each step."""
    end = _longest(word, _STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)][-1:]
        if (end != "ogi" or before == "l") and (end != "li" or before in LI_ENDINGS):
            word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, _STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)][-1:] in ("s", "t")):
        word = word[: -len(end)]
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word[-1:] not in LAST:
        return word.replace("Y", "y")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = word[: -len(e)] if (e := _longest(word, OWNED)) else word
    end = _longest(word, PLURAL)
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if word[-1:] in ("y", "Y") and len(word) > 2 and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _suffixes(word, r1, r2)
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
