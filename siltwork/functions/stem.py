"""The stemmer of English words published by M. F. Porter in 1980, with the departures that text metrics commonly use: words
of four letters in -ies and -ied, a short list of irregular forms, -bli, -fulli and -logi, and y after a consonant."""

from __future__ import annotations

from functools import lru_cache

# Endings and irregular forms of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
REDUCED = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """A letter c or v for each of a word: y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        vowel = x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def _short(word: str) -> bool:
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _replaced(word: str, endings, allowed=lambda stem: measure(stem) > 0) -> str:
    """The first ending that fits is replaced, if its stem allows it."""
    for ending, new in endings:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + new if allowed(stem) else word
    return word


def _without_past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return _replaced(word, (("eed", "ee"),))
    ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short(stem) else stem


def _without_derivation(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _without_derivation(word[:-2])
    if word.endswith("logi") and not word.endswith(tuple(e for e, _ in DERIVED)):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return _replaced(word, DERIVED)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _replaced(word, PLURALS, lambda stem: True)
    word = _without_past(word)
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _replaced(_without_derivation(word), REDUCED)
    ending = next((e for e in DROPPED if word.endswith(e)), None)
    if ending and measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
