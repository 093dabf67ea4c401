"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), with the extensions that scoring tools commonly use."""

from __future__ import annotations

from functools import lru_cache

# The algorithm's suffixes and what replaces them, step by step, in its order; and words stemmed by name.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def shape(word: str) -> str:
    """A word as v and c: vowels are a, e, i, o, u, and y after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Whether the stem ends with consonant, vowel, consonant, the last not w, x or y; or is a vowel and a consonant."""
    s = shape(stem)
    return (s.endswith("cvc") and stem[-1] not in "wxy") or s == "vc"


def replaced(word: str, rules, least: int) -> str:
    """The word by the first rule whose suffix it ends with, if the measure before it is at least ``least``."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if measure(stem) >= least else word
    return word


def past_and_ing(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem != word and "v" in shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and short_end(stem) else stem


def derivation(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return derivation(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return replaced(word, STEP_2, 1)


def ending(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word of lower-case letters and digits; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else replaced(word, STEP_1A, 0)
    word = past_and_ing(word)
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = ending(replaced(derivation(word), STEP_3, 1))
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
