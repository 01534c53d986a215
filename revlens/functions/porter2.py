"""English (Porter2) stemmer, written from the published Snowball algorithm
description.  Pure Python, one word at a time; Spark jobs call it through
Arrow-batched pandas UDFs on distinct terms (see ``revlens.operators.stem``).
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
SPECIAL_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_STEP1A_INVARIANT = ("inning", "outing", "canning", "herring", "earring",
                          "proceed", "exceed", "succeed")
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
         "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _is_vowel(ch: str) -> bool:
    return ch in VOWELS


def _region_start(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, searching from ``start``."""
    for i in range(max(start, 1), len(word)):
        if not _is_vowel(word[i]) and _is_vowel(word[i - 1]):
            return i + 1
    return len(word)


def _ends_short_syllable(word: str) -> bool:
    n = len(word)
    if n >= 3:
        a, b, c = word[-3], word[-2], word[-1]
        return (not _is_vowel(a)) and _is_vowel(b) and (not _is_vowel(c)) and c not in "wxY"
    return n == 2 and _is_vowel(word[0]) and not _is_vowel(word[1])


def _has_vowel(s: str) -> bool:
    return any(_is_vowel(ch) for ch in s)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter2 stem of one lower-case word."""
    if word in SPECIAL_WORDS:
        return SPECIAL_WORDS[word]
    if len(word) <= 2:
        return word
    if word.startswith("'"):
        word = word[1:]
    # mark consonant y
    chars = list(word)
    for i, ch in enumerate(chars):
        if ch == "y" and (i == 0 or _is_vowel(chars[i - 1])):
            chars[i] = "Y"
    w = "".join(chars)

    r1 = next((len(p) for p in R1_PREFIXES if w.startswith(p)), None)
    if r1 is None:
        r1 = _region_start(w, 1)
    r2 = _region_start(w, r1 + 1) if r1 < len(w) else len(w)

    # step 0: possessive apostrophes
    for suf in ("'s'", "'s", "'"):
        if w.endswith(suf):
            w = w[: -len(suf)]
            break

    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ied") or w.endswith("ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("us") or w.endswith("ss"):
        pass
    elif w.endswith("s"):
        if _has_vowel(w[:-2]):
            w = w[:-1]

    if w in AFTER_STEP1A_INVARIANT:
        return w

    # step 1b
    for suf in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(suf):
            continue
        stem_part = w[: -len(suf)]
        if suf in ("eed", "eedly"):
            if len(w) - len(suf) >= r1:
                w = stem_part + "ee"
        elif _has_vowel(stem_part):
            w = stem_part
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _ends_short_syllable(w):
                w += "e"
        break

    # step 1c
    if len(w) > 2 and w[-1] in "yY" and not _is_vowel(w[-2]):
        w = w[:-1] + "i"

    # step 2
    for suf, rep in STEP2:
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ogi":
                    if w[-4] == "l":
                        w = w[:-3] + rep
                elif suf == "li":
                    if len(w) >= 3 and w[-3] in LI_ENDINGS:
                        w = w[:-2]
                else:
                    w = w[: -len(suf)] + rep
            break

    # step 3
    for suf, rep in STEP3:
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ative":
                    if len(w) - len(suf) >= r2:
                        w = w[:-5]
                else:
                    w = w[: -len(suf)] + rep
            break

    # step 4
    for suf in STEP4:
        if w.endswith(suf):
            if len(w) - len(suf) >= r2:
                if suf == "ion":
                    if len(w) >= 4 and w[-4] in "st":
                        w = w[:-3]
                else:
                    w = w[: -len(suf)]
            break

    # step 5
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _ends_short_syllable(base)):
            w = base
    elif w.endswith("l"):
        if len(w) - 1 >= r2 and w[-2] == "l":
            w = w[:-1]

    return w.replace("Y", "y")
