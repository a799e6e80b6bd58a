"""Porter's second English stemmer, from its published description.

Rules look at two regions: R1 is what follows the first non-vowel after a vowel, R2 the same within R1.
"""

from __future__ import annotations

import re

#: Letters, doubles, endings and exceptions of the published algorithm (fixed values).
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_EARLY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STARTS = ("gener", "commun", "arsen")
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _after(word: str, start: int) -> int:
    """Where the region after the first vowel and non-vowel from ``start`` on begins."""
    found = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    word = word.lower().replace("’", "'")
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _WORDS:
        return _WORDS[word]
    word = word.removeprefix("'")
    # a y that stands for a consonant
    word = re.sub(f"(^|(?<=[{_VOWELS}]))y", "Y", word)
    r1 = next((len(p) for p in _STARTS if word.startswith(p)), None)
    r1 = _after(word, 0) if r1 is None else r1
    r2 = _after(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in _EARLY:
        return word
    end = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{_VOWELS}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    end = _longest(word, _STEP2)
    if end and len(word) - len(end) >= r1:
        rest = word[: -len(end)]
        if (end != "ogi" or rest.endswith("l")) and (end != "li" or rest[-1:] in tuple(_LI)):
            word = rest + _STEP2[end]
    end = _longest(word, _STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _STEP3[end]
    end = _longest(word, _STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
