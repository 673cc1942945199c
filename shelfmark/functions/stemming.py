"""The English stemmer of the public Snowball project (Porter2), after its published description.

Words are lower-cased letters and digits, as the text index has them, so there are no apostrophes.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the algorithm: letters, endings and the words that it treats as exceptions.
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
REGION_STARTS = ("gener", "commun", "arsen")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _after_first_syllable(word: str, start: int) -> int:
    """Where the part after the first vowel and consonant from ``start`` on begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    head = next((h for h in REGION_STARTS if word.startswith(h)), None)
    first = len(head) if head else _after_first_syllable(word, 0)
    return first, _after_first_syllable(word, first)


def _ends_short(word: str) -> bool:
    """True if the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past_and_gerund(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if ending in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else word
    if not _has_vowel(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return stem + "e" if _ends_short(stem) and r1 >= len(stem) else stem


def _suffix_2(word: str, r1: int) -> str:
    ending = _longest(word, STEP_2)
    if ending is None or len(word) - len(ending) < r1:
        return word
    stem = word[: -len(ending)]
    if ending == "ogi" and not stem.endswith("l") or ending == "li" and stem[-1:] not in LI_ENDINGS:
        return word
    return stem + STEP_2[ending]


def _suffix_3(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, STEP_3)
    if ending is None or len(word) - len(ending) < (r2 if ending == "ative" else r1):
        return word
    return word[: -len(ending)] + STEP_3[ending]


def _suffix_4(word: str, r2: int) -> str:
    ending = _longest(word, STEP_4)
    if ending is None or len(word) - len(ending) < r2:
        return word
    stem = word[: -len(ending)]
    return word if ending == "ion" and stem[-1:] not in ("s", "t") else stem


def _last_letter(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _ends_short(word[:-1])):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= r2 else word


@lru_cache(maxsize=100_000)
def english_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"  # a consonant
    word = "".join(letters)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in UNCHANGED_LATER:
        return word
    word = _past_and_gerund(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _suffix_4(_suffix_3(_suffix_2(word, r1), r1, r2), r2)
    return _last_letter(word, r1, r2).replace("Y", "y")
