"""Terms for search: letters folded to their base, and the stemmer published by M. F. Porter in 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the steps of the published algorithm, longest first where it matters.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """The word as v (vowels) and c (consonants); y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or letter == "y" and out.endswith("c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of a lower-case ASCII word of three letters or more; others stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _ends_cvc(w):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP_2, _STEP_3):
        s = _longest(w, step)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + step[s]
    s = _longest(w, _STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Lower-case letters with marks of the Latin, Greek and Cyrillic blocks, and their base letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if letter.islower() and len(base) == 1 and base != letter:
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case, marks removed: ``Café`` and ``cafe`` are one."""
    plain = F.regexp_replace(F.lower(text), r"\p{Mn}+", "")
    return F.translate(plain, *_base_letters())


def fold_text(text: str) -> str:
    table = str.maketrans(*_base_letters())
    return re.sub("[̀-ͯ]+", "", text.lower()).translate(table)


def stems(term: Column) -> Column:
    """Stem of every term; each distinct one of a batch is worked out once."""

    @F.pandas_udf("string")
    def work(terms: pd.Series) -> pd.Series:
        return terms.map({t: porter(t) for t in terms.dropna().unique()})

    return work(term)
