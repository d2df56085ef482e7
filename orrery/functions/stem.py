"""Porter's stemmer (1980) for English words of lower-case letters, as a vectorised column function.

The five steps are tables of (suffix, replacement, condition on what is left);
one evaluator takes the longest suffix of a table that fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.workers import per_worker

Rule = tuple[str, str, Callable[[str], bool]]


def _shape(stem: str) -> str:
    """A letter c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longer(n: int) -> Callable[[str], bool]:
    return lambda stem: _measure(stem) > n


def _rules(text: str, condition: Callable[[str], bool]) -> list[Rule]:
    return [(a, b.strip("."), condition) for a, b in (pair.split(">") for pair in text.split())]


# The suffixes of the published algorithm ("." stands for nothing).
PLURALS = _rules("sses>ss ies>i ss>ss s>.", lambda _: True)
SECOND = _rules(
    "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate "
    "alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble", _longer(0)
)
THIRD = _rules("icate>ic ative>. alize>al iciti>ic ical>ic ful>. ness>.", _longer(0))
FOURTH = _rules("al>. ance>. ence>. er>. ic>. able>. ible>. ant>. ement>. ment>. ent>. ou>. ism>. ate>. iti>. ous>. ive>. ize>.", _longer(1))
FOURTH += [("ion", "", lambda stem: _measure(stem) > 1 and stem[-1:] in ("s", "t"))]


def _replaced(word: str, rules: Sequence[Rule]) -> str:
    fits = [r for r in rules if word.endswith(r[0])]
    if not fits:
        return word
    suffix, new, condition = max(fits, key=lambda r: len(r[0]))
    stem = word[: len(word) - len(suffix)]
    return stem + new if condition(stem) else word


def _participle(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix):
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def porter(word: str) -> str:
    """The stem of a word of a-z; other words and those of one or two letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    word = _participle(_replaced(word, PLURALS))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (SECOND, THIRD, FOURTH):
        word = _replaced(word, rules)
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    known = per_worker("stems", dict)
    if len(known) > 500_000:
        known.clear()
    for w in words.dropna().unique():
        if w not in known:
            known[w] = porter(w)
    return words.map(known.get, na_action="ignore")


def stem(word: Column) -> Column:
    return _stems(word)
