"""Stemming of ROUGE tokens longer than 3 characters.

The Porter algorithm with the extensions that the usual Python toolkit applies by default:
a list of irregular forms, ``-ies`` / ``-ied`` of four letters to ``-ie``, ``y`` to ``i``
only after a consonant that is not the first letter, ``-alli`` tried again as ``-al``,
``-bli``, ``-fulli`` and ``-logi``, and vowel-consonant pairs counted as short syllables.
The 1980 rules stay available with ``extended=False``.

A small per-word helper: an Arrow-batched pandas UDF over token arrays whose bounded memo
lives as long as the worker, so a distinct word is stemmed once per worker, in place and
without a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiou"

# The published suffix rules, steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP2_EXTENDED = [(s, r) for s, r in STEP2 if s != "abli"] + [("bli", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


# Irregular forms of the extended variant.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    forms = "".join("c" if _is_cons(stem, i) else "v" for i in range(len(stem)))
    collapsed = []
    for f in forms:
        if not collapsed or collapsed[-1] != f:
            collapsed.append(f)
    s = "".join(collapsed)
    return s.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str, extended: bool = False) -> bool:
    if extended and len(w) == 2:
        return not _is_cons(w, 0) and _is_cons(w, 1)
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2)
            and _is_cons(w, len(w) - 1) and w[-1] not in "wxy")


def _longest(word: str, rules):
    best = None
    for suf, rep in rules:
        if word.endswith(suf) and (best is None or len(suf) > len(best[0])):
            best = (suf, rep)
    return best


def _step2(w: str, extended: bool) -> str:
    if extended and w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-2], extended)
    hit = _longest(w, STEP2_EXTENDED if extended else STEP2)
    if hit:
        # for -logi the l counts as part of the stem
        kept = w[:-3] if hit[0] == "logi" else w[: -len(hit[0])]
        if _measure(kept) > 0:
            return w[: -len(hit[0])] + hit[1]
    return w


def porter_stem(w: str, extended: bool = True) -> str:
    if extended and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if extended and len(w) == 4 else w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w, extended):
            w += "e"
    # step 1c
    if w.endswith("y"):
        before = w[:-1]
        if (len(before) > 1 and _is_cons(before, len(before) - 1)) if extended else _has_vowel(before):
            w = before + "i"
    # step 2, 3
    w = _step2(w, extended)
    hit = _longest(w, STEP3)
    if hit and _measure(w[: -len(hit[0])]) > 0:
        w = w[: -len(hit[0])] + hit[1]
    # step 4
    hit = _longest(w, [(s, "") for s in STEP4])
    if hit:
        stem = w[: -len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            w = stem
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem, extended)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stem_word(w: str) -> str:
    """ROUGE rule: only tokens longer than 3 characters are stemmed."""
    return porter_stem(w) if len(w) > 3 else w


class _Stems(dict):
    """Memo of a worker, bounded."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        stem = self[word] = stem_word(word)
        return stem


_MEMO = _Stems()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(col: pd.Series) -> pd.Series:
    return col.map(lambda tokens: None if tokens is None else [_MEMO[t] for t in tokens])


def stem_tokens(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with the token arrays ``cols`` stemmed, all in one pass through Python."""
    return df.withColumns({c: _stem_arrays(F.col(c)) for c in cols})
