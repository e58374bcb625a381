"""Boolean full-text search over word stems."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS, tokens

VOWELS = "aeiouy"
# The published English stemmer's words with stems of their own, words that stay, prefixes
# after which a word's first region begins, and endings after which "li" may go.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
LATER_INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
PREFIXES = ("gener", "commun", "arsen")
LI_ENDINGS = "cdeghkmnrt"
# Suffixes of the second, third and fourth step, and what they become.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _vowel(w: str, i: int) -> bool:
    return w[i] in VOWELS  # a consonant y is written Y


def _region(w: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    return next((i + 1 for i in range(start + 1, len(w)) if not _vowel(w, i) and _vowel(w, i - 1)), len(w))


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return _vowel(w, 0) and not _vowel(w, 1)
    return len(w) > 2 and not _vowel(w, -3) and _vowel(w, -2) and not _vowel(w, -1) and w[-1] not in "wxY"


def _longest(w: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The English stem of a lower-cased word, by the steps of the published Snowball algorithm."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    head = next((p for p in PREFIXES if w.startswith(p)), "")
    r1 = len(head) or _region(w, 0)
    r2 = _region(w, r1)
    w = w.removesuffix(_longest(w, ("'", "'s", "'s'")))

    def has_vowel(part: str) -> bool:
        return any(c in VOWELS for c in part)

    # plurals
    s = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in LATER_INVARIANT:
        return w
    # past and present participles
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w, -2):
        w = w[:-1] + "i"
    # derivations
    s = _longest(w, SECOND)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4] == "l") and (s != "li" or w[-3] in LI_ENDINGS):
        w = w[: -len(s)] + SECOND[s]
    s = _longest(w, THIRD)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + THIRD[s]
    s = _longest(w, FOURTH)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def stemmed(text: Column) -> Column:
    """The distinct stems of a text's words that are not filler."""

    @F.pandas_udf("array<string>")
    def stems(words: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return words.map(lambda ws: sorted({known.get(w) or known.setdefault(w, stem(w)) for w in ws}))

    return stems(F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))))


def contains_all_stems(corpus: DataFrame, query: str) -> DataFrame:
    """(id) of texts that have the stem of every query word that is not filler."""
    wanted = sorted({stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOPWORDS})
    if not wanted:
        return corpus.select("id").limit(0)
    rows = corpus.select("id", stemmed(F.col("text")).alias("s"))
    return rows.filter(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("s"))) == 0).select("id")
