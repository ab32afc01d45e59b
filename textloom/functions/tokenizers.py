"""Tokenizers as array columns, token counters and their scalings."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import measures


def character(c: Column) -> Column:
    return measures.tokens(c, "char")


def q_grams(c: Column, q: int = 2, start: str = "$", stop: str = "#") -> Column:
    """Padded q-grams; q of 1 pads nothing, the empty string has none."""
    if q < 1:
        raise ValueError("q must be at least 1")
    return measures.q_grams(c, q, start, stop)


def regexp(c: Column, pattern: str = r"\w+") -> Column:
    """All matches; word characters are Unicode's."""
    return F.regexp_extract_all(c, F.lit(f"(?U)({pattern})"), 1)


def whitespace(c: Column) -> Column:
    return regexp(c, r"\S+")


def wordpunct(c: Column) -> Column:
    return regexp(c, r"\w+|[^\w\s]+")


def _clusters(pattern: str):
    return lambda c: regexp(c, pattern)


#: Runs of vowels and consonants; y counts as a vowel.
_V, _C = "[aeiouyAEIOUY]", "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]"
c_or_v_cluster = _clusters(f"{_V}+|{_C}+|[^\\s{_V[1:-1]}{_C[1:-1]}]+")
cv_cluster = _clusters(f"{_C}+{_V}*|{_V}+|[^\\s{_V[1:-1]}{_C[1:-1]}]+")
vc_cluster = _clusters(f"{_V}+{_C}*|{_C}+|[^\\s{_V[1:-1]}{_C[1:-1]}]+")


_SYLLABLE = re.compile("[^ ](?:[aeiouyAEIOUY]*(?<=[aeiouyAEIOUY])[^aeiouyAEIOUY](?![aeiouyAEIOUY])|[aeiouyAEIOUY]*)", re.DOTALL)


def saps_syllables(text: str) -> list[str]:
    """Syllables of the last word: a letter, its vowels, and a consonant unless a vowel follows it."""
    return _SYLLABLE.findall(text.split()[-1]) if text.split() else []


def saps(c: Column) -> Column:
    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else saps_syllables(x))

    return F.pandas_udf(batch, "array<string>")(c)


# Vowels, and the sonority of other letters; a mark that is no letter closes a syllable.
_VOWELS = "aeiouy"
_SONORITY = {**dict.fromkeys(_VOWELS, 4), **dict.fromkeys("lmnrw", 3), **dict.fromkeys("fsvz", 2), **dict.fromkeys("bcdghjkpqtx", 1)}


def sonority_syllables(word: str) -> list[str]:
    """Parts of a word cut where sonority is least, or where it stays equal after falling; parts without a vowel join the one before, or the next."""
    ranks = [_SONORITY.get(x, 4 if x.isalpha() else 0) for x in word.lower()]
    parts, start = [], 0
    for i in range(1, len(word)):
        before, here, after = ranks[i - 1], ranks[i], ranks[i + 1] if i + 1 < len(word) else 0
        if not here:
            cut = i + 1
        elif after and before >= here == after:
            cut = i + 1
        elif before > here < after:
            cut = i
        else:
            continue
        if cut > start:
            parts.append(word[start:cut])
            start = cut
    syllables: list[str] = []
    for part in [*parts, word[start:]]:
        if syllables and (not set(part.lower()) & set(_VOWELS) or not set(syllables[-1].lower()) & set(_VOWELS)):
            syllables[-1] += part
        else:
            syllables.append(part)
    return [x for x in syllables if x]


def legality_syllables(word: str, onsets: frozenset[str] = frozenset()) -> list[str]:
    """Syllables of one vowel each, read from the end; a syllable takes the consonants before its vowel as long as they are an onset, the rest close the one before."""
    syllables, end, at = [], len(word), len(word) - 1
    while at >= 0:
        if word[at].lower() in _VOWELS:
            while at and word[at - 1].lower() not in _VOWELS and word[at - 1 : _vowel_from(word, at)].lower() in onsets:
                at -= 1
            syllables.append(word[at:end])
            end = at
        at -= 1
    return [*([word[:end]] if end else []), *reversed(syllables)]


def _vowel_from(word: str, at: int) -> int:
    return next(i for i in range(at, len(word)) if word[i].lower() in _VOWELS)


def onsets(words: DataFrame, threshold: float = 0.0002, word_col: str = "word") -> DataFrame:
    """(onset, n): what precedes the first vowel of words, their marks dropped, where it makes up more than the threshold; so there are fewer than 1 / threshold."""
    found = words.select(F.regexp_extract(F.lower(F.regexp_replace(word_col, r"[^\p{L}]", "")), f"^[^{_VOWELS}]*", 0).alias("onset"))
    counts = found.where(F.col("onset").isNotNull()).groupBy("onset").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") > F.col("total") * threshold).select("onset", "n")


def _by_word(split):
    """A column function: the parts of all words of a text; a text without words is its own token."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else [part for word in x.split() for part in split(word)] or [x])

    return F.pandas_udf(batch, "array<string>")


def sonority(c: Column) -> Column:
    return _by_word(sonority_syllables)(c)


def legality(c: Column, legal: list[str] | None = None) -> Column:
    """With the onsets that onsets() found; without any, each vowel begins a syllable."""
    known = frozenset(legal or [])
    return _by_word(lambda word: legality_syllables(word, known))(c)


def wrapped(tokenizer):
    """A column function from any object (or class) with a method `tokenize` from a string to a list of strings."""
    made = tokenizer() if isinstance(tokenizer, type) else tokenizer
    if not callable(getattr(made, "tokenize", None)):
        raise TypeError("a tokenizer needs a method tokenize")
    return F.pandas_udf(lambda s: s.map(lambda x: x if x is None else list(made.tokenize(x))), "array<string>")


def q_skipgrams(q: int = 2, start: str = "$", stop: str = "#"):
    """A UDF: all q-letter subsequences of the padded string; meant for short strings, as their number grows with the length to the power q."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else ["".join(g) for g in combinations(start * (q - 1) + x + stop * (q - 1), q)] if x else [])

    return F.pandas_udf(batch, "array<string>")


def counter(tokens: Column) -> Column:
    """map<token, count>."""
    return F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda v: v == t)).cast("double"))))


def scaled(counts: Column, scaler: str | None = None) -> Column:
    """Counts as a set, divided by the length, or by powers or logs of it."""
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, v: a + v)
    forms = {None: lambda v: v, "set": lambda v: F.lit(1.0), "length": lambda v: v / total, "length-log": lambda v: F.log1p(v / total), "length-exp": lambda v: F.exp(v / total), "entropy": lambda v: -(v / total) * F.log2(v / total)}
    return F.transform_values(counts, lambda k, v: forms[scaler](v))
