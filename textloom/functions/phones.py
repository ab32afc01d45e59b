"""Phones: feature bundles of IPA strings, their likeness, and the measures on phones.

A bundle is a 62-bit integer, two bits a feature from `syllabic` on: 01 has it, 10 lacks it, 11 both, 00 where it does not apply.
Bundles are built from each letter's articulation; UDFs are Arrow-vectorised, and null gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codes, edits, measures

# The features from the highest bits on.
FEATURES = (
    "syllabic consonantal sonorant approximant labial round protruded compressed labiodental coronal anterior distributed dorsal high low front back tense "
    "pharyngeal atr rtr voice spread_glottis constricted_glottis glottalic_suction velaric_suction continuant nasal strident lateral delayed_release"
).split()
# Features that apply only with an articulator.
_NEEDS = {"labial": "round protruded compressed labiodental", "coronal": "anterior distributed", "dorsal": "high low front back tense", "pharyngeal": "atr rtr"}
# What places, manners and shapes have.
_TERMS = {
    "bilabial": "labial", "labiodental": "labial labiodental", "dental": "coronal anterior distributed", "alveolar": "coronal anterior", "retroflex": "coronal", "postalveolar": "coronal distributed",
    "palatoalveolar": "coronal distributed dorsal", "alveolopalatal": "coronal distributed dorsal high", "palatal": "dorsal high", "velar": "dorsal high back", "uvular": "dorsal back", "pharyngeal": "pharyngeal rtr", "epiglottal": "pharyngeal", "glottal": "",
    "labiovelar": "labial dorsal high back", "rounded": "labial round", "compressed": "labial round compressed", "protruded": "labial round protruded", "dark": "dorsal high back",
    "stop": "consonantal", "nasal": "consonantal sonorant nasal voice", "trill": "consonantal sonorant voice", "tap": "consonantal sonorant continuant voice", "fricative": "consonantal continuant", "sibilant": "consonantal continuant strident",
    "approximant": "consonantal sonorant approximant continuant voice", "glide": "sonorant approximant continuant voice", "lateral": "lateral", "implosive": "constricted_glottis glottalic_suction", "click": "consonantal velaric_suction",
    "voiced": "voice", "aspirated": "spread_glottis", "glottalized": "constricted_glottis", "nasalized": "nasal voice",
    "vowel": "syllabic sonorant approximant labial dorsal pharyngeal voice continuant", "high": "high", "low": "low", "front": "front", "back": "back", "tense": "tense", "atr": "atr",
}
# Letters and their articulation; equal letters stand together.
_LETTERS = """
p=bilabial stop;b=bilabial stop voiced;t t͇=alveolar stop;d d͇=alveolar stop voiced;ʈ=retroflex stop;ɖ=retroflex stop voiced;t̠=postalveolar stop;d̠=postalveolar stop voiced;t̪=dental stop;d̪=dental stop voiced
p̪ p͆=labiodental stop;b̪ b͆=labiodental stop voiced;c=palatal stop;ɟ=palatal stop voiced;k=velar stop;ɡ g=velar stop voiced;q=uvular stop;ɢ=uvular stop voiced;ʡ=epiglottal stop;ʔ=glottal stop glottalized
m=bilabial nasal;ɱ m̪=labiodental nasal;n=alveolar nasal;n̪=dental nasal;ɳ=retroflex nasal;n̠ʲ=alveolopalatal nasal;ɲ ñ ɲ̟=palatal nasal;ŋ=velar nasal;ɴ=uvular nasal
ʙ=bilabial trill;r=alveolar trill;ʀ=uvular trill;ᴙ=epiglottal trill;ⱱ=labiodental tap;ⱱ̟ w̆ b̆=bilabial tap;ɾ ᴅ=alveolar tap;ɽ=retroflex tap;ɢ̆ ʀ̆=uvular tap;ʡ̯=epiglottal tap;ɺ=alveolar tap lateral;ɭ̆ ɺ˞ ɺ̢=retroflex tap lateral;ʎ̯=palatal tap lateral;ʟ̆=velar tap lateral;ɽ͡r=retroflex trill
ɸ=bilabial fricative;β=bilabial fricative voiced;f=labiodental fricative;v=labiodental fricative voiced;θ s̄=dental fricative;ð=dental fricative voiced;θ̱ θ͇ ɹ̝̊=alveolar fricative;ð̠ ð͇ ɹ̝=alveolar fricative voiced
s s͇=alveolar sibilant;z z͇=alveolar sibilant voiced;s̪ s̟=dental sibilant;z̪ z̟=dental sibilant voiced;ʃ ʃʲ š=palatoalveolar sibilant;ʒ ʒʲ ž=palatoalveolar sibilant voiced;ɹ̠̊˔=postalveolar fricative;ɹ̠˔=postalveolar fricative voiced;ʂ=retroflex sibilant;ʐ=retroflex sibilant voiced;ɕ=alveolopalatal sibilant;ʑ=alveolopalatal sibilant voiced;ɧ=coronal sibilant dark
ç=palatal fricative;ʝ=palatal fricative voiced;x=velar fricative;ɣ=velar fricative voiced;χ x̣=uvular fricative;ʁ ʁ̝=uvular fricative voiced;ħ=pharyngeal fricative;ʕ ʕ̝=pharyngeal fricative voiced;ʜ=epiglottal fricative;ʢ ʢ̝=epiglottal fricative voiced;h=glottal fricative aspirated;ɦ=glottal fricative aspirated voiced
ɬ=alveolar fricative lateral aspirated;ɮ=alveolar fricative lateral voiced;ꞎ=retroflex fricative lateral aspirated;ʎ̝̊=palatal fricative lateral;ʟ̝̊=velar fricative lateral;ʟ̝=velar fricative lateral voiced
β̞=bilabial approximant;ʋ=labiodental approximant;ð̞=dental approximant;ɹ ð̠˕=alveolar approximant;ɻ=retroflex approximant;ʁ̞=uvular approximant;ʕ̞ ɑ̯=pharyngeal approximant;ʢ̞=epiglottal approximant
l=alveolar approximant lateral;l̠=postalveolar approximant lateral;l̪=dental approximant lateral;ɭ=retroflex approximant lateral;l̠ʲ=alveolopalatal approximant lateral;ʎ ʎ̟=palatal approximant lateral;ʟ=velar approximant lateral;ɫ lˠ lˤ l̴=alveolar approximant lateral dark;ɫ̪ l̪ˠ l̪ˤ l̴̪=dental approximant lateral dark
j i̯=palatal glide;ɰ ɣ̞ ɣ˕=velar glide;w u̯ ɰʷ=velar glide rounded;ɰᵝ wᵝ=velar glide compressed;ɥ jʷ=palatal glide rounded
k͡p k͜p=labiovelar stop;ɡ͡b=labiovelar stop voiced;kʷ k͡w k͜w=velar stop rounded;kʷh=velar stop rounded aspirated;gʷ g͡w=velar stop rounded voiced;gʷh=velar stop rounded voiced aspirated
ɓ=bilabial stop implosive voiced;ɗ=alveolar stop implosive voiced;ᶑ=retroflex stop implosive voiced;ʄ=palatal stop implosive voiced;ɠ=velar stop implosive voiced;ʛ=uvular stop implosive voiced;ɓ̥ ƥ pʼ↓=bilabial stop implosive;ɗ̥ ƭ tʼ↓=alveolar stop implosive;ʄ̊ ƈ cʼ↓=palatal stop implosive
i=vowel high front tense atr;y=vowel high front tense atr rounded;ɪ ɩ=vowel high front;ʏ=vowel high front rounded;ɨ ï=vowel high tense atr;ʉ ü=vowel high tense atr rounded;ɯ=vowel high back tense;u=vowel high back tense atr rounded;ʊ ɷ ᴜ=vowel high back rounded;ɯ̽=vowel high back
ɪ̟=vowel high front atr;ʏ̟=vowel high front atr rounded;ɪ̈ ɨ̞ ɘ̝=vowel high atr;ʊ̈ ʉ̞=vowel high atr rounded
e=vowel front tense atr;ø=vowel front tense atr rounded;ɛ=vowel front;œ=vowel front rounded;ɘ ë=vowel tense atr;ɵ ö=vowel tense atr rounded;ɜ ɛ̈=vowel atr;ɞ ɔ̈=vowel atr rounded;ɤ=vowel back tense atr;o=vowel back tense atr rounded;ʌ=vowel back;ɔ=vowel back rounded
e̞ ɛ̝=vowel front tense;ø̞ œ̝=vowel front tense rounded;ɤ̞ ʌ̝=vowel back tense;o̞ ɔ̝=vowel back tense rounded;ɘ̞=vowel tense;ə̹ ɵ̞ ɞ̝=vowel tense rounded;ə=vowel tense ±round
æ=vowel low front tense;a a̟ æ̞=vowel low front;ɶ=vowel low front rounded;ä a̠ ɑ̈ ɐ̞=vowel low;ɑ=vowel low back;ɒ=vowel low back rounded;ɜ̞=vowel low tense;ɞ̞=vowel low tense rounded;ɐ=vowel low tense ±round
y̫ yʷ iʷ=vowel high front tense atr protruded;ʏ̫ ʏʷ ɪʷ=vowel high front protruded;ø̫ øʷ eʷ=vowel front tense atr protruded;u͍ ɯᵝ ɯ͡β̞=vowel high back tense atr compressed;ʉ͍ ɨᵝ ɨ͡β̞=vowel high tense atr compressed
"""
# Letters with a ring are voiceless; approximants that have no voice.
_VOICELESS = "m n n̪ ɳ ɲ ŋ l r ʀ j w ɾ ᴅ".split()
_NO_VOICE = {"ɸ̞": "bilabial approximant", "χ̞": "uvular approximant", "ħ̞": "pharyngeal approximant", "ʍ": "velar glide rounded"}
# Stops and what they are released into, with single letters for the pairs, and the pairs' features where the fricative alone does not tell them.
_AFFRICATES = """
t ʃ ʧ č;d ʒ ʤ ǯ;t̠ʲ ʃ;d̠ʲ ʒ;t s ʦ;d z ʣ;t̪ s̪ ʦ̪;t s̪;t̟ s̟ ʦ̟;t s̟;d̪ z̪ ʣ̪;d z̪;d̟ z̟ ʣ̟;d z̟;t θ̱;t θ͇;t θ;t̪ θ;t̟ θ;d ð̠;d ð͇;d ð;d̪ ð;d̟ ð;k x;ɡ ɣ;g ɣ;p f;p̪ f;b v;b̪ v
t ɕ ʨ;d ʑ ʥ;ʈ ʂ;t ʂ;ɖ ʐ;d ʐ;t ɬ ƛ;d ɮ;c ç;ɟ ʝ;c ʎ̝̊;k ʟ̝̊;ɡ ʟ̝;q χ;ɢ ʁ
"""
# Clicks with their place, and what stands before and after them.
_CLICKS = {"ʘ": "bilabial", "ǀ": "dental", "ʇ": "dental", "ǃ": "postalveolar", "ʗ": "alveolar", "ǂ": "palatal", "ǁ": "alveolar lateral", "ʖ": "alveolar lateral", "‼": "retroflex", "!!": "retroflex", "ǃ˞": "retroflex", "ǃǁ": "retroflex"}
_CLICK_MARKS = [("", "", ""), ("", "ʰ", "aspirated"), ("", "̬", "voiced"), ("ᶢ", "", "voiced"), ("", "̃", "nasalized"), ("ᵑ", "", "nasalized"), ("", "̥̃ʰ", "aspirated +nasal"), ("ᵑ̊", "ʰ", "aspirated +nasal"), ("", "̃ˀ", "glottalized +nasal"), ("ᵑ", "ˀ", "glottalized +nasal"), ("ᵑ̊", "ˀ", "glottalized +nasal"), ("ᵑ", "͡ʔ", "glottalized +nasal")]
# What marks alone have, lack, and have both ways.
_MARKS = {
    "ʰ": "+spread_glottis", "ʱ": "+voice +spread_glottis", "̤": "+voice +spread_glottis", "ʼ": "+constricted_glottis", "̚": "-spread_glottis", "̬": "+voice", "̌": "+voice", "̥": "-voice", "̊": "-voice",
    "ʷ": "+labial +round ±protruded ±compressed ±labiodental", "ʲ": "+dorsal +high ±low ±front ±back ±tense", "̰": "+voice +constricted_glottis", "̩": "+syllabic", "̯": "-syllabic", "̃": "+nasal", "̨": "+nasal", "͊": "-nasal",
    "ˠ": "+dorsal +high -low ±front +back ±tense", "̴": "+dorsal +high -low ±front +back ±tense", "ˤ": "+pharyngeal ±atr ±rtr", "̘": "+pharyngeal +atr -rtr", "̙": "+pharyngeal -atr +rtr", "˭": "-voice -spread_glottis -constricted_glottis -nasal",
}
_BITS = {"0": 0, "+": 1, "-": 2, "±": 3}


def _bundle(signs: dict[str, str]) -> int:
    return sum(_BITS[sign] << 2 * (len(FEATURES) - 1 - FEATURES.index(name)) for name, sign in signs.items())


def _signs(articulation: str) -> dict[str, str]:
    """The sign of every feature."""
    signs = dict.fromkeys(FEATURES, "-")
    for word in articulation.split():
        if word[0] in "+-±":
            signs[word[1:]] = word[0]
        else:
            signs |= dict.fromkeys(_TERMS.get(word, word).split(), "+")
    for articulator, dependent in _NEEDS.items():
        if signs[articulator] == "-":
            signs |= dict.fromkeys(dependent.split(), "0")
    return signs


def _symbols() -> dict[str, int]:
    said = {letter: what for row in _LETTERS.replace("\n", ";").split(";") if row for names, what in [row.split("=")] for letter in names.split()}
    said |= {letter + ring: f"{said[letter]} -voice" for letter in _VOICELESS for ring in ("̥", "̊")}
    said |= {letter: f"{what} -voice" for letter, what in _NO_VOICE.items()}
    for row in filter(None, _AFFRICATES.replace("\n", ";").split(";")):
        stop, end, *single = row.split()
        both = " ±labiodental" if stop in ("p", "b") else ""
        said |= dict.fromkeys([*single, stop + "͡" + end, stop + "͜" + end], f"{said[end]} ±continuant +delayed_release{both}")
    said |= {before + click + after: f"{place} click {what}" for click, place in _CLICKS.items() for before, after, what in _CLICK_MARKS}
    marks = {mark: _bundle({w[1:]: w[0] for w in what.split()}) for mark, what in _MARKS.items()}
    return {normalize("NFD", s): n for s, n in [*marks.items(), *((s, _bundle(_signs(what))) for s, what in said.items())]}


SYMBOLS = _symbols()
_LONGEST = max(map(len, SYMBOLS))


def ipa_to_features(ipa: str) -> list[int]:
    """A bundle for each phone, the longest symbol first; -1 for a character that starts none."""
    ipa, at, out = normalize("NFD", ipa.lower()), 0, []
    while at < len(ipa):
        size = next((n for n in range(_LONGEST, 0, -1) if ipa[at : at + n] in SYMBOLS and at + n <= len(ipa)), 0)
        out.append(SYMBOLS[ipa[at : at + size]] if size else -1)
        at += size or 1
    return out


def features(c: Column) -> Column:
    """The bundles of an IPA string."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else ipa_to_features(x)), "array<bigint>")(c)


def _bits(bundle: Column, feature: str) -> Column:
    if feature not in FEATURES:
        raise AttributeError(f"no such feature: {feature}")
    return F.shiftright(bundle, 2 * (len(FEATURES) - 1 - FEATURES.index(feature))).bitwiseAND(3)


def feature(bundles: Column, name: str) -> Column:
    """The named feature of each bundle: 1 had, -1 lacked, 0 not applying, 2 both, NaN of an unknown phone."""
    return F.transform(bundles, lambda b: F.when(b < 0, float("nan")).otherwise(F.element_at(F.array(*map(F.lit, (0.0, 1.0, -1.0, 2.0))), (_bits(b, name) + 1).cast("int"))))


def feature_maps(bundles: Column) -> Column:
    """For each bundle a map from features to 0, +, - or +/-; an unknown phone has an empty one."""
    signs = F.array(*map(F.lit, ("0", "+", "-", "+/-")))

    def signed(b: Column) -> Column:
        full = F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*(F.element_at(signs, (_bits(b, f) + 1).cast("int")) for f in FEATURES)))
        return F.when(b < 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(full)

    return F.transform(bundles, signed)


def _weights(weights: dict[str, float] | list[float] | tuple[float, ...] | None) -> list[float]:
    """Weights count from the last feature on; a map is laid out in the features' order first, and what is missing weighs nothing."""
    if weights is None:
        return [1.0] * len(FEATURES)
    if isinstance(weights, dict):
        return [float(weights.get(f, 0)) for f in FEATURES]
    if not isinstance(weights, (list, tuple)):
        raise TypeError("weights are a map or a list")
    return [*map(float, weights), *[0.0] * (len(FEATURES) - len(weights))]


def cmp_features(a: int, b: int, weights=None) -> float:
    """1 less the weight of differing bits in all weight; 0 with an unknown phone."""
    if a < 0 or b < 0:
        return 0.0
    if a == b:
        return 1.0
    weigh = _weights(weights)
    differ = a ^ b
    return 1 - sum(w * (differ >> 2 * i & 3).bit_count() for i, w in enumerate(weigh)) / (2 * sum(weigh))


def likeness(a: Column, b: Column) -> Column:
    """cmp_features of two bundle columns, all features weighing the same."""
    return F.when((a < 0) | (b < 0), 0.0).otherwise(1 - F.bit_count(a.bitwiseXOR(b)) / (2.0 * len(FEATURES)))


def phonetic_edit_distance(a: str, b: str, cost: tuple[float, float, float, float] = (1, 1, 1, 0.33333), swap: bool = False, weights=None) -> float:
    """Edit distance of the phones; a substitution costs what the bundles differ, and with `swap` neighbours change places for the fourth cost."""
    insert, delete, substitute, exchange = cost
    x, y = ipa_to_features(a), ipa_to_features(b)
    before, last = [], [j * insert for j in range(len(y) + 1)]
    for i, p in enumerate(x, 1):
        row = [i * delete]
        for j, q in enumerate(y, 1):
            row.append(min(row[-1] + insert, last[j] + delete, last[j - 1] + (substitute * (1 - cmp_features(p, q, weights)) if p != q else 0)))
            if swap and i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                row[-1] = min(row[-1], before[j - 2] + exchange)
        before, last = last, row
    return float(last[-1])


def phonetic_edit(a: str, b: str, cost: tuple[float, float, float, float] = (1, 1, 1, 0.33333), swap: bool = False, weights=None) -> float:
    """1 less the distance over that of the costlier side from nothing."""
    if a == b:
        return 1.0
    return 1 - phonetic_edit_distance(a, b, cost, swap, weights) / max(len(a) * cost[1], len(b) * cost[0])


# The weights of ALINE's feature values, the salience of features, and the features that count among vowels and elsewhere.
_VALUES = {
    "bilabial": 1.0, "labiodental": 0.95, "dental": 0.9, "alveolar": 0.85, "retroflex": 0.8, "palato-alveolar": 0.75, "palatal": 0.7, "velar": 0.6, "uvular": 0.5, "pharyngeal": 0.3, "glottal": 0.1,
    "stop": 1.0, "affricate": 0.9, "fricative": 0.8, "approximant": 0.6, "trill": 0.55, "tap": 0.5, "high": 1.0, "mid": 0.5, "low": 0.0, "front": 1.0, "central": 0.5, "back": 0.0,
}
_VOWEL_MANNER = {"high": 0.4, "mid": 0.2, "low": 0.0}
_SALIENCE = {"syllabic": 5, "voice": 10, "lateral": 10, "high": 5, "manner": 50, "long": 1, "place": 40, "nasal": 10, "aspirated": 5, "back": 5, "retroflex": 10, "round": 5}
_VOWEL_FEATURES = "syllabic nasal retroflex high back round long".split()
_OTHER_FEATURES = "syllabic manner voice nasal retroflex lateral aspirated place".split()
# The letters of ALINE's own alphabet and of IPA: place, manner and further features of consonants; height, backness and further features of vowels; what modifiers set.
_ALINE_LETTERS = """
b bilabial stop voice;c alveolar affricate;d alveolar stop voice;f labiodental fricative;g velar stop voice;h glottal fricative;j alveolar affricate voice;k velar stop;l alveolar approximant voice lateral;m bilabial stop voice nasal;n alveolar stop voice nasal
p bilabial stop;q glottal stop;r retroflex approximant voice retroflex;s alveolar fricative;t alveolar stop;v labiodental fricative syllabic voice;x velar fricative;z alveolar fricative voice
"""
_ALINE_VOWELS = "a low central velar;e mid front palatal;i high front palatal round;o mid back velar round;u high back velar round;w high back velar round;y high front velar"
_ALINE_MODIFIERS = {"A": ("aspirated", 1.0), "B": ("back", 0.0), "C": ("back", 0.5), "D": ("place", 0.9), "F": ("back", 1.0), "H": ("long", 1.0), "N": ("nasal", 1.0), "P": ("place", 0.7), "R": ("round", 1.0), "S": ("manner", 0.8), "V": ("place", 0.75)}
_IPA_LETTERS = """
p bilabial stop;b bilabial stop voice;t alveolar stop;d alveolar stop voice;ʈ retroflex stop retroflex;ɖ retroflex stop voice retroflex;c palatal stop;ɟ palatal stop voice;k velar stop;g velar stop voice;q uvular stop;ɢ uvular stop voice;ʔ glottal stop
m bilabial stop voice nasal;ɱ labiodental stop voice nasal;n alveolar stop voice nasal;ɳ retroflex stop voice nasal retroflex;ɲ palatal stop voice nasal;ŋ velar stop voice nasal;ɴ uvular stop voice nasal
ʙ bilabial trill voice;r alveolar trill voice retroflex;ʀ uvular trill voice;ɾ alveolar tap voice;ɽ retroflex tap voice retroflex
ɸ bilabial fricative;β bilabial fricative voice;f labiodental fricative;v labiodental fricative voice;θ dental fricative;ð dental fricative voice;s alveolar fricative;z alveolar fricative voice;ʃ palato-alveolar fricative;ʒ palato-alveolar fricative voice
ʂ retroflex fricative retroflex;ʐ retroflex fricative voice retroflex;ç palatal fricative;ʝ palatal fricative voice;x velar fricative;ɣ velar fricative voice;χ uvular fricative;ʁ uvular fricative voice;ħ pharyngeal fricative;ʕ pharyngeal fricative voice
h glottal fricative;ɦ glottal fricative voice;ɬ alveolar fricative lateral;ɮ alveolar fricative voice lateral
ʋ labiodental approximant voice;ɹ alveolar approximant voice;ɻ retroflex approximant voice retroflex;j palatal approximant voice;ɰ velar approximant voice;l alveolar approximant voice lateral;w velar approximant voice
"""
_IPA_VOWELS = "i high front;y high front round;e mid front;ø mid front round;ɛ mid front;œ mid front round;æ low front;a low front;ɨ high central;ʉ high central round;ə mid central;u high back round;o mid back round;ɔ mid back round;ɒ low back"
_IPA_MODIFIERS = {"ː": ("long", 1.0), "ʰ": ("aspirated", 1.0)}


def _alphabet(consonants: str, vowels: str) -> dict[str, dict[str, float]]:
    known = {}
    for letter, place, manner, *more in (row.split() for row in consonants.replace("\n", ";").split(";") if row):
        known[letter] = {"place": _VALUES[place], "manner": _VALUES[manner], **dict.fromkeys(more, 1.0)}
    for letter, height, depth, *more in map(str.split, vowels.split(";")):
        place = {"place": _VALUES[w] for w in more if w in _VALUES}
        known[letter] = {"manner": _VOWEL_MANNER[height], "high": _VALUES[height], "back": _VALUES[depth], "syllabic": 1.0, "voice": 1.0, **place, **{w: 1.0 for w in more if w not in _VALUES}}
    return known


_ALPHABETS = {"aline": (_alphabet(_ALINE_LETTERS, _ALINE_VOWELS), _ALINE_MODIFIERS), "ipa": (_alphabet(_IPA_LETTERS, _IPA_VOWELS), _IPA_MODIFIERS)}


class Aline:
    """ALINE: alignment of phones that are skipped, substituted, or answered by two; `mode` is local, global, half-local or semi-global, `phones` aline or ipa.

    Characters of neither alphabet are passed over, as are modifiers before any letter.
    """

    def __init__(self, skip: float = -10, substitute: float = 35, expand: float = 45, vowel: float = 10, mode: str = "local", phones: str = "aline", normalizer: Callable = max):
        self.skip, self.substitute, self.expand, self.vowel, self.mode, self.normalizer = skip, substitute, expand, vowel, mode, normalizer
        self.letters, self.modifiers = _ALPHABETS[phones]
        self._known_apart = edits.remembered(lambda p, q: self._apart(*(self.phones(x)[1][0] for x in (p, q))))

    def phones(self, text: str) -> tuple[list[str], list[dict[str, float]]]:
        names, bundles = [], []
        for x in text:
            if x in self.letters:
                names.append(x)
                bundles.append(dict(self.letters[x]))
            elif x in self.modifiers and names:
                names[-1] += x
                bundles[-1].update([self.modifiers[x]])
        return names, bundles

    def _apart(self, p: dict[str, float], q: dict[str, float]) -> float:
        counted = _OTHER_FEATURES if max(p["manner"], q["manner"]) > 0.4 else _VOWEL_FEATURES
        return sum(abs(p.get(f, 0.0) - q.get(f, 0.0)) * _SALIENCE[f] for f in counted)

    def _extra(self, p: dict[str, float]) -> float:
        return 0.0 if p["manner"] > 0.4 else self.vowel

    def _match(self, one: dict[str, float], many: list[dict[str, float]]) -> float:
        base = self.substitute if len(many) == 1 else self.expand
        return base - sum(self._apart(one, m) for m in many) - self._extra(one) - max(map(self._extra, many))

    def _moves(self, x: list[dict[str, float]], y: list[dict[str, float]], i: int, j: int) -> Iterator[tuple[int, int, float]]:
        """The ways into (i, j): phones taken of each side, and their score."""
        if i and j:
            yield 1, 1, self._match(x[i - 1], [y[j - 1]])
        if j:
            yield 0, 1, self.skip
        if i and j > 1:
            yield 1, 2, self._match(x[i - 1], y[j - 2 : j])
        if i:
            yield 1, 0, self.skip
        if i > 1 and j:
            yield 2, 1, self._match(y[j - 1], x[i - 2 : i])

    def _table(self, m: list[str], x: list, n: list[str], y: list) -> tuple[list[list[float]], float]:
        """The best scores by `_moves` of all (i, j), and the best of all; how far two phones are apart is remembered by their names."""
        free, skip = 0.0 if self.mode in ("local", "half-local") else -math.inf, self.skip
        extra, extra_ = [self._extra(p) for p in x], [self._extra(q) for q in y]
        s = [[j * skip if self.mode == "global" else 0.0 for j in range(len(y) + 1)]]
        before = apart = []
        for i, p in enumerate(m):
            above, apart = apart, [self._known_apart(p, q) for q in n]
            last, mine = s[-1], extra[i]
            larger = max(extra[i - 1], mine) if i else 0.0
            row = [(i + 1) * skip if self.mode == "global" else 0.0]
            for j, off in enumerate(apart):
                other = extra_[j]
                best = max(free, last[j] + (self.substitute - off - mine - other), row[j] + skip, last[j + 1] + skip)
                if j and (found := last[j - 1] + (self.expand - (apart[j - 1] + off) - mine - max(extra_[j - 1], other))) > best:
                    best = found
                if i and (found := before[j] + (self.expand - (above[j] + off) - other - larger)) > best:
                    best = found
                row.append(best)
            before = last
            s.append(row)
        return s, s[-1][-1] if self.mode in ("global", "half-local") else max(map(max, s))

    def score(self, a: str, b: str) -> float:
        if not a and not b:
            return 1.0
        return self._table(*self.phones(a), *self.phones(b))[1]

    def similarity(self, a: str, b: str, own: Callable[[str], float] | None = None) -> float:
        """`own` may give the score of a text with itself, where that is known."""
        own = own or (lambda text: self.score(text, text))
        found = self.score(a, b)
        return found / self.normalizer([own(a), own(b)]) if found else 0.0

    def alignments(self, a: str, b: str, epsilon: float = 0.0) -> list[tuple[float, str, str]]:
        """(score, source, target) of the alignments within the part epsilon of the best, best first; meant for words, as their number grows exponentially."""
        (m, x), (n, y) = self.phones(a), self.phones(b)
        s, best = self._table(m, x, n, y)
        least = (1 - epsilon) * best
        out = []
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                ends = (i == len(x)) + (j == len(y))
                if s[i][j] < least or ends < {"global": 2, "half-local": 2, "semi-global": 1}.get(self.mode, 0):
                    continue
                todo: list[tuple[int, int, float, list[tuple[str, str]]]] = [(i, j, 0.0, [])]
                while todo:
                    p, q, score, pairs = todo.pop()
                    if s[p][q] == 0:
                        total = score + (p + q) * self.skip * (self.mode == "global")
                        out.append((total, *(self._line(names, start, end, [pair[side] for pair in pairs], [pair[1 - side] for pair in pairs]) for side, (names, start, end) in enumerate(((m, p, i), (n, q, j))))))
                        continue
                    ways = [(di, dj, more) for di, dj, more in self._moves(x, y, p, q) if s[p - di][q - dj] + more + score >= least]
                    for di, dj, more in reversed(ways):
                        pair = ("".join(m[p - di : p]) or "-", "".join(n[q - dj : q]) or "-")
                        todo.append((p - di, q - dj, score + more, [pair, *pairs]))
        return sorted(out, key=lambda found: -found[0])

    @staticmethod
    def _line(names: list[str], start: int, end: int, mine: list[str], other: list[str]) -> str:
        middle = " ".join(u.ljust(len(v)) for u, v in zip(mine, other))
        return " ‖ ".join(("".join(names[:start]), middle, "".join(names[end:]))).strip()


_ALINE = Aline()
_own_score = edits.remembered(lambda text: _ALINE.score(text, text))


def aline(a: str, b: str) -> float:
    """Similarity of lower-cased words in ALINE's alphabet."""
    return _ALINE.similarity(a.lower(), b.lower(), _own_score)


KERNELS = {"aline": aline, "phonetic_edit": phonetic_edit}
NAMES = sorted(KERNELS)


def similarity(name: str, src: Column, tar: Column) -> Column:
    return edits.vectorised(KERNELS[name])(src, tar)


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = measures.pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"), dealt=True)
        return pairs.select("id", "src", "tar", F.round(similarity(name, F.col("src"), F.col("tar")), 9).alias("sim"))

    return run


def words_query(spark, sf_dir: str) -> DataFrame:
    """Bundles of the words of documents, read as IPA: their number, how many are known, nasal and syllabic phones, and how alike the first and last are."""
    words = codes.words_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("phones", features(F.col("word")))
    of = {name: F.size(F.filter(feature(F.col("phones"), name), lambda v: v == 1)).alias(name) for name in ("nasal", "syllabic")}
    ends = F.round(likeness(F.element_at("phones", 1), F.element_at("phones", -1)), 9).alias("ends")
    signs = F.array_join(F.transform(feature_maps(F.col("phones")), lambda m: F.coalesce(m["voice"], F.lit("?"))), "").alias("voices")
    return words.select("word", F.size("phones").alias("n"), F.size(F.filter("phones", lambda b: b >= 0)).alias("known"), *of.values(), ends, signs)
