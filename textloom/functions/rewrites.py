"""Codes by ordered rewriting: published rules as (pattern, replacement) lists, and word kernels where state runs along the word.

The rule lists are chains of regexp_replace, compiled by Spark; kernels run as Arrow-vectorised UDFs over distinct words of a batch.
"""

from __future__ import annotations

import re
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codes, edits, measures, metaphones, phonetics, stemmers

# The rules of Caverphone 2, in order.
_CAVERPHONE = [
    ("[^a-z]", ""), ("e$", ""), ("^(cou|rou|tou|enou|trou)gh", "$12f"), ("^gn", "2n"), ("mb$", "m2"),
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
    ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"),
    ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"),
    ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
]
# The rules of the Cologne code; x and y stand for an X after C, K or Q, and any other.
_KOELNER = [
    ("P(?=H)", "3"), ("[DT](?=[CSZ])", "8"), ("(?<=[CKQ])X", "x"), ("X", "y"), ("(?<=[SZ])C", "8"), ("^C(?=[AHKLOQRUxy])", "4"), ("^C", "8"), ("C(?=[AHKOQUxy])", "4"), ("C", "8"), ("H", ""), ("x", "8"), ("y", "48"),
    ("[AEIOUJY]", "0"), ("[BP]", "1"), ("[DT]", "2"), ("[FVW]", "3"), ("[GKQ]", "4"), ("L", "5"), ("[MN]", "6"), ("R", "7"), ("[SZ]", "8"), (r"(.)\1+", "$1"), ("(?<!^)0", ""),
]
# Phonem's substitutions and letters.
_PHONEM = [("SC", "C"), ("SZ", "C"), ("CZ", "C"), ("TZ", "C"), ("TS", "C"), ("KS", "X"), ("PF", "V"), ("QU", "KW"), ("PH", "V"), ("UE", "Y"), ("AE", "E"), ("OE", "Ö"), ("EI", "AY"), ("EY", "AY"), ("EU", "OY"), ("AU", "A§"), ("OU", "§")]
_PHONEM_LETTERS = "ZKGQÇÑßFWPTÁÀÂÃÅÄÆÉÈÊËIJÌÍÎÏÜÝ§ÚÙÛÔÒÓÕØ", "CCCCCNSVVBDAAAAAEEEEEEYYYYYYYYUUUUOOOOÖ"


# Dolby's rules as published, in order: names in Mac, second letters of clusters, sounds, letters before K, doubles, PF and GH, then vowels.
_DOLBY = [
    ("^M(CG|AG|AC|C)", "MK"), ("(L)D[DT]*|(N)[DT]+|(R)[CDT]+|(S)[CKT]+|(D)T+", "$1$2$3$4$5"), ("X", "KS"), ("C(?=[EIY])", "S"), ("TCH", "CH"), ("(?<=[^AEIOUY])C(?=H)", "S"), ("C", "K"), ("Z", "S"), ("WR", "R"), ("DG", "G"), ("QU", "K"), ("T", "D"), ("PH", "F"),
    ("(?<=.)[^AEIOUYLNR](?=K)", ""), (r"(.)\1+", "$1"), ("^PF", "F"), ("PF$", "P"), ("(?<=[AEIOUY])GH$", "F"), ("GH$", "G"), ("GH", ""), ("^([^AEIOUY]*)[AEIOUY]", "$1*"), ("[AEIOUY]", ""), ("(?<!^)[WH]", ""),
]
# PSHP's rules for last names as published: beginnings, endings and clusters, with what German names have instead or do not have; digits of letters.
_PSHP_BEGIN = [("^V[AO]N", ""), ("^MA?C", "M"), ("^[EIOU]", "A"), ("^G(?=[EIY])", "J"), ("^C(?=[EIY])", "S"), ("^C(?!H)|^C(?=HR)", "K"), ("^KN", "NN"), ("^PH", "FH"), ("^W(?=IE|EI)", "V")]
_PSHP_BEGIN_GERMAN = [*(r for r in _PSHP_BEGIN if r[1] != "M"), ("^W", "V"), ("^M", "N"), ("^Y", "J"), ("^Z", "S")]
_PSHP_END = [("R$", "N"), ("[SC]E$", ""), ("SS?$", ""), ("STOWN$", "SAWON"), ("MPSON$", "MASON"), ("NSEN$", "ASEN"), ("MSON$", "ASON"), ("STEN$", "SAEN"), ("STON$", "SAON"), ("N[GD]$", "N"), ("G(?=[AE]N$)", "A")]
_PSHP_END_GERMAN = [("T(E|)S$", ""), ("TZE$|ZE$", ""), ("Z$|TE$", ""), *(r for r in _PSHP_END if r[0] in ("R$", "[SC]E$", "SS?$", "N[GD]$"))]
_PSHP_INNER = [("CK", "C"), ("SCH", "S"), ("DT", "T"), ("ND", "N"), ("NG", "N"), ("LM", "M"), ("MN", "M"), ("WIE", "VIE"), ("WEI", "VEI")]
_PSHP_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012523010202"


def _rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def caverphone(c: Column) -> Column:
    return F.rpad(_rewrite(F.lower(c), _CAVERPHONE), 10, "1")


def _az(c: Column) -> Column:
    """A-Z of the upper-cased string, accents dropped."""
    return F.regexp_replace(F.translate(F.upper(c), codes.ACCENTS[0], codes.ACCENTS[1].upper()), "[^A-Z]", "")


def koelner(c: Column) -> Column:
    return _rewrite(_az(c), _KOELNER)


def dolby(c: Column) -> Column:
    """Dolby's code of unlimited length; the first vowel is a star."""
    return _rewrite(_az(c), _DOLBY)


def pshp_last(c: Column, german: bool = False) -> Column:
    """PSHP code of a last name."""
    name = _rewrite(_az(c), _PSHP_BEGIN_GERMAN if german else _PSHP_BEGIN)
    digits = F.translate(_rewrite(name, [*(_PSHP_END_GERMAN if german else _PSHP_END), *_PSHP_INNER]), *_PSHP_LETTERS)
    rest = _rewrite(digits, [(r"(.)\1+", "$1"), ("^.", ""), ("0", "")])
    return F.rpad(F.concat(F.substring(name, 1, 1), rest), 4, "0")


def phonem(c: Column) -> Column:
    c = F.translate(_rewrite(F.upper(c), _PHONEM), *_PHONEM_LETTERS)
    return _rewrite(c, [(r"(.)\1+", "$1"), ("[^ABCDLMNORSUVWXYÖ]", "")])


_VOWELS = set("AEIOU")


def nysiis(word: str, length: int = 6) -> str:
    word = "".join(c for c in word.upper() if c.isalpha())
    if not word:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if word.startswith(old):
            word = new + word[len(old) :]
            break
    for ends, new in ((("EE", "IE"), "Y"), (("DT", "RT", "RD", "NT", "ND"), "D")):
        if word.endswith(ends):
            word = word[:-2] + new
            break
    done, rest = word[0], word[1:]  # done: the word as rewritten so far
    key = done
    while rest:
        for old, new in (("EV", "AF"), ("SCH", "SSS"), ("SH", "SS"), ("PH", "FF"), ("KN", "N")):
            if rest.startswith(old):
                break
        else:
            x, last = rest[0], done[-1]
            if x == "H" and (last not in _VOWELS or rest[1:2] not in _VOWELS) or x == "W" and last in _VOWELS:
                new = last
            else:
                new = "A" if x in _VOWELS else {"Q": "G", "Z": "S", "M": "N", "K": "C"}.get(x, x)
            old = x
        rest, done = rest[len(old) :], done + new
        if new != key[-1:]:
            key += new
    key = re.sub(r"(.)\1+", r"\1", key)
    key = re.sub("A$", "", re.sub("AY$", "Y", re.sub("S$", "", key)))
    return key[:length]


def soundex(word: str, length: int = 4, special: bool = False, backwards: bool = False) -> str:
    """Soundex; `special` lets H and W part equal digits."""
    word = "".join(c for c in normalize("NFKD", word.upper()) if c in codes.AZ)[:: -1 if backwards else 1]
    if not word:
        return "0" * length
    digits = re.sub(r"(.)\1+", r"\1", word.translate(str.maketrans(codes.AZ, "01230129022455012623019202")).replace("9", "0" if special else ""))
    return (word[0] + (digits if word[0] in "HW" and not special else digits[1:]).replace("0", "")).ljust(length, "0")[:length]


def soundex_census(word: str) -> str:
    """With a second code after a comma if the name has a prefix."""
    prefix = re.match("(VAN|CON)(?=..)|(DE|DI|LA|LE)(?=..)", word.upper())
    return soundex(word) + ("," + soundex(word[prefix.end() :]) if prefix else "")


# The first letter of a MetaSoundex code.
_META_SOUNDEX = str.maketrans(codes.AZ, "07430755015866075943077514")


def meta_soundex(word: str) -> str:
    code_ = soundex(phonetics.metaphone(word))
    return code_[0].translate(_META_SOUNDEX) + code_[1:]


def onca(word: str) -> str:
    return soundex(nysiis(word, 12))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or x == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


# Porter's suffixes and what replaces them.
_PORTER_2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
_PORTER_3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
_PORTER_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's stemmer of English."""
    word = word.lower()
    if len(word) < 3:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    fix = False
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        word, fix = word[:-2], True
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        word, fix = word[:-3], True
    if fix:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_PORTER_2, _PORTER_3):
        pairs = sorted(zip(table[::2], table[1::2]), key=lambda p: -len(p[0]))
        old, new = next((p for p in pairs if word.endswith(p[0])), ("", ""))
        if old and _measure(word[: -len(old)]) > 0:
            word = word[: -len(old)] + new.replace("-", "")
    for old in sorted(_PORTER_4, key=len, reverse=True):
        if word.endswith(old):
            cut = 3 if old in ("sion", "tion") else len(old)
            if _measure(word[:-cut]) > 1:
                word = word[:-cut]
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


# Fixed value: letters from the commonest on.
_COMMONEST = "ETAONRISHDLFCMUGYPWBVKXJQZ"


def extract(word: str) -> str:
    """The commonest letters go, from the end on, until four letters are left."""
    word = word.upper()
    for x in _COMMONEST:
        while len(word) > 4 and x in word:
            at = word.rindex(x)
            word = word[:at] + word[at + 1 :]
    return word


def run_length_decoded(code_: str) -> str:
    """The inverse of edits.run_length for texts without digits."""
    return re.sub(r"(\d+)(\D)", lambda m: int(m[1]) * m[2], code_)


def burrows_wheeler_decoded(code_: str, end: str = "\0") -> str:
    """The inverse of edits.burrows_wheeler."""
    if code_.count(end) != 1:
        raise ValueError("the end mark must occur once")
    order = sorted(range(len(code_)), key=lambda i: (code_[i], i))
    out, at = [], order[code_.index(end)]
    for _ in range(len(code_) - 1):
        out.append(code_[at])
        at = order[at]
    return "".join(out)


def string_fingerprint(c: Column, joiner: str = " ") -> Column:
    """Words of letters and digits, lower-cased and folded, sorted, each once."""
    kept = F.regexp_replace(F.translate(F.lower(F.trim(c)), *codes.ACCENTS), r"[^\p{L}\p{N}\s]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(kept, r"\s+"), lambda w: w != ""))), joiner)


def q_gram_fingerprint(c: Column, q: int = 2, joiner: str = "") -> Column:
    """Distinct q-grams of the letters and digits, sorted."""
    kept = F.regexp_replace(F.translate(F.lower(c), *codes.ACCENTS), r"[^\p{L}\p{N}]", "")
    return F.array_join(F.array_sort(F.array_distinct(measures.q_grams(kept, q, "", ""))), joiner)


def phonetic_fingerprint(c: Column, encoder: str = "double_metaphone", joiner: str = " ") -> Column:
    """The string fingerprint of the words' codes, the first code of each; one UDF call for a text."""
    fn = KERNELS[encoder]

    def batch(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        for word in {w for t in texts.dropna() for w in t.split()}:
            known[word] = (fn(word) or "").split(",")[0]
        return texts.map(lambda t: None if t is None else " ".join(known[w] for w in t.split()))

    return string_fingerprint(F.pandas_udf(batch, "string")(c), joiner)


KERNELS = {"nysiis": nysiis, "onca": onca, "porter": porter, "fp_extract": extract, "fp_bwtf": lambda w: edits.burrows_wheeler(w), "fp_bwtrlef": lambda w: edits.run_length(edits.burrows_wheeler(w)), "rle": edits.run_length, "ainsworth": metaphones.ainsworth, "double_metaphone": metaphones.double_metaphone, "meta_soundex": meta_soundex, "soundex_census": soundex_census, "soundex_special": lambda w: soundex(w, special=True), "soundex_reverse": lambda w: soundex(w, backwards=True), **stemmers.KERNELS, **phonetics.KERNELS}
COLUMNS = {"caverphone": caverphone, "dolby": dolby, "koelner": koelner, "phonem": phonem, "pshp_last": pshp_last, "fp_string": string_fingerprint, "fp_q_gram": q_gram_fingerprint}
NAMES = sorted({*KERNELS, *COLUMNS})


def code(name: str, c: Column) -> Column:
    """The named code of a string column; null gives null."""
    if name in COLUMNS:
        return COLUMNS[name](c)
    fn = KERNELS[name]
    known: dict[str, str | None] = {}  # lives as long as a task; emptied when it has grown

    def batch(words: pd.Series) -> pd.Series:
        if len(known) > 100_000:
            known.clear()
        for word in words.dropna().unique():
            if word not in known:
                known[word] = fn(word)
        return words.map(lambda w: known.get(w))

    return F.pandas_udf(batch, "string")(c)


# Letters for the digits of codes that begin with a letter, and of those that do not.
_ALPHA_REST = {
    "fuzzy_soundex": ("01345679", "APTLNRKS"), "lein": ("12345", "TNLPK"), "phonex": ("123456", "PSTLNR"), "phonix": ("012345678", "APKTLNRFS"), "pshp_last": ("12345", "PKTLN"), "refined_soundex": ("123456789", "PFKGZTLNR"),
    "sound_d": ("0123456", "APKTLNR"), "soundex": ("01234569", "APKTLNRH"), "soundex_br": ("0123456", "APKTLNR"),
}
_ALPHA_WHOLE = {"haase": ("123456789", "PTFKLNRSA"), "koelner": ("012345678", "APTFKLNRS"), "phonetic_spanish": ("0123456789", "PBFTSLNKGR"), "sfinx_bis": ("123456789#", "PKTLNRFSAŠ"), "double_metaphone": ("0", "Þ"), "dolby": ("*", "A")}


def alphabetic(name: str, c: Column) -> Column:
    """A code spelt with letters, from the code; codes that have no digits stay."""
    if name in _ALPHA_REST:
        c = F.regexp_replace(c, "0+$", "")
        return F.concat(F.substring(c, 1, 1), F.translate(F.substring(c, 2, 2**31 - 1), *_ALPHA_REST[name]))
    if name == "caverphone":
        return F.regexp_replace(c, "1+$", "")
    return F.translate(c, *_ALPHA_WHOLE[name]) if name in _ALPHA_WHOLE else c


def phonetic_similarity(src: Column, tar: Column, transforms: tuple[str, ...] = ("nysiis",), measure: str | None = None) -> Column:
    """The named measure of both strings' codes, one transform after the other; without a measure, whether the codes are equal."""
    for name in transforms:
        src, tar = code(name, src), code(name, tar)
    return edits.similarity(measure or "ident", src, tar)


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return codes.words_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("code", code(name, F.col("word")))

    return run


def sql(name: str) -> str:
    """The SQL of codes that need nothing DuckDB's patterns lack; the words are letters."""
    folded = f"translate(lower(word), '{codes.ACCENTS[0]}', '{codes.ACCENTS[1]}')"
    if name == "fp_string":
        return f"with {codes.WORDS_SQL} select word, {folded} as code from words"
    if name == "fp_q_gram":
        return f"with {codes.WORDS_SQL} select word, array_to_string(list_sort(list_distinct([substr({folded}, i, 2) for i in range(1, length({folded}))])), '') as code from words"
    if name == "fp_bwtf":
        turns = "list_sort([substr(word || chr(0), i, length(word) + 1) || substr(word, 1, i - 1) for i in range(1, length(word) + 2)])"
        return f"with {codes.WORDS_SQL} select word, array_to_string([right(t, 1) for t in {turns}], '') as code from words"
    text = "lower(word)"
    for pattern, new in _CAVERPHONE:
        text = f"regexp_replace({text}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return f"with {codes.WORDS_SQL} select word, rpad({text}, 10, '1') as code from words"


SQL = ["caverphone", "fp_string", "fp_q_gram", "fp_bwtf"]
