"""Phonetic codes, stemmers and fingerprints of words, as steps of SQL expressions.

A code is a list of steps; a step gives new values to w (the word so far) and f (what is set
aside). Spark runs the steps as columns, all inside one compiled stage; the same steps make DuckDB SQL. Only two things are
spelled differently: squeezing repeated letters and deleting what matches a pattern.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Accented Latin letters and their base letters, by Unicode decomposition.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].upper() in AZ and len(unicodedata.normalize("NFKD", chr(c))) > 1]
ACCENTS = "".join(_ACCENTED), "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)
#: The commonest letters of English, the most frequent first (fixed value).
COMMON = "etaoinshrdlcumwf"


def drop(pattern: str, x: str = "w") -> str:
    return f"DROP({x}~{pattern})"


def squeeze(x: str = "w") -> str:
    return f"SQUEEZE({x})"


def letters(keep: str = "A-Z") -> dict[str, str]:
    return {"w": drop(f"[^{keep}]", f"translate(upper(replace(w, 'ß', 'ss')), '{ACCENTS[0]}', upper('{ACCENTS[1]}'))")}


def table(source: str, target: str, x: str = "w") -> str:
    return f"translate({x}, '{source}', '{target}')"


REST = "substr(w, 2)"
FIRST = "substr(w, 1, 1)"
#: Steps of each code; the digits are the published code tables (fixed values).
STEPS: dict[str, list[dict[str, str]]] = {
    "soundex": [letters(), {"f": FIRST, "w": f"replace({table(AZ, '01230129022455012623019202')}, '9', '')"}, {"w": squeeze()}, {"w": "case when f = '' then '0000' else rpad(f || replace(case when f in ('H', 'W') then w else substr(w, 2) end, '0', ''), 4, '0') end"}],
    "refined_soundex": [letters(), {"w": f"{FIRST} || {table(AZ, '01360240043788015936020505', REST)}"}, {"w": squeeze()}, {"w": "replace(w, '0', '')"}],
    "lein": [letters(), {"f": FIRST, "w": drop("[AEHIOUWY]", REST)}, {"w": squeeze()}, {"w": f"rpad(f || {table('BCDFGJKLMNPQRSTVXZ', '451455532245351455')}, 4, '0')"}],
    "mra": [{"w": "upper(replace(w, 'ß', 'ss'))"}, {"w": f"{FIRST} || {drop('[AEIOU]', REST)}"}, {"w": squeeze()}, {"w": "case when length(w) > 6 then substr(w, 1, 3) || substr(w, length(w) - 2, 3) else w end"}],
    "statistics_canada": [letters(), {"w": f"{FIRST} || {drop('[AEIOUY]', REST)}"}, {"w": squeeze()}, {"w": "substr(w, 1, 4)"}],
    "russell_index": [{"w": "replace(upper(replace(w, 'ß', 'ss')), 'GH', '')"}, {"w": drop("[SZ]+$")}, letters("ABCDEFGIKLMNOPQRSTUVXYZ"), {"w": table("ABCDEFGIKLMNOPQRSTUVXYZ", "12341231356712383412313")}, {"w": "case when instr(w, '1') > 0 then substr(w, 1, instr(w, '1')) || replace(substr(w, instr(w, '1') + 1), '1', '') else w end"}, {"w": squeeze()}],
    "phonetic_spanish": [letters("BCDFGHJKLMNPQRSTVXYZ"), {"w": "replace(w, 'LL', 'L')"}, {"w": table("BCDFGHJKLMNPQRSTVXYZ", "14328287566079431454")}],
    "soundex_br": [letters(), {"f": "case when substr(w, 1, 2) = 'WA' then 'V' when substr(w, 1, 2) in ('KA', 'KO', 'KU') then 'C' when substr(w, 1, 2) in ('CI', 'CE') then 'S' when substr(w, 1, 2) in ('GE', 'GI') then 'J' when substr(w, 1, 1) = 'Y' then 'I' when substr(w, 1, 1) = 'H' then substr(w, 2, 1) else substr(w, 1, 1) end", "w": "case when substr(w, 1, 1) = 'H' then substr(w, 3) else substr(w, 2) end"}, {"w": f"f || {table(AZ, '01230120022455012623010202')}"}, {"w": squeeze()}, {"w": "rpad(replace(w, '0', ''), 4, '0')"}],
    "sound_d": [letters(), {"w": "case when substr(w, 1, 2) in ('KN', 'GN', 'PN', 'AC', 'WR') then substr(w, 2) when substr(w, 1, 1) = 'X' then 'S' || substr(w, 2) when substr(w, 1, 2) = 'WH' then 'W' || substr(w, 3) else w end"}, {"w": "replace(replace(replace(w, 'DGE', '20'), 'DGI', '20'), 'GH', '0')"}, {"w": table(AZ, "01230120022455012623010202")}, {"w": squeeze()}, {"w": "rpad(replace(w, '0', ''), 4, '0')"}],
    "davidson": [{"w": "upper(replace(w, 'ß', 'ss'))"}, {"w": f"{FIRST} || {drop('[AEIOUHWY]', REST)}"}, {"w": squeeze()}, {"w": "rpad(w, 4, ' ') || '.'"}],
    "s_stemmer": [{"f": "lower(w)"}, {"w": "case when f like '%ies' and f not like '%eies' and f not like '%aies' then substr(w, 1, length(w) - 3) || case when w like '%S' then 'Y' else 'y' end when f like '%es' and f not like '%aes' and f not like '%ees' and f not like '%oes' then substr(w, 1, length(w) - 1) when f like '%s' and f not like '%us' and f not like '%ss' then substr(w, 1, length(w) - 1) else w end"}],
    "clef_german": [{"w": "translate(lower(w), 'äöü', 'aou')"}, {"w": "case when length(w) > 6 and w like '%nen' then substr(w, 1, length(w) - 3) when length(w) > 5 and (w like '%en' or w like '%se' or w like '%es' or w like '%er') then substr(w, 1, length(w) - 2) when length(w) > 4 and (w like '%e' or w like '%n' or w like '%r' or w like '%s') then substr(w, 1, length(w) - 1) else w end"}],
    "clef_german_plus": [
        {"w": "translate(lower(w), 'äàáâöòóôïìíîüùúû', 'aaaaooooiiiiuuuu')"},
        {"w": "case when length(w) > 5 and w like '%ern' then substr(w, 1, length(w) - 3) when length(w) > 4 and (w like '%em' or w like '%en' or w like '%er' or w like '%es') then substr(w, 1, length(w) - 2) when length(w) > 3 and (w like '%e' or (w like '%s' and instr('bdfghklmnt', substr(w, length(w) - 1, 1)) > 0)) then substr(w, 1, length(w) - 1) else w end"},
        {"w": "case when length(w) > 5 and w like '%est' then substr(w, 1, length(w) - 3) when length(w) > 4 and (w like '%er' or w like '%en' or (w like '%st' and instr('bdfghklmnt', substr(w, length(w) - 2, 1)) > 0)) then substr(w, 1, length(w) - 2) else w end"},
    ],
    "clef_swedish": [
        {"w": "case when length(w) > 4 and w like '%s' then substr(w, 1, length(w) - 1) else w end"},
        {"w": "case " + " ".join(f"when length(w) > {k + 2} and substr(w, length(w) - {k - 1}, {k}) in ({', '.join(repr(e) for e in ends)}) then substr(w, 1, length(w) - {k})" for k, ends in ((5, ("elser", "heten")), (4, ("arne", "erna", "ande", "else", "aste", "orna", "aren")), (3, ("are", "ast", "het")), (2, ("ar", "er", "or", "en", "at", "te", "et")), (1, ("a", "e", "n", "t")))) + " else w end"},
    ],
    "fp_consonant": [{"w": "upper(replace(w, 'ß', 'ss'))"}, {"w": f"{FIRST} || {drop('[AEIOU]', REST)}"}],
    "fp_omission_key": [letters(), {"f": "concat(" + ", ".join(f"case when instr(w, '{c}') > 0 then '{c}' else '' end" for c in "JKQXZVWYBFMGPDHCLNTSR") + ")", "w": drop("[JKQXZVWYBFMGPDHCLNTSR]")}, {"w": "f || UNIQUE(w)"}],
    "fp_skeleton_key": [letters(), {"f": FIRST, "w": f"replace({REST}, {FIRST}, '')"}, {"w": f"f || UNIQUE({drop('[AEIOU]')}) || UNIQUE({drop('[^AEIOU]')})"}],
    "fp_occurrence": [{"w": "concat(" + ", ".join(f"case when instr(w, '{c}') > 0 then '1' else '0' end" for c in COMMON) + ")"}],
    "fp_occurrence_halved": [{"f": "substr(w, 1, cast(floor(length(w)/2) as int))", "w": "substr(w, cast(floor(length(w)/2) as int) + 1)"}, {"w": "concat(" + ", ".join(f"case when instr(f, '{c}') > 0 then '1' else '0' end, case when instr(w, '{c}') > 0 then '1' else '0' end" for c in COMMON[:8]) + ")"}],
    "fp_count": [{"w": "concat(" + ", ".join(f"case (length(w) - length(replace(w, '{c}', '')))%4 when 0 then '00' when 1 then '01' when 2 then '10' else '11' end" for c in COMMON[:8]) + ")"}],
    "fp_position": [{"w": "concat(" + ", ".join("case " + f"case when instr(w, '{c}') = 0 then 7 else least(7, instr(w, '{c}') - 1) end " + " ".join(f"when {k} then '{k:03b}'" for k in range(8)) + " end" for c in COMMON[:5]) + f", case when instr(w, '{COMMON[5]}') = 1 then '0' else '1' end)"}],
}
NAMES = sorted(STEPS)


def _in_dialect(text: str, spark: bool) -> str:
    """Spells out DROP, SQUEEZE and UNIQUE, the innermost first."""
    for word in ("DROP", "SQUEEZE", "UNIQUE"):
        while (at := text.rfind(f"{word}(")) >= 0:
            start = end = at + len(word) + 1
            depth = 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            inner = text[start : end - 1]
            if word == "DROP":
                x, pattern = inner.rsplit("~", 1)
                new = f"regexp_replace({x}, '{pattern}', '')" if spark else f"regexp_replace({x}, '{pattern}', '', 'g')"
            elif word == "SQUEEZE":
                new = f"regexp_replace({inner}, '(.)\\\\1+', '$1')" if spark else f"array_to_string([substr({inner}, i, 1) for i in range(1, length({inner}) + 1) if i = 1 or substr({inner}, i, 1) <> substr({inner}, i - 1, 1)], '')"
            else:
                new = f"array_join(array_distinct(split({inner}, '')), '')" if spark else f"array_to_string([substr({inner}, i, 1) for i in range(1, length({inner}) + 1) if instr({inner}, substr({inner}, i, 1)) = i], '')"
            text = text[:at] + new + text[end:]
    return text


def with_code(df: DataFrame, name: str, word: str = "word", out: str = "code") -> DataFrame:
    """Adds the code of a string column; null gives null."""
    df = df.withColumn("w", F.col(word)).withColumn("f", F.lit(""))
    for step in STEPS[name]:
        df = df.withColumns({k: F.expr(_in_dialect(v, True)) for k, v in step.items()})
    return df.withColumn(out, F.col("w")).drop("w", "f")


def words_of_documents(documents: DataFrame) -> DataFrame:
    """The distinct words of all whole texts, letters of every script."""
    return documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("word")).distinct()


WORDS_SQL = "words as (select distinct unnest(regexp_extract_all(text, '\\p{L}+')) as word from documents)"


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return with_code(words_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), name)

    return run


def sql(name: str) -> str:
    inner = "select word, word as w, '' as f from words"
    for step in STEPS[name]:
        inner = f"select word, {', '.join(f'{_in_dialect(step.get(k, k), False)} as {k}' for k in ('w', 'f'))} from ({inner})"
    return f"with {WORDS_SQL} select word, w as code from ({inner})"
