"""Double Metaphone and Ainsworth's pronunciation as tables: what a pattern matches is read, looking back and ahead as far as the pattern says.

A rule is (when, pattern, code); the first that fits at a place decides. The code `P/S` differs between the two readings
and `-` says nothing. `when` names a property that the whole word must have.
"""

from __future__ import annotations

import re
from functools import cache

from . import phonetics

# The rules; n: neither W, K nor CZ in the word, w: one of them, g: VAN, VON or SCH at its start, c: SCH at its start, m: MC at its start, s: SAN at its start, a: not DANGER, RANGER, MANGER at its start.
_TABLE = r"""
: ^(G(?=N)|K(?=N)|P(?=[NS])|W(?=R)) -
: ^X S
: ^[AEIOUY] A
: [AEIOUY] -
: BB? P
: Ç S
: (?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER) K
: ^CA(?=ESAR) S
: CH(?=IA) K
: (?<=.)CH(?=AE) K/X
: ^CH(?=ARAC|ARIS|OR(?!E)|YM|EM) K
g CH K
: (?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS])|(^|(?<=[AOUE]))CH(?=[LRNMBHFVW\s]|$) K
m (?<=.)CH K
: (?<=.)CH X/K
: CH X
: (?<!WI)CZ S/X
: CCI(?=A) X
: (?<=^A)CC([IE]|H(?!U))|(?<=U)CCE(?=[ES]) KS
: (?<!^M)CC([IE]|H(?!U)) X
: (?<!^M)CC|C[KGQ] K
: CI(?=[OEA]) S/X
: C[IEY] S
: C\s[CQG]|CC(?![EI])|C K
: DG[IEY] J
: DG TK
: D[TD]? T
: FF? F
: (?<=[^AEIOUY])GH K
: ^GH(?=I) J
: ^GH K
: (?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH -
: (?<=[CGLRT].U)GH F
: (?<=[^I])GH K
: GH -
n (?<=^[AEIOUY])GN KN/N
n GN(?!EY) N/KN
: GN KN
n GL(?=I) KL/L
: ^G(Y|E(?=[SPBLYIR])|I(?=[BLNE])) K/J
a (?<![EI])GE(?=R)|(?<![EIRO])GY K/J
g G[EIY]|(?<=[AO])GG(?=I) K
: GE(?=T) K
: GI(?=ER(\s|$)) J
: G[EIY]|(?<=[AO])GG(?=I) J/K
: GG? K
: (^|(?<=[AEIOUY]))H[AEIOUY] H
: H -
s J H
: ^J(?=OSE(\s|$)) H
: J(?=OSE) J/H
: ^JJ? J/A
n (?<=[AEIOUY])J(?=[AO]) J/H
: J$ J/-
: (?<![SKL])J(?![LTKSNMBZ])J? J
: JJ? -
: KK? K
: (?<=I)LL(?=[OA]$)|(?<=A)LL(?=E$|E.*[AO]S?$) L/-
: LL? L
: (?<=U)MB(?=$|ER)|MM? M
: NN?|Ñ N
: PH F
: P[PB]? P
: QQ? K
n (?<=IE)(?<!M[EA]IE)R$ -/R
: RR? R
: (?<=[IY])S(?=L) -
: ^S(?=UGAR) X/S
: SH(?=EIM|OEK|OLM|OLZ) S
: SH X
n SI[OA] S/X
: SI[OA] S
: SZ|^S(?=[MNLW]) S/X
: SCH(?=E[RN]) X/SK
: SCH(?=OO|UY|ED|EM) SK
: ^SCH(?![AEIOUYW]) X/S
: SCH X
: SC[IEY] S
: SC.? SK
: (?<=[AO]I)S$ -/S
: S[SZ]? S
: TIO(?=N)|TIA|TCH X
: TH(?=[OA]M) T
g TH|TT(?=H) T
: TH|TT(?=H) 0/T
: T[TD]? T
: VV? F
: WR R
: ^WI[CT]Z ATS/FFX
: ^W(?=[AEIOUY]) A/F
: ^W(?=H) A
: (?<=[AEIOUY])W$|(?<=[EO])W(?=SK[IY]) -/F
c W -/F
: WI[CT]Z TS/FX
: W -
: (?<=[AO]U)X$ -
: X[CX]? KS
: ZH J
: ZZ(?=[OIA]) S/TS
w (?<=[^T])ZZ? S/TS
: ZZ? S
"""
_WHEN = {"n": "^(?!.*(W|K|CZ))", "w": ".*(W|K|CZ)", "g": r"VAN\s|VON\s|SCH", "c": "SCH", "m": "MC", "s": r"SAN\s", "a": "(?![DRM]ANGER)"}
_RULES = [(when, pattern, (code + "/" + code).split("/")[:2]) for when, pattern, code in (line.split(" ") for line in _TABLE.split("\n") if line)]


@cache
def _rules_when(true: frozenset[str]) -> tuple[re.Pattern, list[list[str]]]:
    """The rules for words with these properties, as one pattern, and their codes."""
    rules = [(pattern, codes) for when, pattern, codes in _RULES if when in true]
    return phonetics.either([p for p, _ in rules], re.DOTALL), [[c.replace("-", "") for c in codes] for _, codes in rules]


def double_metaphone(word: str) -> str:
    """Both readings with a comma between; the second is empty if it is the same."""
    word = word.upper()
    pattern, codes = _rules_when(frozenset([":", *(k for k, p in _WHEN.items() if re.match(p, word, re.DOTALL))]))
    at, readings = 0, ["", ""]
    while at < len(word):
        m = pattern.match(word, at)
        if m:
            readings = [r + c for r, c in zip(readings, codes[int(m.lastgroup[1:])])]
        at = max(at + 1, m.end() if m else 0)
    return f"{readings[0]},{readings[1] if readings[1] != readings[0] else ''}"


# Ainsworth's letter-to-sound rules, by letter; what follows > is said. {V} vowel, {C} consonant, {S} an English suffix.
_AINSWORTH = """
^a$>ə ^are>ɑ a(?=[ei])>ɛi ar>ɑ a(?=s[kt]|th|ft)>ɑ ay>ɛi aw>ɔ au>ɔ al(?=l)>ɔ a(?=ble)>ɛi a(?=ng{S})>ɛi a>æ
b>b
ch>tʃ ck>k c(?=[yei])>s c>k
d>d
(?<={V}{C})e$> (?<=th)e$>ə (?<=wh)ere>ɛə (?<=h)ere>iə (?<=w)ere>ɜ ere>ir ee>i ear>ir ea>i e(?=ver)>ɛ eye>ɑi e(?=[ei])>i e(?=r)>ɜ eo>i ew>ju e(?=u)> e>ɛ
f$>v f>f
g(?={S})>g g(?=i)>dʒ g(?=et)>g g(?=e)>dʒ gh>g g>g
(?<=w)h> ha(?=v)>hæ h>h
^i$>ɑi i(?=ty)>ɪ i(?=[ei])>ɑi ir>ɜ igh>ɑi (?<=t)io(?=n)>ʌ i(?=nd|ld)>ɑi i>ɪ
j>dʒ
^k(?=n)> k>k
le$>əl l>l
m>m
n(?=g)>ŋ n>n
o(?=ld)>əʊ oy>ɔi o(?=ing)>əʊ oi>ɔi (?<=y)ou>u ou(?=s)>ʌ ough(?=t)>ɔ (?<=b)ough>aʊ (?<=t)ough>ʌf (?<=c)ough>of (?<=r)ough>ʊ ough>əʊ oul(?=d)>ʊ ou>aʊ oor>ɔ oo(?=k)>ʊ (?<=f)oo(?=d)>u oo(?=d)>ʊ (?<=[fs])oo(?=t)>ʊ (?<=w)oo>ʊ oo>u
(?<=sh)oe>u oe>əʊ (?<=[chnvr])ow>ɑʊ ow>əʊ (?<=[gns])o$>əʊ o$>u o>o
ph>f psy>sɑi p>p
q>kw
r$> rho>rəʊ r>r
sh>ʃ ss>s sch>sk (?<={V})s$>z s>s
there>ðɛə their>ðɛə th(?=r)>θ th>ð t(?=ion)>ʃ t>t
u(?=pon)>ʌ u(?={V})>u (?<=[rl])u>u u>ju
v>v
w(?=r)> wh(?=o)>h wha(?=t)>wo wa>wo wo(?=r)>wɜ w>w
x>ks
^y>j (?<={V}{C})y>ɪ y(?=[ei])>ɑi y>ɪ
z>z
"""
_ENDINGS = "(able|ance|ence|less|ment|ness|ship|sion|tion|age|ant|ate|ent|ery|ful|ify|ise|ism|ity|ive|ize|ous|al|cy|en|er|es|fy|ry|s|y)"
_AINSWORTH_RULES = [rule.rsplit(">", 1) for rule in _AINSWORTH.split()]
_AINSWORTH_PATTERN = phonetics.either([p.replace("{V}", "[aeiou]").replace("{C}", "[b-df-hj-np-tv-z]").replace("{S}", _ENDINGS) for p, _ in _AINSWORTH_RULES])


def ainsworth(word: str) -> str:
    """The pronunciation in IPA; characters without a rule are skipped."""
    word, at, said = word.lower(), 0, ""
    while at < len(word):
        m = _AINSWORTH_PATTERN.match(word, at)
        said += _AINSWORTH_RULES[int(m.lastgroup[1:])][1] if m else ""
        at = m.end() if m else at + 1
    return said
