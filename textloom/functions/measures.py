"""Similarity measures over the 2x2 token table of a pair, as SQL expressions.

A pair's tokens give the cells a (shared), b (only in src), c (only in tar), d (in neither, up to the
alphabet's size), the margins p = a + b, q = a + c, r = c + d, s = b + d and the total n. Each
measure is one SQL expression of these doubles and `same` (equal strings); Catalyst compiles it into the scan's own
stage, and any SQL engine can evaluate it. Expressions written with `self` scores are evaluated three times:
for the pair and for either string with itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA, PROD, DEV = "(a*d - b*c)", "(p*q*r*s)", "(a - p*q/n)"
CHI = f"(n*{DELTA}*{DELTA}/{PROD})"
_MOST_CHI = "(case when a*d >= b*c then p*s*n/(q*r) when a <= d then p*q*n/(s*r) else s*r*n/(p*q) end)"
_LEAST_CHI = f"(n*n*n*power(p*q/n - (case when a*d < b*c then ceil(p*q/n) else floor(p*q/n) end), 2)/{PROD})"
SIGMA = "(greatest(a,b) + greatest(c,d) + greatest(a,c) + greatest(b,d))"
OUTER = "(greatest(q,s) + greatest(p,r))"
MARGINS = "(greatest(1e0,p)*greatest(1e0,q)*greatest(1e0,r)*greatest(1e0,s))"


def same(x: str, value: str = "1e0") -> str:
    """Equal strings have a fixed value."""
    return f"case when same then {value} else {x} end"


def both(x: str) -> str:
    """0 if either side has no tokens."""
    return f"case when p = 0 or q = 0 then 0e0 else {x} end"


def ratio(num: str, den: str) -> str:
    """0 if the numerator is 0."""
    return f"case when {num} = 0 then 0e0 else ({num}) / nullif({den}, 0e0) end"


def corr(x: str) -> str:
    return f"(1e0 + {x}) / 2e0"


def term(num: str, den: str) -> str:
    return f"(case when {den} = 0 then 0e0 else ({num}) / nullif({den}, 0e0) end)"


def clamp(x: str) -> str:
    return f"greatest(-1e0, least(1e0, {x}))"


def shares(x: str) -> str:
    """The expression over cells and margins divided by the population, which counts shared tokens twice."""
    return re.sub(r"\b([abcdpqrs])\b", r"(\1/(2*a + b + c + d))", x)


def of_n(x: str) -> str:
    return re.sub(r"\b([abcdpqrs])\b", r"(\1/n)", x)


#: Expressions of the similarity.
SIM: dict[str, str] = {
    "ample": same("abs(a/(case when p = 0 then 1e0 else p end) - c/(case when r = 0 then 1e0 else r end))"),
    "anderberg": ratio(f"({SIGMA} - {OUTER})", "n"),
    "andres_marzo_delta": same(corr("(a + d - 2*sqrt(b*c))/n")),
    "baroni_urbani_buser_i": same("(sqrt(a*d) + a)/nullif(sqrt(a*d) + a + b + c, 0e0)"),
    "baroni_urbani_buser_ii": same(corr("(sqrt(a*d) + a - b - c)/nullif(sqrt(a*d) + a + b + c, 0e0)")),
    "baulieu_ii": ratio("(a*a*d*d)", PROD),
    "benini_i": same(corr(ratio(DELTA, "(q*r)"))),
    "benini_ii": same(corr(ratio(DELTA, "((a + least(b,c))*(least(b,c) + d))"))),
    "bennet": same(corr("(2*(a + d)/n - 1)")),
    "braun_blanquet": same("a/nullif(greatest(p,q), 0e0)"),
    "clement": same(f"{term('a', 'p')}*(1 - p/n) + {term('d', 'r')}*(1 - r/n)"),
    "cohen_kappa": same(ratio("(2*d)", "(b + c + 2*d)")),
    "cole": same(corr(f"(case when {DELTA} = 0 then 0e0 when a*d >= b*c then {DELTA}/nullif(p*s, 0e0) when d >= a then {DELTA}/nullif(p*q, 0e0) else {DELTA}/nullif(s*r, 0e0) end)")),
    "consonni_todeschini_i": same("ln(1 + a + d)/ln(1 + n)"),
    "consonni_todeschini_ii": same("(ln(1 + n) - ln(1 + b + c))/ln(1 + n)"),
    "consonni_todeschini_iii": "case when same and n <= a then 1e0 else ln(1 + a)/ln(1 + n) end",
    "consonni_todeschini_iv": same("ln(1 + a)/nullif(ln(1 + a + b + c), 0e0)"),
    "consonni_todeschini_v": corr(ratio("(ln(1 + a*d) - ln(1 + b*c))", "ln(1 + n*n/4)")),
    "cosine": same(both("a/nullif(sqrt(p*q), 0e0)")),
    "dennis": f"case when p = 0 and q = 0 then 0.5e0/1.5e0 else (0.5e0 + {term(DEV, 'sqrt(p*q/n)')}/sqrt(n))/1.5e0 end",
    "dice": same(both("2*a/nullif(2*a + b + c, 0e0)")),
    "dice_asymmetric_i": same(ratio("a", "p")),
    "dice_asymmetric_ii": same(ratio("a", "q")),
    "digby": same("case when p = 0 or q = 0 then 0e0 else " + corr(ratio("(power(a*d, 0.75e0) - power(b*c, 0.75e0))", "(power(a*d, 0.75e0) + power(b*c, 0.75e0))")) + " end"),
    "dispersion": corr(ratio(DELTA, "(n*n)")),
    "doolittle": same(ratio(f"({DELTA}*{DELTA})", PROD)),
    "eyraud": f"0e0 - (a - p*q)/{MARGINS}",
    "fager_mcgowan": both("greatest(0e0, a/nullif(sqrt(p*q), 0e0) - 1/nullif(2*sqrt(greatest(p,q)), 0e0))"),
    "faith": ratio("(a + d/2)", "n"),
    "fleiss": corr(ratio(f"({DELTA}*(p*r + q*s))", f"(2*{PROD})")),
    "fleiss_levin_paik": ratio("(2*d)", "(2*d + b + c)"),
    "forbes_ii": corr(ratio("(n*a - p*q)", "(n*least(p,q) - p*q)")),
    "generalized_fleiss": corr(ratio(DELTA, "((p*r + q*s)/2)").replace(DELTA, DELTA)),
    "gilbert": same(corr(ratio("(a*n - p*q)", "(n*(a + b + c) - p*q)"))),
    "gini_i": corr(f"({shares('a + d - (p*q + r*s)')})/sqrt((1 + 2.220446049250313e-16 - ({shares('p*p + r*r')}))*(1 + 2.220446049250313e-16 - ({shares('q*q + s*s')})))"),
    "gini_ii": corr(f"({shares('a + d - (p*q + r*s)')})/(1 + 2.220446049250313e-16 - abs({shares('b - c')}) - ({shares('p*q + r*s')}))"),
    "goodall": same("2/pi()*asin(sqrt((a + d)/n))"),
    "goodman_kruskal_lambda": same(ratio(f"({SIGMA} - {OUTER})", f"(2*n - {OUTER})")),
    "goodman_kruskal_lambda_r": same("case when p = 0 or q = 0 then 0e0 else " + corr(ratio(f"(2*(a + d) - {OUTER})", f"(2*n - {OUTER})")) + " end"),
    "goodman_kruskal_tau_a": f"case when p = 0 or q = 0 then 0e0 when {shares('(a*a + c*c)/q + (b*b + d*d)/nullif(s, 0e0) - p*p - r*r')} <= 1e-14 then 0e0 else ({shares('(a*a + c*c)/q + (b*b + d*d)/nullif(s, 0e0) - p*p - r*r')})/(1 - ({shares('p*p + r*r')})) end",
    "goodman_kruskal_tau_b": f"case when p = 0 or q = 0 then 0e0 when {shares('(a*a + b*b)/p + (c*c + d*d)/nullif(r, 0e0) - q*q - s*s')} <= 1e-14 then 0e0 else ({shares('(a*a + b*b)/p + (c*c + d*d)/nullif(r, 0e0) - q*q - s*s')})/(1 - ({shares('q*q + s*s')})) end",
    "gower_legendre": same("(a + d)/nullif(a + d + 0.5e0*(b + c), 0e0)"),
    "guttman_lambda_a": same(both("case when round(greatest(a,c) + greatest(b,d) - greatest(p,r), 15) <= 1e-8 then 0e0 else (greatest(a,c) + greatest(b,d) - greatest(p,r))/(n - greatest(p,r)) end")),
    "guttman_lambda_b": same(both("case when round(greatest(a,b) + greatest(c,d) - greatest(q,s), 15) <= 1e-8 then 0e0 else (greatest(a,b) + greatest(c,d) - greatest(q,s))/(n - greatest(q,s)) end")),
    "gwet_ac": same(corr("((a + d)/n - (p + q)/n*(1 - (p + q)/(2*n)))/nullif(1 - (p + q)/n*(1 - (p + q)/(2*n)), 0e0)")),
    "hamann": same(corr("(a + d - b - c)/n")),
    "harris_lahey": same(f"{term('a', '(a + b + c)')}*(2*d + b + c)/(2*n) + {term('d', '(b + c + d)')}*(2*a + b + c)/(2*n)"),
    "hawkins_dotson": same(f"0.5e0*({term('a', '(a + b + c)')} + {term('d', '(b + c + d)')})"),
    "jaccard": same(both("a/nullif(a + b + c, 0e0)")),
    "jaccard_nm": both("2*a/(a + b + c + n)"),
    "johnson": same(both("0.5e0*(a/nullif(p, 0e0) + a/nullif(q, 0e0))")),
    "kendall_tau": corr(clamp(ratio("(2*(a + d - b - c))", "(n*greatest(n - 1, 1e0))"))),
    "kent_foster_i": f"1 + {ratio('(a - ' + term('p*q', '(a + b + c)') + ')', '(a - ' + term('p*q', '(a + b + c)') + ' + b + c)')}",
    "kent_foster_ii": f"1 + {ratio('(d - ' + term('s*r', '(b + c + d)') + ')', '(d - ' + term('s*r', '(b + c + d)') + ' + b + c)')}",
    "koppen_i": same(corr(ratio(f"({shares('(p + q)*(r + s)/4 - (b + c)/2')})", f"({shares('(p + q)*(r + s)/4')})"))),
    "koppen_ii": same("(a + (b + c)/2)/nullif(a + b + c, 0e0)"),
    "kuder_richardson": same(f"case when {DELTA} = 0 then 0.5e0 when p*r + q*s + 2*{DELTA} = 0 then 0e0 else (1 + greatest(-1e0, 4*{DELTA}/(p*r + q*s + 2*{DELTA})))/2 end"),
    "kuhns_i": f"0.5e0 + 2*{DEV}/n",
    "kuhns_ii": f"(0.5e0 + {ratio(DEV, 'greatest(p,q)')})/1.5e0",
    "kuhns_iii": f"(1e0/3e0 + {ratio(DEV, '((1 - a/nullif(p + q, 0e0))*(p + q - p*q/n))')})/(4e0/3e0)",
    "kuhns_iv": corr(ratio(DEV, "least(p,q)")),
    "kuhns_v": corr(f"case when {DEV} = 0 then 0e0 else {clamp(f'round({DEV}*n/greatest(greatest(1e0,p)*greatest(1e0,r), greatest(1e0,q)*greatest(1e0,s)), 15)')} end"),
    "kuhns_vi": corr(f"case when {DEV} = 0 then 0e0 else {clamp(f'round({DEV}*n/least(greatest(1e0,p)*greatest(1e0,r), greatest(1e0,q)*greatest(1e0,s)), 15)')} end"),
    "kuhns_vii": f"(0.5e0 + {ratio(DEV, 'sqrt(p*q)')})/1.5e0",
    "kuhns_viii": f"(0.5e0 + {ratio(DEV, '(a + (b + c)/2)')})/1.5e0",
    "kuhns_ix": corr(f"case when {DEV} = 0 then 0e0 else {clamp(f'{DEV}*n/sqrt({MARGINS})')} end"),
    "kuhns_xi": same(corr(f"{clamp(f'n*{DEV}/greatest(1e0, power(sqrt(a*d) + sqrt(b*c), 2))')}")),
    "kuhns_xii": f"case when p = 0 or q = 0 or {DEV} = 0 then 0.5e0 - (case when a = 0 then 0e0 else 0.5e0 end) when n*{DEV}/(p*q) < 0 then (1 + greatest(-1e0, n*{DEV}/(p*q)))/2 when a = 0 or d = 0 then least(1e0, n*{DEV}/(p*q)) else least(1e0, n*{DEV}/(p*q)/(greatest(a,d)/least(a,d))) end",
    "kulczynski_ii": same(both("0.5e0*(a/nullif(p, 0e0) + a/nullif(q, 0e0))")),
    "maarel": same("case when p = 0 or q = 0 then 0e0 else " + corr("(2*a - b - c)/nullif(2*a + b + c, 0e0)") + " end"),
    "masi": same("a/nullif(a + b + c, 0e0)*(case when b = 0 or c = 0 then 2e0/3e0 when a <> 0 then 1e0/3e0 else 0e0 end)"),
    "maxwell_pilliner": corr(ratio(f"(2*{DELTA})", "(p*r + q*s)")),
    "mcconnaughey": same(corr(ratio("(a*a - b*c)", "(p*q)"))),
    "mcewen_michael": corr(ratio(f"(4*{DELTA})", "(power(a + d, 2) + power(b + c, 2))")),
    "michelet": same(ratio("(a*a)", "(p*q)")),
    "mountford": ratio("(2*a)", "(greatest(1e0,c)*(a + 2*greatest(1e0,b)) + a*greatest(1e0,b))"),
    "ms_contingency": same("case when p = 0 or q = 0 then 0e0 else " + corr(ratio(f"(sqrt(2e0)*{DELTA})", f"sqrt({DELTA}*{DELTA} + {PROD})")) + " end"),
    "overlap": same(both("a/nullif(least(p,q), 0e0)")),
    "pearson_chi_squared": same(corr(f"case when p = 0 or q = 0 then 0e0 else sign({DELTA})*{CHI}/n end")),
    "pearson_heron_ii": same("case when p = 0 or q = 0 then 0e0 else " + corr("cos(pi()*sqrt(b*c)/nullif(sqrt(a*d) + sqrt(b*c), 0e0))") + " end"),
    "pearson_ii": f"case when same then 1e0 when p = 0 or q = 0 then 0e0 else sqrt(2e0)*sqrt({CHI}/(n + {CHI})) end",
    "pearson_iii": f"case when same then (1 + sqrt(1/(n + 1)))/2 when {DELTA} = 0 then 0.5e0 else (1 + sign({DELTA})*sqrt(abs({DELTA}/sqrt({PROD}))/(n + {DELTA}/sqrt({PROD}))))/2 end",
    "pearson_phi": same(corr(ratio(DELTA, f"sqrt({PROD})"))),
    "peirce": same(corr(ratio(DELTA, "(p*r)"))),
    "rogers_tanimoto": same("(a + d)/(b + c + n)"),
    "rogot_goldberg": same(f"{term('a', '(2*a + b + c)')} + {term('d', '(2*d + b + c)')}"),
    "russell_rao": ratio("a", "n"),
    "scott_pi": same(corr("((a + d)/n - power((p + q)/(2*n), 2) - power((r + s)/(2*n), 2))/nullif(1 - power((p + q)/(2*n), 2) - power((r + s)/(2*n), 2), 0e0)")),
    "sokal_michener": same("(a + d)/n"),
    "sokal_sneath_i": same("2*(a + d)/(a + d + n)"),
    "sokal_sneath_ii": same("a/nullif(a + 2*(b + c), 0e0)"),
    "sokal_sneath_iv": f"0.25e0*({term('a', 'p')} + {term('a', 'q')} + {term('d', 's')} + {term('d', 'r')})",
    "sokal_sneath_v": same(both(ratio("(a*d)", f"sqrt({PROD})"))),
    "sorgenfrei": same(ratio("(a*a)", "(p*q)")),
    "steffensen": same(both(" + ".join(f"({of_n(x)}*power({of_n(x)} - {of_n(i)}*{of_n(j)}, 2)/nullif({of_n(i)}*(1 - {of_n(i)})*{of_n(j)}*(1 - {of_n(j)}), 0e0))" for x, i, j in (("a", "p", "q"), ("b", "p", "s"), ("c", "r", "q"), ("d", "r", "s"))))),
    "stuart_tau": corr(clamp("4*(a + d - b - c)/(n*n)")),
    "tarantula": same(ratio("(a*(c + d))", "(a*(2*c + d) + b*c)")),
    "tarwid": corr("case when n*a = p*q then 0e0 else (n*a - p*q)/nullif(n*a + p*q, 0e0) end"),
    "tetrachoric": corr("case when b*c = 0 then 1e0 else cos(pi()*sqrt(b*c)/(sqrt(a*d) + sqrt(b*c))) end"),
    "tulloss_r": same(both("ln(1 + a/nullif(p, 0e0))*ln(1 + a/nullif(q, 0e0))/power(ln(2e0), 2)")),
    "tulloss_s": "1/sqrt(ln(2 + least(b,c)/(a + 1))/ln(2e0))",
    "tulloss_u": same("ln(1 + (least(b,c) + a)/nullif(greatest(b,c) + a, 0e0))/ln(2e0)"),
    "tversky": same(both("a/nullif(a + b + c, 0e0)")),
    "unknown_a": same(corr(ratio(DELTA, "(q*s)"))),
    "unknown_b": same(ratio(f"({DELTA}*{DELTA})", PROD)),
    "unknown_c": same(both(f"(a + d)/sqrt({MARGINS})")),
    "unknown_d": ratio("(a*b + b*c)", "(a*b + 2*b*c + c*d)"),
    "unknown_e": same(corr(ratio("(2*least(a,d) - b - c)", "(2*least(a,d) + b + c)"))),
    "unknown_g": ratio("(a*(2*a + b + c)/2)", "(p*q)"),
    "unknown_h": both("greatest(0e0, a/nullif(sqrt(p*q), 0e0) - 1/nullif(2*sqrt(least(p,q)), 0e0))"),
    "unknown_i": "2*(a + 1)/((c + 1)*(a + 1 + 2*(b + 1)) + (a + 1)*(b + 1))",
    "unknown_l": "case when p = 0 or q = 0 then 1e0 else (a + d)/nullif(least(b,c) + least(n - b, n - c), 0e0) end",
    "unknown_m": f"(1 - (n - a*d)/sqrt({MARGINS}))/2",
    "upholt": same(both("(-(2*a/nullif(2*a + b + c, 0e0)) + sqrt((8 + 2*a/nullif(2*a + b + c, 0e0))*2*a/nullif(2*a + b + c, 0e0)))/2")),
    "warrens_i": same(corr("(2*a - b - c)/nullif(2*a + b + c, 0e0)")),
    "warrens_ii": same(ratio("(2*d)", "(b + c + 2*d)")),
    "warrens_iii": same(corr(ratio("(2*d - b - c)", "(2*d + b + c)"))),
    "warrens_iv": same(ratio("(4*a*d)", "(4*a*d + (a + d)*(b + c))")),
    "weighted_jaccard": same("3*a/nullif(3*a + b + c, 0e0)"),
    "yule_q": same(corr(ratio(DELTA, "(a*d + b*c)"))),
    "yule_y": same(corr(ratio("(sqrt(a*d) - sqrt(b*c))", "(sqrt(a*d) + sqrt(b*c))"))),
}
SIM["kuhns_x"] = corr(f"case when a = n then 1e0 when {DEV} = 0 then 0e0 else {clamp(f'round(n*{DEV}/nullif(a*d + b*c, 0e0), 15)')} end")
SIM["tulloss_t"] = f"sqrt(({SIM['tulloss_r']})*({SIM['tulloss_s']})*({SIM['tulloss_u']}))"
SIM["hurlbert"] = same(f"case when p = 0 or q = 0 then 0e0 else {corr(f'(case when {DELTA} = 0 then 0e0 else sign({DELTA})*sqrt(abs(({CHI} - {_LEAST_CHI})/nullif({_MOST_CHI} - {_LEAST_CHI}, 0e0))) end)')} end")
#: Expressions of the distance; the similarity is one less it.
DIST: dict[str, str] = {
    "batagelj_bren": same("case when a = 0 or d = 0 then 1e0 else b*c/(a*d)/n end", "0e0"),
    "baulieu_i": ratio("(p*q - a*a)", "(p*q)"),
    "baulieu_iii": ratio(f"(n*n - 4*{DELTA})", "(2*n*n)"),
    "baulieu_iv": "((b + c - (a + 0.5e0)*(d + 0.5e0)*d*exp(1e0))/n + n*n*n*exp(1e0))/(2*n*n*n*exp(1e0))",
    "baulieu_v": "(b + c + 1)/(a + b + c + 1)",
    "baulieu_vi": "(b + c)/(a + b + c + 1)",
    "baulieu_vii": same("(b + c)/(n + a*power(a - 4, 2))", "0e0"),
    "baulieu_viii": ratio("power(b - c, 2)", "(n*n)"),
    "baulieu_ix": same("(b + 2*c)/(n + c)", "0e0"),
    "baulieu_x": ratio("(b + c + greatest(b,c))", "(n + greatest(b,c))"),
    "baulieu_xi": same(ratio("(b + c)", "(b + c + d)"), "0e0"),
    "baulieu_xii": ratio("(b + c)", "(greatest(1e0,a) + b + c - 1)"),
    "baulieu_xiii": ratio("(b + c)", "(a + b + c + a*power(a - 4, 2))"),
    "baulieu_xiv": same(ratio("(b + 2*c)", "(a + b + 2*c)"), "0e0"),
    "baulieu_xv": same(ratio("(b + c + greatest(b,c))", "(a + b + c + greatest(b,c))"), "0e0"),
    "canberra": same("(b + c)/nullif(p + q, 0e0)", "0e0"),
    "pattern": ratio("(4*b*c)", "(n*n)"),
    "size": same("power(b + c, 2)/(n*n)", "0e0"),
    "unknown_k": "1 - a/n",
    "yjhhr": same("round(b + c, 14)/nullif(a + b + c, 0e0)", "0e0"),
    "bag": same("greatest(b,c)/nullif(greatest(p,q), 0e0)", "0e0"),
    "q_gram": same("(b + c)/nullif(a + b + c, 0e0)", "0e0"),
    "yule_q_ii": "case when b = 0 or c = 0 then 0e0 else b*c/(a*d + b*c) end",
}
#: Scores without a bound, for which there is no similarity between 0 and 1.
SCORE: dict[str, str] = {
    "kulczynski_i": "case when a = 0 then 0e0 when b + c = 0 then cast('Infinity' as double) else a/nullif(b + c, 0e0) end",
    "sokal_sneath_iii": "case when b + c = 0 then cast('Infinity' as double) else (a + d)/nullif(b + c, 0e0) end",
    "unknown_f": same(both("least(1e0, 1 + ln(case when a = 0 then 1e0 else a/n end) - (ln(nullif(p, 0e0)/n) + ln(nullif(q, 0e0)/n))/2)")),
    "tanimoto": "case when same then 0e0 when a = 0 then cast('-Infinity' as double) else ln(a/nullif(a + b + c, 0e0))/ln(2e0) end",
}
#: Scores that are divided by the larger score of a string with itself.
SELF: dict[str, str] = {
    "azzoo": "(a + 0.5e0*d)",
    "forbes_i": ratio("(n*a)", "(p*q)"),
    "fossum": "(n*power(a - 0.5e0, 2)/(greatest(1e0,p)*greatest(1e0,q)))",
    "unknown_j": "(a*(a + b + c + greatest(1e0,d))/nullif(p*(c + greatest(1e0,d)), 0e0))",
    "unigram_subtuple": "greatest(0e0, ln(greatest(1e0,a)*greatest(1e0,d)/(greatest(1e0,b)*greatest(1e0,c))) - 3.29e0*sqrt(1/greatest(1e0,a) + 1/greatest(1e0,b) + 1/greatest(1e0,c) + 1/greatest(1e0,d)))",
    "dunning": "abs(round(2/ln(2e0)*((" + " + ".join(f"(case when {x} > 0 then {x}/n*ln(nullif({x}/n, 0e0)) else 0e0 end)" for x in "abcd") + ") - (" + " + ".join(f"(case when {x} > 0 then {x}/n*ln(nullif({x}/n, 0e0)) else 0e0 end)" for x in "pqrs") + ")), 15))",
    "yates_chi_squared": f"greatest(0e0, n*power(abs({DELTA}) - n/2, 2)/{MARGINS})",
}
SIM["mutual_information"] = "case when (1 + a*n) = (1 + p*q) then 0e0 else (1 + ln((1 + a*n)/(1 + p*q))/greatest({x}, {y}))/2 end"
SIM["warrens_v"] = same(f"case when {DELTA} = 0 then 0e0 else (1 + {DELTA}/nullif(least(p*q, s*r), 0e0))/(1 + greatest({{x}}, {{y}})) end")
_OWN = {"mutual_information": "(case when p = 0 then 1e0 else ln((1 + a*n)/(1 + p*q)) end)", "warrens_v": f"({DELTA}/nullif(least(p*q, s*r), 0e0))"}
_A, _B, _C, _D = (f"greatest({x}, 1e-7)" for x in "abcd")
_N = f"({_D} + {_A} + {_B} + {_C})"
_OWN["stiles"] = f"(sign({_A}*{_N} - {_B}*{_C})*abs(log10({_N}*greatest(power(abs({_A}*{_N} - {_B}*{_C}) - {_N}/2, 2), 1e-7)/({_B}*({_N} - {_B})*{_C}*({_N} - {_C})))))"
SIM["stiles"] = f"(1 + {_OWN['stiles']}/greatest({{x}}, {{y}}))/2"
#: Tokens of measures that do not take padded pairs of characters.
TOKENS = {"bag": "char", "q_gram": "bare"}
#: Letters of the default alphabet and two stops, to the power of two.
ALPHABET = 28 * 28


def with_self(text: str, side: str) -> str:
    """The expression for the string of one side with itself."""
    own = {"a": f"{side}_p", "b": "0e0", "c": "0e0", "d": f"{side}_d", "p": f"{side}_p", "q": f"{side}_p", "r": f"{side}_d", "s": f"{side}_d", "n": f"({side}_p + {side}_d)"}
    return re.sub(r"\b([abcdpqrsn])\b", lambda m: own[m[1]], text).replace("same", "true")


def similarity(name: str) -> str:
    """The SQL expression of a measure's similarity over the columns that with_cells makes."""
    if name in DIST:
        return f"1e0 - ({DIST[name]})"
    if name in SELF:
        x, y = with_self(SELF[name], "x"), with_self(SELF[name], "y")
        return same(f"({SELF[name]})/(case when greatest({x}, {y}) = 0 then 1e0 else greatest({x}, {y}) end)")
    if name in _OWN:
        return SIM[name].format(x=with_self(_OWN[name], "x"), y=with_self(_OWN[name], "y"))
    return SCORE[name] if name in SCORE else SIM[name]


NAMES = sorted({*SIM, *DIST, *SELF, *SCORE})


def q_grams(c: Column, q: int = 2, start: str = "$", stop: str = "#") -> Column:
    """Padded q-grams of a string column; the empty string has none, null gives null."""
    padded = F.concat(F.lit(start * (q - 1)), c, F.lit(stop * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - q + 1)), lambda i: F.substring(padded, i, F.lit(q)))
    return F.when(c.isNotNull(), F.when((F.length(c) == 0) | (F.length(padded) < q), F.array().cast("array<string>")).otherwise(grams))


def tokens(c: Column, kind: str = "padded") -> Column:
    if kind == "char":
        return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return q_grams(c) if kind == "padded" else q_grams(c, start="", stop="")


def with_cells(pairs: DataFrame, src: str = "src", tar: str = "tar", kind: str = "padded", alphabet: int = ALPHABET) -> DataFrame:
    """Adds x and y (tokens), same, the cells, margins and total, and x_p, x_d, y_p, y_d for the self scores."""
    df = pairs.withColumn("x", tokens(F.col(src), kind)).withColumn("y", tokens(F.col(tar), kind)).withColumn("same", F.col(src) == F.col(tar))
    df = df.withColumn("u", F.array_union("x", "y"))
    count = lambda tokens_, t: F.size(F.filter(tokens_, lambda v: v == t))
    shared = F.aggregate("u", F.lit(0), lambda acc, t: acc + F.least(count(F.col("x"), t), count(F.col("y"), t)))
    df = df.withColumn("a", shared.cast("double"))
    outside = lambda t: F.greatest(F.lit(0), F.lit(alphabet) - F.size(t)).cast("double")
    df = df.withColumns({"b": F.size("x") - F.col("a"), "c": F.size("y") - F.col("a"), "d": outside(F.col("u"))})
    df = df.withColumns({"p": F.size("x").cast("double"), "q": F.size("y").cast("double"), "r": F.expr("c + d"), "s": F.expr("b + d"), "n": F.expr("a + b + c + d")})
    return df.withColumns({"x_p": F.col("p"), "y_p": F.col("q"), "x_d": outside(F.array_distinct("x")), "y_d": outside(F.array_distinct("y"))})


def measure(pairs: DataFrame, name: str, src: str = "src", tar: str = "tar") -> DataFrame:
    """Adds `sim`, the named similarity of two string columns."""
    return with_cells(pairs, src, tar, TOKENS.get(name, "padded")).withColumn("sim", F.expr(similarity(name)))


#: The cells in DuckDB's dialect, over a table pairs(id, src, tar).
def cells_sql(kind: str = "padded", alphabet: int = ALPHABET) -> str:
    text = "'$' || {0} || '#'" if kind == "padded" else "{0}"
    width = 1 if kind == "char" else 2
    grams = lambda c: f"case when length({c}) = 0 then []::varchar[] else list_transform(range(1, length({text.format(c)}) - {width} + 2), lambda i: substr({text.format(c)}, i, {width})) end"
    return f"""t as (select id, src, tar, src = tar as same, {grams("src")} as x, {grams("tar")} as y from pairs),
u as (select *, list_distinct(list_concat(x, y)) as u from t),
v as (select *, coalesce(list_sum(list_transform(u, lambda k: least(len(list_filter(x, lambda i: i = k)), len(list_filter(y, lambda i: i = k))))), 0)::double as a from u),
w as (select *, len(x) - a as b, len(y) - a as c, greatest(0, {alphabet} - len(u))::double as d, len(x)::double as p, len(y)::double as q, len(x)::double as x_p, len(y)::double as y_p,
    greatest(0, {alphabet} - len(list_distinct(x)))::double as x_d, greatest(0, {alphabet} - len(list_distinct(y)))::double as y_d from v),
cells as (select *, c + d as r, b + d as s, a + b + c + d as n from w)"""


#: Pairs of neighbouring part names, the table that measure queries run on.
PAIRS_SQL = "pairs as (select l.p_partkey as id, l.p_name as src, r.p_name as tar from part l join part r on r.p_partkey = l.p_partkey + 1)"


def pairs_of_parts(part: DataFrame, dealt: bool = False) -> DataFrame:
    """Names of neighbouring keys; `dealt` spreads a small file over the tasks, for measures that take longer than reading."""
    left = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("src"))
    left = left.repartition("id") if dealt else left
    return left.join(part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("tar")), "id")


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))
        return measure(pairs, name).select("id", "src", "tar", F.round("sim", 9).alias("sim"))

    return run


def sql(name: str) -> str:
    return f"with {PAIRS_SQL}, {cells_sql(TOKENS.get(name, 'padded'))} select id, src, tar, round({similarity(name)}, 9) as sim from cells"
