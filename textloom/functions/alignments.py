"""Distances by weighted edits, blocks, keyboards and near positions, as kernels over string pairs.

`grid` is the one dynamic programme; a measure is its costs and a normaliser. Null on either side gives null;
a pair with one empty string has similarity 0 where the definition would divide by its length.
"""

from __future__ import annotations

import hashlib
import math
import operator
import random
import zlib
from collections import Counter
from itertools import groupby
from unicodedata import normalize

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arithmetic, edits, measures, phonetics, tokenizers


def grid(a, b, drop, add, change, border=None) -> list[list[float]]:
    """Costs of all prefixes: drop(i, j), add(i, j) and change(i, j) at 0-based places; border(side, k) for the edges."""
    border = border or (lambda side, k: drop(k, 0) if side == 0 else add(0, k))
    rows = [[0.0]]
    for j in range(len(b)):
        rows[0].append(rows[0][j] + border(1, j))
    for i in range(len(a)):
        last, row = rows[-1], [rows[-1][0] + border(0, i)]
        for j in range(len(b)):
            row.append(min(last[j + 1] + drop(i, j), row[j] + add(i, j), last[j] + change(i, j)))
        rows.append(row)
    return rows


# Editex's letter groups.
_EDITEX = "AEIOUY BP CKQ DT LR MN GJ FPV SXZ".split()


def editex(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _folded(a), _folded(b)

    def differ(p: str, q: str) -> int:
        return 0 if p == q else 1 if any(p in g and q in g for g in _EDITEX) else 2

    def lone(s: str, k: int) -> int:
        before = s[k - 1] if k else " "
        return 1 if before in "HW" and before != s[k] else differ(before, s[k])

    total = grid(x, y, lambda i, j: lone(x, i), lambda i, j: lone(y, j), lambda i, j: differ(x[i], y[j]))[-1][-1]
    if not x or not y:
        total = 2 * max(len(x), len(y))
    return 1 - total / (2 * max(len(a), len(b)))


def _folded(s: str) -> str:
    """Upper case, accents as marks of their own."""
    return normalize("NFKD", s.upper())


# Letters that are cheap to add or drop, and to change into one another.
_FLEX_LONE = [("dtch", 0.4), ("e", 0.5), ("u", 0.9), ("rpn", 0.95)]
_FLEX_CHANGE = [("szß", 0.1), ("dt", 0.1), ("iy", 0.1), ("ckq", 0.1), ("eä", 0.1), ("uüv", 0.1), ("iü", 0.1), ("fv", 0.1), ("zc", 0.1), ("ij", 0.1), ("bp", 0.1), ("eoö", 0.2), ("aä", 0.2), ("mbp", 0.4), ("uw", 0.4), ("uo", 0.8), ("aeiouy", 0.9)]


def flex_metric(a: str, b: str) -> float:
    """Edits at the price of the letters; the second of a double letter is free."""
    if a == b:
        return 1.0

    def lone(s: str, k: int) -> float:
        return 0.0 if k and s[k - 1] == s[k] else next((price for letters, price in _FLEX_LONE if s[k] in letters), 1.0)

    def change(i: int, j: int) -> float:
        return 0.0 if a[i] == b[j] else next((price for letters, price in _FLEX_CHANGE if low_a[i] in letters and low_b[j] in letters), 1.0)

    low_a, low_b = a.lower(), b.lower()
    if len(low_a) != len(a) or len(low_b) != len(b):
        low_a, low_b = a, b
    costs = grid(a, b, lambda i, j: lone(low_a, i), lambda i, j: lone(low_b, j), change, lambda side, k: lone((a, b)[side], k))
    return 1 - costs[-1][-1] / max(len(a), len(b))


def discounted_levenshtein(a: str, b: str, free: int = 1) -> float:
    """Edits count less from the `free`-th place on, by a logarithm of the distance from there."""
    if a == b:
        return 1.0

    def price(k: int) -> float:
        return 1 / (1 + math.log1p(max(0, k - free) / 5))

    whole = max(sum(map(price, range(len(s)))) for s in (a, b))
    if not a or not b:
        return 0.0
    both = lambda i, j: min(price(i), price(j))
    return 1 - grid(a, b, both, both, lambda i, j: both(i, j) * (a[i] != b[j]), lambda side, k: price(k + 1))[-1][-1] / whole


# The keys of keyboards, row by row, without and with shift (and with a third level); a tab is no key of the layout.
_QWERTY = ["`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./", "\t\t\t "], ["~!@#$%^&*()_+", "\tQWERTYUIOP{}|", '\tASDFGHJKL:"', "\tZXCVBNM<>?", "\t\t\t "]
_DVORAK = ["`1234567890[]", "\t',.pyfgcrl/=\\", "\taoeuidhtns-", "\t;qjkxbmwvz", "\t\t\t "], ["~!@#$%^&*(){}", '\t"<>PYFGCRL?+|', "\tAOEUIDHTNS_", "\t:QJKXBMWVZ", "\t\t\t "]
_AZERTY = ["²&é\"'(-è_çà)=", "\tazertyuiop\t$", "\tqsdfghjklmù*", "<wxcvbn,;:!", "\t\t\t "], ["~1234567890°+", "\tAWERTYUIOP\t£", "\tQSDFGHJKLMÙμ", ">WXCVBN?./§", "\t\t\t "]
_QWERTZ = ["\t1234567890ß", "\tqwertzuiop\t+\\", "\tasdfghjklöä#", "<yxcvbnm,.-", "\t\t\t "], ['°!"§$%&/()=?', "\tQWERTZUIOPÜ*", "\tASDFGHJKLÖÄ'", ">YXCVBNM;:_", "\t\t\t "]


def _keys(*levels: list[str]) -> dict[str, tuple[int, int, int]]:
    """Row, column and level of each key; the first level that has it."""
    return {key: (row, column, level) for level in reversed(range(len(levels))) for row, keys in enumerate(levels[level]) for column, key in reversed(list(enumerate(keys))) if key != "\t"}


KEYBOARDS = {"QWERTY": _keys(*_QWERTY), "Dvorak": _keys(*_DVORAK), "AZERTY": _keys(*_AZERTY), "QWERTZ": _keys(*_QWERTZ)}


#: Ways between keys that lie r rows and c columns apart.
_WAYS = {"euclidean": math.hypot, "manhattan": lambda r, c: abs(r) + abs(c), "log-euclidean": lambda r, c: math.log1p(math.hypot(r, c)), "log-manhattan": lambda r, c: math.log1p(abs(r) + abs(c))}


def typo(a: str, b: str, way: str = "euclidean", layout: str = "QWERTY") -> float:
    """A change costs half the way between the keys, a quarter more if only one needs shift; a letter that is on no key is dropped and another added."""
    if a == b:
        return 1.0
    apart, keys = _WAYS[way], KEYBOARDS[layout]

    def change(i: int, j: int) -> float:
        if a[i] == b[j]:
            return 0.0
        if a[i] not in keys or b[j] not in keys:
            return 2.0
        (r, c, up), (s, d, high) = keys[a[i]], keys[b[j]]
        return 0.5 * (apart(r - s, c - d) + 0.5 * (up != high))

    one = lambda i, j: 1.0
    return 1 - grid(a, b, one, one, change)[-1][-1] / max(len(a), len(b))


def _blocks(a: str, b: str, prime: bool = False) -> tuple[str, str]:
    """Shared substrings, longest first, become letters of their own; if `prime`, equally often in both."""
    used, code = set(a) | set(b), ord("A")
    while (found := edits.common_substring(a, b))[0] > 1:
        block = a[found[1] : found[1] + found[0]]
        while chr(code) in used:
            code += 1
        used.add(chr(code))
        n = min(a.count(block), b.count(block)) if prime else -1
        a, b = a.replace(block, chr(code), n), b.replace(block, chr(code), n)
    return a, b


def block_levenshtein(a: str, b: str) -> float:
    return 1 - edits.edit_distance(*_blocks(a, b)) / max(len(a), len(b)) if a != b else 1.0


def shapira_storer(a: str, b: str, prime: bool = False) -> float:
    """Additions and drops after blocks are replaced; a letter that is dropped and added again is one move."""
    if a == b:
        return 1.0
    size = len(a) + len(b)
    x, y = _blocks(a, b, prime)
    one = lambda i, j: 1
    cost = grid(x, y, one, one, lambda i, j: 0 if x[i] == y[j] else math.inf)
    i, j, here, dropped, added = len(x), len(y), 0, Counter(), Counter()
    while i or j:
        if i and j:
            here = cost[i][j]
            step = min((cost[i - 1][j - 1], 0), (cost[i - 1][j], 1), (cost[i][j - 1], 2))[1]
        else:
            step = 1 if i else 2
        i, j = i - (step < 2), j - (step != 1)
        if cost[i][j] < here:
            dropped.update(x[i] if step < 2 else "")
            added.update(y[j] if step != 1 else "")
    moves = sum((dropped & added).values()) if x and y else 0
    return 1 - (cost[-1][-1] - moves) / size


def cormode_lz(a: str, b: str) -> float:
    """The share of a's phrases, each the longest that stands in b or before in a."""
    at = phrases = 0
    while at < len(a):
        end = at
        while end < len(a) and (a[at : end + 1] in b or a[at : end + 1] in a[:at]):
            end += 1
        if end == len(a):
            break
        phrases, at = phrases + 1, max(end, at + 1)
    return 1 - phrases / len(a) if a else 1.0


def _mra_code(s: str) -> str:
    s = s.upper()
    s = "".join(k for k, _ in groupby(s[:1] + "".join(c for c in s[1:] if c not in "AEIOU")))
    return s if len(s) <= 6 else s[:3] + s[-3:]


def match_rating(a: str, b: str) -> float:
    """Agreement of the match rating codes out of 6; 0 below the least rating for their lengths."""
    if a == b:
        return 1.0
    x, y = _mra_code(a), _mra_code(b)
    if not a or not b or abs(len(x) - len(y)) > 2:
        return 0.0
    size = len(x) + len(y)
    least = 5 if size < 5 else 4 if size < 8 else 3 if size < 12 else 2
    for _ in "lr":  # letters that agree go, from the left, then from the right
        n = min(len(x), len(y))
        apart = [k for k in range(n) if x[k] != y[k]]
        x, y = (("".join(s[k] for k in apart) + s[n:])[::-1] for s in (x, y))
    rating = 6 - max(len(x), len(y))
    return rating / 6 if rating >= least else 0.0


def ozbay(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    d, x, y = edits.edit_distance(a, b), set(a), set(b)
    apart = 1 - len(x & y) / len(x | y)
    shared = edits.common_substring(a, b)[0] / max(len(a), len(b))
    score = d if apart == 1 else apart * d if apart else d / len(a)
    score = score / shared if shared else score * min(len(a), len(b))
    return 1 - score * (1 - shared) / (len(a) * len(b))


def positional_substrings(a: str, b: str) -> float:
    """Shared substrings of one to three letters, less how far from their places they stand."""
    if a == b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, list[int]] = {}
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            places.setdefault(b[i : i + n], []).append(i)
    ways = [min(abs(i - k) for k in places[a[i : i + n]]) for n in (1, 2, 3) for i in range(len(a) - n + 1) if a[i : i + n] in places]
    score = len(ways) - sum(ways) / len(a)
    return score / (3 * len(a) - 3) if score and len(a) > 1 else 0.0


# Places compared, counted from a letter's own, and what agreement is worth.
_GUTH = [(0, 0, 1.0), (0, 1, 0.8), (0, 2, 0.6), (0, -1, 0.8), (-1, 0, 0.8), (1, 0, 0.8), (2, 0, 0.6), (1, 1, 0.6), (2, 2, 0.2)]


def guth(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = dict(enumerate(a)), dict(enumerate(b))
    worth = (next((w for p, q, w in _GUTH if x.get(k + p, "") and x.get(k + p) == y.get(k + q)), 0.0) for k in range(len(a)))
    return sum(worth) / len(a) if a and b else 0.0


def isg(a: str, b: str) -> float:
    """Jaccard of letters that stand at most one place before or two after their own in the other string."""
    if a == b:
        return 1.0

    def score(s: str, t: str) -> float:
        hits = sum(c in t[max(0, k - 1) : k + 3] for k, c in enumerate(s))
        return hits / (len(s) + len(t) - hits)

    return max(score(a, b), score(b, a)) if len(a) == len(b) else score(*sorted((a, b), key=len))


def ssk(a: str, b: str, decay: float = 0.9) -> float:
    """Gap-weighted kernel of subsequences of two letters."""
    if a == b:
        return 1.0

    def weights(s: str) -> Counter:
        out: Counter = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                out[s[i] + s[j]] += decay ** (j - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(w * q[k] for k, w in p.items() if k in q)
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def fellegi_sunter(a: str, b: str, q: int = 2) -> float:
    """Weights of shared q-grams by their share of b's."""
    x, y = Counter(edits.grams(a, q)), Counter(edits.grams(b, q))
    tiny, score, total = 2.0**-52, 0.0, sum(y.values())
    for n in (x & y).values():
        chance = -math.expm1(len(x) * len(y) * math.log(max(tiny, 1 + tiny - (n / total) ** 2)))
        score -= math.log(chance + tiny)
    return max(0.0, score / max(len(a), len(b))) if score else 0.0


# Letters and digits that are taken for one another.
_ALIKE = "AE AI AO AU BV EI EO EU IO IU OU IY EY CG EF WU WV XK SZ XS QC UV MN LI QO PR IJ 2Z 5S 8B 1I 1L 0O 0Q CK GJ".split()


def strcmp95(a: str, b: str, long: bool = False) -> float:
    """Jaro-Winkler in upper case with credit for letters taken for one another; `long` adds for long strings."""
    x, y = a.strip().upper(), b.strip().upper()
    if x == y or not x or not y:
        return float(x == y)
    reach, free, mine = max(0, max(len(x), len(y)) // 2 - 1), set(range(len(y))), {}
    for i, c in enumerate(x):
        k = next((k for k in range(max(0, i - reach), min(len(y), i + reach + 1)) if k in free and y[k] == c), None)
        if k is not None:
            mine[i] = k
            free.remove(k)
    common, less = len(mine), min(len(x), len(y))
    if not common:
        return 0.0
    crossed = sum(x[i] != y[k] for i, k in zip(mine, sorted(mine.values()))) // 2
    alike = 0
    for i in range(len(x)) if less > common else ():
        k = next((k for k in sorted(free) if x[i] + y[k] in _ALIKE or y[k] + x[i] in _ALIKE), None) if i not in mine else None
        if k is not None:
            free.remove(k)
            alike += 1
    credit = common + 0.3 * alike
    weight = (credit / len(x) + credit / len(y) + (common - crossed) / common) / 3
    if weight > 0.7:
        start = next((k for k in range(min(4, less)) if x[k] != y[k] or x[k].isdigit()), min(4, less))
        weight += 0.1 * start * (1 - weight)
        if long and less > 4 and common > start + 1 and 2 * common >= less + start and not x[0].isdigit():
            weight += (1 - weight) * (common - start - 1) / (len(x) + len(y) - 2 * start + 2)
    return weight


def sift4_extended(a: str, b: str, reach: int = 5, limit: float = 0, tokens=list, same=operator.eq, quality=lambda x, y: 1, run_value=lambda n: n, cross_cost=lambda p, q: 1, total=lambda runs, crossed: runs - crossed) -> int:
    """Linear-time estimate of the edit distance: runs of equal tokens, found again within `reach` places; every part of the estimate may be replaced, and a `limit` other than 0 ends it there."""
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return len(x) + len(y)
    i = j = 0
    run = runs = crossed = 0.0
    seen: list[list] = []  # places of equal tokens, and whether they count as crossed
    while i < len(x) and j < len(y):
        if same(x[i], y[j]):
            run += quality(x[i], y[j])
            cross, kept = False, []
            for k, (p, q, was) in enumerate(seen):
                if i <= p or j <= q:
                    cross = abs(j - i) >= abs(q - p)
                    if cross or not was:
                        crossed += cross_cost(i, j) if cross else cross_cost(q, p)
                    seen[k][2] = was or not cross
                    kept += seen[k:]
                    break
                if not (i > q and j > p):
                    kept.append(seen[k])
            seen = [*kept, [i, j, cross]]
        else:
            runs, run = runs + run_value(run), 0
            i = j = min(i, j)
            for step in range(reach):
                if i + step < len(x) and same(x[i + step], y[j]):
                    i, j = i + step - 1, j - 1
                    break
                if j + step < len(y) and same(x[i], y[j + step]):
                    i, j = i - 1, j + step - 1
                    break
        i, j = i + 1, j + 1
        if limit and (so_far := run_value(max(i, j)) - total(runs, crossed)) >= limit:
            return round(so_far)
        if i >= len(x) or j >= len(y):
            runs, run = runs + run_value(run), 0
            i = j = min(i, j)
    return round(run_value(max(len(x), len(y))) - total(runs + run_value(run), crossed))


#: Parts of the extended estimate: likeness of tokens, runs that count for more, and crossings that cost more the longer they are.
def sift4_alike(x: str, y: str) -> bool:
    return sift4(x, y) > 0.7


def longer_runs(n: float) -> float:
    return 1 if n < 1 else n - 1 / (n + 1)


def much_longer_runs(n: float) -> float:
    return n**1.5


def longer_crossings(p: int, q: int) -> float:
    return abs(q - p) / 9 + 1


def sift4(a: str, b: str, reach: int = 5) -> float:
    return edits.of_longer(sift4_extended(a, b, reach), a, b)


def sift4_grams(a: str, b: str) -> float:
    """The extended estimate of 2-grams."""
    return edits.of_longer(sift4_extended(a, b, tokens=edits.grams), edits.grams(a), edits.grams(b))


def sift4_simplest(a: str, b: str, reach: int = 5) -> float:
    """Sift4 without crossings; the places only move on."""
    i = j = run = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            run += 1
        else:
            i = j = max(i, j)
            x, y = a[i : i + 1], b[j : j + 1]
            for step in range(reach):
                if y and a[i + step : i + step + 1] == y:
                    i, run = i + step, run + 1
                    break
                if x and b[j + step : j + step + 1] == x:
                    j, run = j + step, run + 1
                    break
        i, j = i + 1, j + 1
    longer = max(len(a), len(b))
    return run / longer if longer else 1.0


def baystat(a: str, b: str) -> float:
    """Letters in substrings found again near their place; from seven letters on they have two letters at least and may be two places off."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    least, slack = (2, 2) if size >= 7 else (1, 0)
    at = hits = 0
    while a and b and at + least <= len(a):
        left = max(0, at - slack)
        right = min(slack, len(b) - at - least)
        n, found = least, 0
        while a[at : at + n] in b[left : max(left, at + least + right)] and at + found + 1 <= len(a):
            found += 1
            hit = a[at : at + n]
            if at + least + found <= len(a):
                n = least + found
            if at + least + right + 1 <= len(b):
                right += 1
        if found:
            b = b.replace(hit, "#" * len(hit))
            hits += len(hit)
        at += found + 1
    return hits / size


def rees_levenshtein(a: str, b: str, limit: int = 2) -> float:
    """Edits in which neighbouring blocks of up to `limit` letters may change places at the price of their length; blocks are read two letters before their place, as published."""
    if a == b:
        return 1.0
    longer = max(len(a), len(b))
    start = edits.shared_prefix(a, b)
    x, y = a[start:], b[start:]
    end = edits.shared_prefix(x[::-1], y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not x or not y or len(x) == len(y) == 1:
        return 1 - max(len(x), len(y)) / longer

    def block(s: str, at: int, n: int) -> str:
        at += -1 if at > 0 else len(s) - 1
        return s[at : at + n]

    largest = max(1, min(len(x) // 2, len(y) // 2, limit))
    cost = [[i + j if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            n = next((n for n in range(largest, 0, -1) if min(i, j) >= 2 * n and block(x, i - 2 * n - 1, n) == block(y, j - n - 1, n) and block(x, i - n - 1, n) == block(y, j - 2 * n - 1, n)), 0)
            moved = cost[i - 2 * n][j - 2 * n] + n - 1 if n else cost[i - 1][j - 1]
            cost[i][j] = min(cost[i][j - 1] + 1, cost[i - 1][j] + 1, moved + (x[i - 1] != y[j - 1]))
    return 1 - cost[-1][-1] / longer


def saps(a: str, b: str) -> float:
    """Alignment of syllables: their first letters weigh more, and match only one another."""
    parts = tokenizers.saps_syllables(a), tokenizers.saps_syllables(b)
    x, y = ("".join(s.capitalize() for s in side) for side in parts)

    def change(i: int, j: int) -> int:
        if x[i].isupper() != y[j].isupper():
            return 4
        same, other = (-6, 2) if x[i].isupper() else (-1, 1)
        return same if x[i] == y[j] else other

    lone = lambda c: 3 if c.isupper() else 1
    score = -grid(x, y, lambda i, j: lone(x[i]), lambda i, j: lone(y[j]), change)[-1][-1]
    return score / max(sum(5 + len(s) for s in side) for side in parts) if score > 0 else 0.0


def cao(a: str, b: str) -> float:
    """Cao's CYd dissimilarity of bigram counts, out of the largest that such counts allow."""
    if a == b:
        return 1.0
    x, y = Counter(edits.grams(a)), Counter(edits.grams(b))
    shared = [k for k in x if k in y]
    if not shared:
        return 0.0
    term = lambda p, q: ((p + q) * math.log10((p + q) / 2) - p * math.log10(q) - q * math.log10(p)) / (p + q)
    seen = sum(term(max(0.1, x[k]), max(0.1, y[k])) for k in x | y)
    half = len(shared) / 2
    most = sum(term(x[k] or y[k], 0.1) for k in x | y if not (x[k] and y[k])) + half * sum(term(sum(side[k] for k in shared) / half - 1, 1) for side in (x, y))
    return max(0.0, min(1.0, 1 - seen / most))


def minhash(a: str, b: str, k: int = 0, seed: int = 10) -> float:
    """The share of k masked minima of the bigrams' SHA-512 numbers that agree; k is the larger number of bigrams unless given."""
    x, y = set(edits.grams(a)), set(edits.grams(b))
    k = k or max(len(x), len(y))
    if not k:
        return 1.0
    bounds = np.iinfo(np.int64)
    masks = [int(m) for m in np.random.RandomState(seed).randint(bounds.min, bounds.max, k, dtype=np.int64)]
    numbers = [[int(hashlib.sha512(t.encode()).hexdigest(), 16) for t in side] for side in (x, y)]
    return sum(len({min([bounds.max, *(m ^ n for n in side)]) for side in numbers}) == 1 for m in masks) / k


def meta_levenshtein(a: str, b: str) -> float:
    """Edits of bigrams; a change costs how unlike the two are, weighted by their tf-idf in a corpus of the pair and an empty document."""
    if a == b or not a or not b:
        return float(a == b)
    x, y = edits.grams(a), edits.grams(b)
    idf = lambda t: math.log1p(3 / ((t in x) + (t in y)))
    weights = [{t: math.log1p(n) * idf(t) for t, n in Counter(side).items()} for side in (x, y)]
    unlike = {(p, q): (1 - edits.jaro_winkler(p, q)) * weights[0][p] * weights[1][q] for p in weights[0] for q in weights[1]}
    one = lambda i, j: 1.0
    return 1 - grid(x, y, one, one, lambda i, j: unlike[x[i], y[j]])[-1][-1] / max(len(a), len(b))


def aligned(a: str, b: str) -> list[tuple[str | None, str | None]]:
    """Letters side by side by the fewest edits, None for a gap; seen from the end, a letter of b comes alone if it can, then one of a."""
    one = lambda i, j: 1
    cost = grid(a, b, one, one, lambda i, j: a[i] != b[j])
    i, j, steps = len(a), len(b), []
    while i or j:
        if j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
            steps.append((None, b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            steps.append((a[i], None))
        else:
            i, j = i - 1, j - 1
            steps.append((a[i], b[j]))
    return steps[::-1]


def inclusion(a: str, b: str) -> float:
    """1 if, aligned, one string stands inside the other with at most one difference and three letters agree."""
    if a == b or len(a) == len(b):
        return float(a == b)
    steps = [2 if None in step else int(step[0] != step[1]) for step in aligned(a, b)]  # 2: a gap
    inner = steps[next((k for k, s in enumerate(steps) if s != 2), len(steps)) :]
    while inner and inner[-1] == 2:
        inner.pop()
    differ = sum(s > 0 for s in inner)
    return float(differ <= 1 and len(inner) - differ >= 3)


def _chao(a: str, b: str) -> tuple[float, float]:
    """Estimated shares of either side's bigrams that the other has, from one resample of each; drawn by a seed from the pair, so a pair always gives the same."""
    x, y = edits.grams(a), edits.grams(b)
    if not set(x) & set(y):
        return 0.0, 0.0
    draw = random.Random(zlib.crc32(f"{a}\0{b}".encode("utf-8", "surrogatepass")))
    p, q = (Counter(draw.choices(side, k=len(side))) for side in (x, y))
    shared = [(p[k], q[k]) for k in p if k in q]

    def share(mine: int, other: int) -> float:
        sizes = len(x), len(y)
        once, twice = (sum(pair[other] == n for pair in shared) for n in (1, 2))
        unseen = (sizes[other] - 1) / sizes[other] * once / (2 * (twice or 1))
        return sum(pair[mine] * (1 + unseen * (pair[other] == 1)) for pair in shared) / sizes[mine]

    return share(0, 1), share(1, 0)


def chao_jaccard(a: str, b: str) -> float:
    u, v = _chao(a, b)
    return max(0.0, min(1.0, u * v / (u + v - u * v))) if u * v else 0.0


def chao_dice(a: str, b: str) -> float:
    u, v = _chao(a, b)
    return max(0.0, min(1.0, 2 * u * v / (u + v))) if u * v else 0.0


def chebyshev(a: str, b: str) -> float:
    """The largest difference of a bigram's counts; a distance."""
    x, y = Counter(edits.grams(a)), Counter(edits.grams(b))
    return float(max((abs(x[k] - y[k]) for k in x | y), default=0))


# Covington's costs of a match of consonants or glides, of vowels, of vowels that differ in length (or i with y, u with w), of two vowels, of two consonants, of one of each, of a skip after a skip, and of another skip.
_COVINGTON = 0, 5, 10, 30, 60, 100, 40, 50
_PLAIN_VOWELS, _PLAIN_CONSONANTS = frozenset("aeiou"), frozenset("bcdfghjklmnpqrstvxz")


def _sounds(s: str, t: str, costs: tuple[float, ...]) -> float:
    if s == t:
        return costs[0] if s in _PLAIN_CONSONANTS or s in "wy" else costs[1]
    x, y = normalize("NFKD", s)[0], normalize("NFKD", t)[0]
    if {s, t} in ({"i", "y"}, {"u", "w"}) or x == y and s in _PLAIN_VOWELS:
        return costs[2]
    if x in _PLAIN_VOWELS and y in _PLAIN_VOWELS:
        return costs[3]
    return costs[4] if x in _PLAIN_CONSONANTS and y in _PLAIN_CONSONANTS else costs[5]


def covington_cost(a: str, b: str, costs: tuple[float, ...] = _COVINGTON) -> float:
    """The least cost of an alignment in which skips on one side do not follow skips on the other: three grids, by the last step."""
    best = {(0, 0): (0.0, math.inf, math.inf)}  # after a match, a skip in a, a skip in b
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                over, left, up = (best.get(k, (math.inf,) * 3) for k in ((i - 1, j - 1), (i, j - 1), (i - 1, j)))
                match = min(over) + (_sounds(a[i - 1], b[j - 1], costs) if i and j else 0)
                best[i, j] = match, min(left[0] + costs[7], left[1] + costs[6]), min(up[0] + costs[7], up[2] + costs[6])
    return min(best[len(a), len(b)])


def covington(a: str, b: str, costs: tuple[float, ...] = _COVINGTON) -> float:
    """The cost as a share of the worst one, from one."""
    apart = abs(len(a) - len(b))
    worst = costs[5] * min(len(a), len(b)) + (costs[7] if apart else 0) + costs[6] * abs(apart - 1)
    return 1 - covington_cost(a, b, costs) / worst


KERNELS = {
    "covington": covington, "typo_azerty": lambda a, b: typo(a, b, layout="AZERTY"), "typo_dvorak": lambda a, b: typo(a, b, layout="Dvorak"), "typo_qwertz": lambda a, b: typo(a, b, layout="QWERTZ"),
    "cao": cao, "chao_dice": chao_dice, "chao_jaccard": chao_jaccard, "inclusion": inclusion, "meta_levenshtein": meta_levenshtein, "min_hash": minhash, "rees_levenshtein": rees_levenshtein, "saps": saps,
    "baystat": baystat, "block_levenshtein": block_levenshtein, "chebyshev": chebyshev, "cormode_lz": cormode_lz, "discounted_levenshtein": discounted_levenshtein, "editex": editex, "eudex": phonetics.eudex_similarity, "fellegi_sunter": fellegi_sunter, "flex_metric": flex_metric,
    "guth": guth, "isg": isg, "mra": match_rating, "ncd_arith": arithmetic.similarity, "ozbay": ozbay, "shapira_storer_i": shapira_storer, "sift4": sift4, "sift4_extended": sift4_grams, "sift4_simplest": sift4_simplest, "ssk": ssk, "strcmp95": strcmp95, "typo": typo, "vps": positional_substrings,
}
NAMES = sorted(KERNELS)


def similarity(name: str, src: Column, tar: Column) -> Column:
    return edits.vectorised(KERNELS[name])(src, tar)


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = measures.pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))
        return pairs.select("id", "src", "tar", F.round(similarity(name, F.col("src"), F.col("tar")), 9).alias("sim"))

    return run
