"""Edit, alignment, subsequence, linkage and compression measures of string pairs.

Each kernel takes two strings and gives a similarity; Arrow-vectorised UDFs evaluate them
batch by batch, and null on either side gives null. `levenshtein`, and the measures
that only look at ends and lengths, are built of Spark's own functions instead.
"""

from __future__ import annotations

import bz2
import lzma
import math
import zlib
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import measures


def grams(s: str, q: int = 2, pads: str = "$#") -> list[str]:
    if not s:
        return []
    if pads:
        s = pads[0] * (q - 1) + s + pads[1] * (q - 1)
    return [s[i : i + q] for i in range(len(s) - q + 1)]


def edit_distance(a, b, swap: bool = False, substitute: float = 1) -> float:
    """Levenshtein distance, with neighbours swapped at cost 1 if `swap`."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y) * substitute))
            if swap and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


def of_longer(distance: float, a, b) -> float:
    longer = max(len(a), len(b))
    return 1 - distance / longer if longer else 1.0


def levenshtein(a: str, b: str) -> float:
    return of_longer(edit_distance(a, b), a, b)


def damerau(a: str, b: str) -> float:
    """Distance with swaps of letters between which others may be edited."""
    seen: dict[str, int] = {}
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), match
            equal = a[i - 1] == b[j - 1]
            if equal:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not equal), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def indel(a: str, b: str) -> float:
    return 1 - edit_distance(a, b, substitute=2) / (len(a) + len(b)) if a or b else 1.0


def yujian_bo(a: str, b: str) -> float:
    d = edit_distance(a, b)
    return 1 - 2 * d / (len(a) + len(b) + d) if a or b else 1.0


def hamming(a: str, b: str) -> float:
    return of_longer(sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)), a, b)


def relaxed_hamming(a: str, b: str, slack: int = 2, discount: float = 0.2) -> float:
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    x, y = list(a) + [None] * (size - len(a)), list(b) + [None] * (size - len(b))
    cost = 0.0
    for i in range(size):
        if x[i] != y[i]:
            near = [abs(k) for k in range(-slack, slack + 1) if 0 <= i + k < size and x[i] is not None and y[i + k] == x[i]]
            cost += discount * min(near) if near else 1
    return 1 - cost / size


def jaro(a: str, b: str, boost: bool = False) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == x:
                hit_a[i] = hit_b[j] = True
                break
    x, y = [c for c, h in zip(a, hit_a) if h], [c for c, h in zip(b, hit_b) if h]
    m = len(x)
    if not m:
        return 0.0
    score = (m / len(a) + m / len(b) + (m - sum(p != q for p, q in zip(x, y)) // 2) / m) / 3
    if boost and score > 0.7:
        score += shared_prefix(a[:4], b[:4]) * 0.1 * (1 - score)
    return score


def jaro_winkler(a: str, b: str) -> float:
    return jaro(a, b, True)


def shared_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        last, row = row[1:], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def common_substring(a: str, b: str) -> tuple[int, int, int]:
    """Length and places of the longest common substring."""
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        n = max(row)
        if n > best[0]:
            best = (n, i - n + 1, row.index(n) - n)
    return best


def lcsseq(a: str, b: str) -> float:
    return common_subsequence(a, b) / max(len(a), len(b)) if a or b else 1.0


def lcsstr(a: str, b: str) -> float:
    return common_substring(a, b)[0] / max(len(a), len(b)) if a or b else 1.0


def aligned(a: str, b: str, local: bool = False) -> float:
    """Score of the alignment: 1 for equal letters, -1 for a gap; a local one is that of the last cell."""
    row = [0 if local else -j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [0 if local else -i]
        for j, y in enumerate(b, 1):
            best = max(last[j - 1] + (x == y), last[j] - 1, row[-1] - 1)
            row.append(max(0, best) if local else best)
    return row[-1]


def needleman_wunsch(a: str, b: str) -> float:
    return 1.0 if a == b else max(0, aligned(a, b)) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def smith_waterman(a: str, b: str) -> float:
    return 1.0 if a == b else aligned(a, b, True) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def gotoh(a: str, b: str, start: float = 1, go_on: float = 0.4) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    low = -math.inf
    d = [0.0] + [-start - go_on * (j - 1) for j in range(1, len(b) + 1)]
    q = [low] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, d, p = d, [-start - go_on * (i - 1)], low
        for j, y in enumerate(b, 1):
            p = max(d[-1] - start, p - go_on)
            q[j] = max(before[j] - start, q[j] - go_on)
            d.append(max(before[j - 1] + (x == y), p, q[j]))
    return max(0, d[-1]) / math.sqrt(len(a) * len(b))


def f_measure(recall: float, precision: float, beta: float = 8) -> float:
    return (1 + beta**2) * recall * precision / (recall + beta**2 * precision) if recall and precision else 0.0


def rouge_l(a: str, b: str) -> float:
    n = common_subsequence(a, b)
    return 1.0 if a == b else f_measure(n / len(a), n / len(b)) if n else 0.0


def rouge_w(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    total, run = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                k = run[i][j]
                total[i + 1][j + 1], run[i + 1][j + 1] = total[i][j] + (k + 1) ** 2 - k**2, k + 1
            else:
                total[i + 1][j + 1] = max(total[i][j + 1], total[i + 1][j])
    w = total[-1][-1]
    return f_measure(math.sqrt(w) / len(a), math.sqrt(w) / len(b))


def rouge_s(a: str, b: str, lead: str = "") -> float:
    if a == b:
        return 1.0
    x, y = (Counter(combinations(lead + s, 2)) for s in (a, b))
    n = sum((x & y).values())
    return f_measure(n / sum(x.values()), n / sum(y.values())) if n else 0.0


def rouge_su(a: str, b: str) -> float:
    return rouge_s(a, b, "$")


def bleu(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = Counter(grams(a, n, "")), Counter(grams(b, n, ""))
        hit = sum((x & y).values())
        logs += 0.25 * math.log(hit / sum(x.values())) if hit else 0.0
    return math.exp(logs) * (1 if len(a) > len(b) else math.exp(1 - len(b) / len(a)))


def positional(a: str, b: str) -> int:
    """Bigrams that match within one place."""
    x, y = grams(a), grams(b)
    used, n = [False] * len(y), 0
    for i, g in enumerate(x):
        for j in range(max(0, i - 1), min(len(y), i + 2)):
            if not used[j] and y[j] == g:
                used[j] = True
                n += 1
                break
    return n


def positional_q_gram_dice(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * positional(a, b) / max(1, len(grams(a)) + len(grams(b)))


def positional_q_gram_jaccard(a: str, b: str) -> float:
    n = positional(a, b)
    return 1.0 if a == b else n / max(1, len(grams(a)) + len(grams(b)) - n)


def positional_q_gram_overlap(a: str, b: str) -> float:
    return 1.0 if a == b else positional(a, b) / max(1, min(len(grams(a)), len(grams(b))))


def marks(a: str, b: str) -> int:
    """Letters of a to mark so that the pieces between them all occur in b."""
    n, piece = 0, ""
    for x in a:
        if piece + x in b:
            piece += x
        else:
            n, piece = n + 1, ""
    return n


def marking(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - marks(a, b) / len(a) if a else 0.0


def marking_metric(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - math.log2((marks(a, b) + 1) * (marks(b, a) + 1)) / math.log2((len(a) + 1) * (len(b) + 1))


def tichy(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not b:
        return 0.0
    cost = at = 0
    while at < len(b):
        n = 0
        while at + n < len(b) and b[at : at + n + 1] in a:
            n += 1
        cost, at = cost + 1, at + max(1, n)
    return 1 - cost / len(b)


def iterative_substring(a: str, b: str, hamacher: float = 0.6) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y, shared = a, b, 0
    while x and y:
        n, i, j = common_substring(x, y)
        if n <= 2:
            break
        shared, x, y = shared + n, x[:i] + x[i + n :], y[:j] + y[j + n :]
    common = 2 * shared / (len(a) + len(b))
    p, q = len(x) / len(a), len(y) / len(b)
    apart = p * q / (hamacher + (1 - hamacher) * (p + q - p * q)) if p * q else 0.0
    return (1 + common - apart + shared_prefix(a[:4], b[:4]) * 0.1 * (1 - common)) / 2


def higuera_mico(a: str, b: str) -> float:
    """Contextual normalised edit distance: an operation costs one over the string's length at that time."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m, n = len(a), len(b)
    none = -math.inf
    last = [[j if k == j else none for k in range(m + n + 1)] for j in range(n + 1)]  # most insertions with k operations
    for i in range(1, m + 1):
        row = [[0 if k == i else none for k in range(m + n + 1)]]
        for j in range(1, n + 1):
            free = a[i - 1] == b[j - 1]
            cell = []
            for k in range(m + n + 1):
                via = [last[j - 1][k]] if free else []
                if k:
                    via += [last[j][k - 1], row[j - 1][k - 1] + 1] + ([] if free else [last[j - 1][k - 1]])
                cell.append(max(via, default=none))
            row.append(cell)
        last = row
    best = math.inf
    for k, ins in enumerate(last[n]):
        if ins != none:
            ins, top = int(ins), m + int(ins)
            subst = k - ins - (top - n)
            if subst >= 0 and top:
                best = min(best, sum(1 / t for t in range(m + 1, top + 1)) + subst / top + sum(1 / t for t in range(n + 1, top + 1)))
    return 1 - min(1.0, best)


def lig3(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = 2 * sum(x == y for x, y in zip(a, b))
    return n / (n + edit_distance(a, b))


def mlipns(a: str, b: str, threshold: float = 0.25, most: int = 2) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    apart, size = sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)), max(len(a), len(b))
    for _ in range(most + 1):
        if size < 1 or 1 - (size - apart) / size <= threshold:
            return 1.0
        apart, size = apart - 1, size - 1
    return 0.0


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def ratcliff_obershelp(a: str, b: str) -> float:
    return 1.0 if a == b else ratio(a, b)


def fuzzywuzzy_partial_string(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    return max(ratio(short, long_[i : i + len(short)]) for i in range(len(long_) - len(short) + 1)) if short else 0.0


def fuzzywuzzy_token_sort(a: str, b: str) -> float:
    return 1.0 if a == b else ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def fuzzywuzzy_token_set(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = both + " " + " ".join(sorted(x - y)), both + " " + " ".join(sorted(y - x))
    return max(ratio(both, left), ratio(both, right), ratio(left, right))


def linkage(kind: str):
    def similarity(a: str, b: str) -> float:
        if a == b:
            return 1.0
        d = [1 - levenshtein(x, y) for x in grams(a) for y in grams(b)]
        if not d:
            return 0.0
        return 1 - (min(d) if kind == "single" else max(d) if kind == "complete" else sum(d) / len(d))

    return similarity


def monge_elkan(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = grams(a), grams(b)
    return sum(max(levenshtein(s, t) for t in y) for s in x) / len(x) if x and y else 0.0


def soft_cosine(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = Counter(grams(a)), Counter(grams(b))
    if not x or not y:
        return 0.0
    product = lambda u, v: sum(m * n / (1 + edit_distance(s, t)) for s, m in u.items() for t, n in v.items())
    return product(x, y) / math.sqrt(product(x, x) * product(y, y))


def bisim(a: str, b: str) -> float:
    """Alignment of bigrams that count half for each equal letter in its place."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = grams(a[0].swapcase() + a, 2, ""), grams(b[0].swapcase() + b, 2, "")
    row = [0.0] * (len(y) + 1)
    for g in x:
        last, row = row, [0.0]
        for j, h in enumerate(y):
            row.append(max(row[-1], last[j + 1], last[j] + (g[0] == h[0]) / 2 + (g[1] == h[1]) / 2))
    return row[-1] / max(len(a), len(b))


def tf_idf(a: str, b: str, soft: bool = False, threshold: float = 0.9) -> float:
    """Cosine of log1p(tf) * log1p(3 / df) weights, the two strings being the corpus; if soft, other tokens match their nearest."""
    if a == b:
        return 1.0
    x, y = Counter(grams(a)), Counter(grams(b))
    if not x or not y:
        return 0.0
    u, v = ({t: math.log1p(n) * math.log1p(3 / ((t in x) + (t in y))) for t, n in z.items()} for z in (x, y))
    total = sum(u[t] * v[t] for t in x.keys() & y.keys())
    if soft:
        near = sorted((-s, p, q) for p in x.keys() - y.keys() for q in y.keys() - x.keys() if (s := jaro_winkler(p, q)) > threshold)
        used: set[tuple[int, str]] = set()
        for s, p, q in near:
            if (0, p) not in used and (1, q) not in used:
                used |= {(0, p), (1, q)}
                total -= s * u[p] * v[q]
    return total / math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))


def _cells(a: str, b: str) -> tuple[int, ...]:
    x, y = Counter(grams(a)), Counter(grams(b))
    both = sum((x & y).values())
    return both, sum(x.values()) - both, sum(y.values()) - both, max(0, measures.ALPHABET - len(x | y))


def _log_factorial(n: float) -> float:
    return math.lgamma(n + 1)


def _by_chance(p: int, q: int, i: int, n: int) -> float:
    """Probability of i shared tokens of p and q among n."""
    f = _log_factorial
    return math.exp(f(p) + f(q) + f(n - p) + f(n - q) - f(n) - f(i) - f(p - i) - f(q - i) - f(n - p - q + i)) if p + q - n <= i <= min(p, q) else 0.0


def henderson_heron(a: str, b: str) -> float:
    i, j, k, d = _cells(a, b)
    return 1 - _by_chance(i + j, i + k, i, i + j + k + d)


def raup_crick(a: str, b: str) -> float:
    if a == b:
        return 1.0
    i, j, k, d = _cells(a, b)
    return sum(_by_chance(i + j, i + k, t, i + j + k + d) for t in range(i + 1))


def gilbert_wells(a: str, b: str) -> float:
    def score(i, j, k, d):
        f, least = _log_factorial, 2.220446049250313e-16
        p, q, r, s, n = i + j, i + k, k + d, j + d, i + j + k + d
        return math.log(max(least, n**3) / (2 * math.pi * max(least, p) * max(least, q) * max(least, r) * max(least, s))) + 2 * (f(n) + f(i) + f(j) + f(k) + f(d) - f(p) - f(q) - f(r) - f(s))

    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return score(*_cells(a, b)) / max(score(*_cells(a, a)), score(*_cells(b, b)))


def run_length(s: str) -> str:
    out, at = [], 0
    while at < len(s):
        n = 1
        while at + n < len(s) and s[at + n] == s[at]:
            n += 1
        out.append(f"{n}{s[at]}" if n > 2 else s[at] * n)
        at += n
    return "".join(out)


def burrows_wheeler(s: str, end: str = "\0") -> str:
    s += end
    return "".join(x[-1] for x in sorted(s[i:] + s[:i] for i in range(len(s))))


#: As preset 6, with the least dictionary.
_SHORT = [{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": 4096}]


def lzma_size(s: str) -> int:
    """Bytes under preset 6, less 14.

    Its tables are made for 8 MB and cost more than a short text. The size of the dictionary decides only how positions share
    them; up to 48 bytes, the most positions that preset 6 looks at for a match, all of a place are seen and the output is as long.
    """
    data = s.encode()
    return len(lzma.compress(data, filters=_SHORT) if len(data) <= 48 else lzma.compress(data, preset=6)) - 14


def compression(size, less: int = 0):
    def similarity(a: str, b: str) -> float:
        if a == b:
            return 1.0
        x, y, xy, yx = size(a), size(b), size(a + b), size(b + a)
        return 1 - (min(xy, yx) - min(x, y)) / (max(x, y) - less)

    return similarity


KERNELS = {
    "osa": lambda a, b: of_longer(edit_distance(a, b, True), a, b), "damerau_levenshtein": lambda a, b: of_longer(damerau(a, b), a, b),
    "indel": indel, "yujian_bo": yujian_bo, "hamming": hamming, "relaxed_hamming": relaxed_hamming, "jaro": jaro, "jaro_winkler": jaro_winkler, "lcsseq": lcsseq, "lcsstr": lcsstr,
    "needleman_wunsch": needleman_wunsch, "smith_waterman": smith_waterman, "gotoh": gotoh, "rouge_l": rouge_l, "rouge_w": rouge_w, "rouge_s": rouge_s, "rouge_su": rouge_su, "bleu": bleu,
    "positional_q_gram_dice": positional_q_gram_dice, "positional_q_gram_jaccard": positional_q_gram_jaccard, "positional_q_gram_overlap": positional_q_gram_overlap,
    "marking": marking, "marking_metric": marking_metric, "tichy": tichy, "iterative_substring": iterative_substring, "higuera_mico": higuera_mico, "lig3": lig3, "mlipns": mlipns,
    "ratcliff_obershelp": ratcliff_obershelp, "fuzzywuzzy_partial_string": fuzzywuzzy_partial_string, "fuzzywuzzy_token_sort": fuzzywuzzy_token_sort, "fuzzywuzzy_token_set": fuzzywuzzy_token_set,
    "average_linkage": linkage("average"), "complete_linkage": linkage("complete"), "single_linkage": linkage("single"), "monge_elkan": monge_elkan, "soft_cosine": soft_cosine,
    "bisim": bisim, "tf_idf": tf_idf, "soft_tf_idf": lambda a, b: tf_idf(a, b, True),
    "henderson_heron": henderson_heron, "raup_crick": raup_crick, "gilbert_wells": gilbert_wells,
    "ncd_rle": compression(lambda s: len(run_length(s))), "ncd_bwtrle": compression(lambda s: len(run_length(burrows_wheeler(s)))), "ncd_bz2": compression(lambda s: len(bz2.compress(s.encode(), 9)) - 10),
    "ncd_lzma": compression(lzma_size), "ncd_zlib": compression(lambda s: len(zlib.compress(s.encode())), 2),
}


def kernel(name: str):
    """The named kernel as an Arrow-vectorised UDF of two string columns."""
    return vectorised(KERNELS[name])


#: Bytes, roughly, that a memo of results may take.
REMEMBERED = 32 << 20


def remembered(fn):
    """A function of strings that keeps its results by the arguments; when they are too many it drops them and begins anew."""
    known: dict[tuple[str, ...], object] = {}
    room = REMEMBERED

    def call(*args: str):
        nonlocal room
        if args not in known:
            size = 600 + 2 * sum(map(len, args))
            if size > room:
                known.clear()
                room = REMEMBERED
            known[args], room = fn(*args), room - size
        return known[args]

    return call


def vectorised(fn):
    """A function of two strings as a UDF; each task has its own copy, which remembers pairs over batches. Null on either side gives null."""
    known = remembered(fn)

    def batch(src: pd.Series, tar: pd.Series) -> pd.Series:
        return pd.Series([None if None in pair else float(known(*pair)) for pair in zip(src, tar)], dtype="float64")

    return F.pandas_udf(batch, "double")


def _longer(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def _ends(a: Column, b: Column, suffix: bool = False) -> Column:
    """Length of the longest shared prefix (suffix)."""
    if suffix:
        a, b = F.reverse(a), F.reverse(b)
    shorter = F.least(F.length(a), F.length(b))
    places = F.when(shorter == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), shorter)))
    return F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def _safe(num: Column, den: Column, a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(den == 0, 0.0).otherwise(num / F.nullif(den, F.lit(0)))


#: Measures of Spark's own functions.
NATIVE = {
    "levenshtein": lambda a, b: F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(_longer(a, b), F.lit(0))),
    "ident": lambda a, b: (a == b).cast("double"),
    "length": lambda a, b: _safe(F.least(F.length(a), F.length(b)), _longer(a, b), a, b),
    "lcprefix": lambda a, b: _safe(_ends(a, b), _longer(a, b), a, b),
    "lcsuffix": lambda a, b: _safe(_ends(a, b, True), _longer(a, b), a, b),
    "prefix": lambda a, b: _safe(_ends(a, b), F.least(F.length(a), F.length(b)), a, b),
    "suffix": lambda a, b: _safe(_ends(a, b, True), F.least(F.length(a), F.length(b)), a, b),
}
_PREFIX = "coalesce(list_max(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, 1, i) = substr({1}, 1, i))), 0)"
_P, _S = _PREFIX.format("src", "tar"), _PREFIX.format("reverse(src)", "reverse(tar)")
#: DuckDB expressions over src and tar.
SQL = {
    "levenshtein": "1 - levenshtein(src, tar)/greatest(length(src), length(tar))",
    "damerau_levenshtein": "1 - damerau_levenshtein(src, tar)/greatest(length(src), length(tar))",
    "jaro": "jaro_similarity(src, tar)",
    "jaro_winkler": "jaro_winkler_similarity(src, tar)",
    "ident": "(src = tar)::double",
    "length": "least(length(src), length(tar))/greatest(length(src), length(tar))",
    "lcprefix": f"{_P}/greatest(length(src), length(tar))",
    "lcsuffix": f"{_S}/greatest(length(src), length(tar))",
    "prefix": f"{_P}/least(length(src), length(tar))",
    "suffix": f"{_S}/least(length(src), length(tar))",
}
NAMES = sorted({*KERNELS, *NATIVE})


def similarity(name: str, src: Column, tar: Column) -> Column:
    """Null on either side gives null."""
    return F.when(src.isNotNull() & tar.isNotNull(), NATIVE[name](src, tar)) if name in NATIVE else kernel(name)(src, tar)


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = measures.pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"), dealt=name in KERNELS)
        return pairs.select("id", "src", "tar", F.round(similarity(name, F.col("src"), F.col("tar")).cast("double"), 9).alias("sim"))

    return run


def sql(name: str) -> str:
    return f"with {measures.PAIRS_SQL} select id, src, tar, round(({SQL[name]})::double, 9) as sim from pairs"
