"""Arithmetic coding with exact fractions; a NUL ends the text."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

END = "\0"
Ranges = dict[str, tuple[Fraction, Fraction]]


def train(text: str) -> Ranges:
    """The part of [0, 1) of each character, the commonest first; a NUL in the text counts as a space."""
    counts = Counter(text.replace(END, " ")) + Counter(END)
    whole, start, ranges = sum(counts.values()), 0, {}
    for n, char in sorted(((n, c) for c, n in counts.items()), reverse=True):
        ranges[char] = Fraction(start, whole), Fraction(start + n, whole)
        start += n
    return ranges


def encode(text: str, ranges: Ranges) -> tuple[int, int]:
    """A number and how many bits it has."""
    low, width = Fraction(0), Fraction(1)
    for char in text.replace(END, " ") + END:
        begin, end = ranges[char]
        low, width = low + begin * width, width * (end - begin)
    bits = 0
    while (width / 2) * 2**bits < 1:
        bits += 1
    return (int((low + width / 2) * 2**bits), bits) if bits else (0, 0)


def decode(number: int, bits: int, ranges: Ranges) -> str:
    at, text = Fraction(number, 2**bits), []
    while True:
        char, (begin, end) = next((c, r) for c, r in ranges.items() if r[0] <= at < r[1])
        if char == END:
            return "".join(text)
        text.append(char)
        at = (at - begin) / (end - begin)


def similarity(a: str, b: str) -> float:
    """Normalized compression distance from one, the code learnt from both strings."""
    if a == b:
        return 1.0
    ranges = train(a + b)
    size = lambda s: encode(s, ranges)[1]
    x, y = size(a), size(b)
    return 1 - (min(size(a + b), size(b + a)) - min(x, y)) / max(x, y)
