"""Token ids of whole texts by a public tokenizer, through the distinct words of a chunk.

The word tokenizer drops white space, then matches a letter run, a digit, an English ending after an
apostrophe or a run of other characters; none of these spans white space, or a change between ASCII
letters, digits and punctuation other than an apostrophe. So the ids of a text are those of the pieces
between such places, in order. Each distinct piece (A-Z lower-cased, as the tokenizer does) is
encoded once and kept in a worker's cache of at most CACHE pieces, found by hash and compared byte by byte. Pieces go to the library
together, separated by its end token. A text that holds a special token's opening `<|` goes to
the library whole, as only there it can be special.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np

from .common import LOWER, Spans, numbered, ragged, span_hashes

#: Pieces and bytes of them that a worker remembers (more only while a chunk needs them), and pieces that go to the library at once.
CACHE, CACHE_BYTES, TOGETHER = 1_000_000, 64 << 20, 2000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another version are never reused."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Cache:
    """Pieces with the places of their ids, by slot."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.pieces, self.start, self.length, self.ids = Spans(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate((self.start, np.cumsum(length) - length + len(self.ids)))
        self.length, self.ids = np.concatenate((self.length, length)), np.concatenate((self.ids, ids))


@lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache()


#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 punctuation, 4 others, which are never cut off.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = 0
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[b for b in range(0x21, 0x7F) if _CLASS[b] == 4 and b != 0x27]] = 3
#: Whether a piece begins between two classes (row: before, column: after).
_CUT = np.zeros((5, 5), bool)
_CUT[0, 1:] = True
_CUT[1:4, 1:4] = ~np.eye(3, dtype=bool)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _CLASS[data]
    begins = np.empty(len(data), bool)
    begins[1:] = _CUT[kind[:-1], kind[1:]]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = kind[firsts] != 0
    stops = kind != 0
    stops[:-1] &= begins[1:] | (kind[1:] == 0)
    stops[firsts[firsts > 0] - 1] = kind[firsts[firsts > 0] - 1] != 0
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _library_ids(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words joined, and how many each has."""
    tool = library(path)
    end = tool.token_to_id("<|endoftext|>")
    texts = ["<|endoftext|>".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
    found = [np.array([*e.ids, end], np.uint32) for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate(found)
    stops = np.flatnonzero(ids == end)
    return ids[ids != end], np.diff(np.concatenate(([-1], stops))) - 1


def encode(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the chunk's documents joined, and how many each document has."""
    data = np.ascontiguousarray(data)
    raw, n_docs = data.tobytes(), len(offsets) - 1
    special = raw.find(b"<|") >= 0
    whole = [i for i in range(n_docs) if raw.find(b"<|", offsets[i], offsets[i + 1]) >= 0] if special else []
    counts, ids = np.zeros(n_docs, np.int64), np.zeros(0, np.uint32)
    if len(data):
        low = LOWER[data]
        starts, ends = _pieces(low, offsets)
        h = span_hashes(low, starts, ends)
        number, first = numbered(low, starts, ends, h)
        a, b, h = starts[first], ends[first], h[first]
        cache = _cache(path)
        slot = cache.pieces.find(low, a, b, h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(cache.pieces) + len(new) > CACHE or len(cache.pieces.raw) + int((b - a)[new].sum()) > CACHE_BYTES:
                cache.clear()
                new = np.arange(len(first))
            text = low.tobytes()
            words = [text[i:j].decode() for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)]
            slot[new] = len(cache.pieces) + np.arange(len(new))
            cache.add(*_library_ids(path, words))
            cache.pieces.add(low, a[new], b[new], h[new])
        at = slot[number]
        length = cache.length[at]
        ids = cache.ids[ragged(cache.start[at], length)]
        total = np.concatenate(([0], np.cumsum(length)))
        bounds = total[np.searchsorted(starts, offsets)]
        counts = np.diff(bounds)
    if whole:
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for i in whole:
            pieces[i] = np.array(library(path).encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            counts[i] = len(pieces[i])
        ids = np.concatenate(pieces)
    return ids, counts


def count(path: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return encode(path, data, offsets)[1]
