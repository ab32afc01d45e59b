"""Suffix-array dedup: bytes covered by a 50-byte string that starts in an earlier document too.

Sorting every suffix would move fifty times the corpus, so a sparse suffix array is built
that loses nothing. Each 50-byte window belongs to one anchor: the position of the smallest
hash among its 16-byte strings. Equal windows have equal anchors at equal distances, so
duplicates can only lie in windows whose anchor string occurs in two documents.

1. Filter: anchors (one for about 18 bytes) whose string no other document has need no sorting. Tasks find strings that two of their
   documents share and send 48 bits of the rest to hash buckets, which answer with those that others hold; a false answer only costs a comparison.
2. Suffixes at shared anchors, with the bytes of their windows, are range-partitioned by their
   16 leading bytes and a salt, at splitters from a bounded sample; a hot string so spreads over
   several buckets. A bucket sorts its suffixes by multikey quicksort and joins equal neighbours. Slab by slab (whole strings) it
   sorts the suffixes that begin with the windows of the distinct ones in the same way; neighbours that have LENGTH bytes in common
   are equal windows, of which only those of the smallest id stay.
3. Boundaries: windows of a string that spans buckets are sorted and compared across them,
   each bucket sending only those of the smallest id.
4. Documents join their intervals over the shuffle that step 2 made.

Work is linear in a group of copies: a suffix is compared with its group's smallest id only. Bytes are compared, not hashes.
Buckets hold the suffixes of about BUCKET bytes of text, whatever the corpus: a partition is made of several, which Spark
sorts (spilling if need be) and a task handles one after the other.

Null texts are empty; texts under 50 bytes stay whole; a row without an id neither removes nor loses
anything. Rows with one id never remove from each other, so exact repeats of a row stay alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, eight_bytes, ids_of, mix, partitions, ragged, record, row_key, span_hashes, table, text_chunks, texts

#: Bytes of a duplicate, bytes of an anchor's string, windows that an anchor is the least of.
LENGTH, ANCHOR = 50, 16
SPAN = LENGTH - ANCHOR + 1
#: Anchors that a task holds before it sends them; documents and anchors of each in the sample for splitters.
HELD, SAMPLE, SAMPLE_EACH = 1 << 19, 4000, 32
#: Bytes of suffixes of which the windows are compared at a time; bytes of text in a chunk and of windows whose anchors are found at a time; of text for a bucket.
SLAB, CHUNK, BLOCK, BUCKET = 1 << 19, 1 << 20, 1 << 18, 8 << 20
#: Rows that quicksort hands to a plain sort, words of a window.
SMALL, WORDS = 1 << 14, -(-LENGTH // 8)
_LOW48 = U64((1 << 48) - 1)
_B = [U64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(4)]

_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_TOLD = pa.schema([("key", pa.int64()), ("told", pa.binary())])
_SUFFIXES = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary()), ("bytes", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
#: Duplicate windows of a document: its id, first and last+1 start.
_SPAN = np.dtype([("id", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
#: An undecided window: its document's key, itself and its bytes.
_OPEN = np.dtype([("key", "<i8"), ("id", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("words", "<u8", (WORDS,))])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last+1 start of its windows, document number, 64-bit hash of its string."""
    none = np.zeros(0, np.int64)
    start = ragged(offsets[:-1], np.maximum(np.diff(offsets) - LENGTH + 1, 0))
    if not len(start):
        return none, none, none, none, none.astype(U64)
    found = []
    for base in range(0, len(data), BLOCK):
        lo, hi = np.searchsorted(start, (base, base + BLOCK))
        if lo == hi:
            continue
        h = data[base : base + BLOCK + LENGTH - 1].astype(U64) + U64(1)
        for k in range(4):  # strings of 2, 4, 8 and 16 bytes
            h = h[: -(1 << k)] * _B[k] + h[1 << k :]
        h = mix(h)
        low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        for width in (1, 2, 4, 8, 16, SPAN - 32):
            low = np.minimum(low[:-width], low[width:])
        windows = start[lo:hi]
        at = (low[windows - base] & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        found.append((at[first] + base, windows[first], windows[np.append(first[1:], len(at)) - 1] + 1, h[at[first]]))
    at, lo, hi, h = map(np.concatenate, zip(*found, strict=True))
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))  # joins what blocks have cut
    lo, hi = lo[first], hi[np.append(first[1:], len(at)) - 1]
    return at[first], lo, hi, np.searchsorted(offsets, lo, "right") - 1, h[first]


def _pack48(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _unpack48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _by_key(keys: np.ndarray, items: np.ndarray, width: int) -> tuple[np.ndarray, pa.Array]:
    """Items (uint8, `width` each) grouped by key: the keys, and the joined items of each."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
    return sorted_[first], _binary(items.reshape(-1, width)[order].reshape(-1), np.append(first, len(keys)) * width)


def _to_blocks(keys: np.ndarray, items: np.ndarray, width: int, n: int) -> Iterator[tuple[int, bytes]]:
    """(block, blob): items with their keys, for the block of rows that holds the key; one blob for each block."""
    items, block = items.reshape(-1, width), np.mod(keys, n)
    order = np.lexsort((keys, block))
    ends = np.searchsorted(block[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        part = order[ends[b] : ends[b + 1]]
        own, counts = np.unique(keys[part], return_counts=True)
        yield b, np.array([len(own)], "<u8").tobytes() + own.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + items[part].tobytes()


def _from_blob(blob: bytes | pa.Buffer, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and items of a blob of _to_blocks, both as long."""
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    own, counts = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    return np.repeat(own, counts), np.frombuffer(blob, np.uint8, offset=8 + 12 * n).reshape(-1, width)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(bucket, its rows' other columns, as buffers or numbers) of rows that are sorted by bucket; a bucket's rows must be used up before the next."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [(x.as_buffer() for x in c) if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
            yield from zip(*columns, strict=True)

    for bucket, some in groupby(rows(), key=itemgetter(0)):
        yield bucket, (row[1:] for row in some)


def _dealt(rows: DataFrame, n: int, each: int) -> DataFrame:
    """Rows of n * each buckets, `each` in a partition, sorted by bucket there."""
    return rows.repartitionById(n, F.floor(F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket")


def _probes(n: int):
    """Sends anchor hashes to buckets: strings known to be shared at once, the others to be compared."""

    def flush(h: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = hs[1:] != hs[:-1]
        again = np.zeros(len(h), bool)
        again[1:] = ~new[1:] & (ds[1:] == ds[:-1])
        group = np.cumsum(new) - 1
        shared = (np.bincount(group, ~again) > 1)[group]
        state = np.empty(len(h), np.int8)  # 0: one document here, 1: several, 2: several and first, 3: repeat in its document
        state[order] = np.where(again, 3, np.where(shared, np.where(new, 2, 1), 0))
        rows: list[tuple[int, bytes]] = []
        for kind in (0, 2):
            at = np.flatnonzero(state == kind)
            at = at[np.argsort(bucket[at], kind="stable")]
            ends = np.searchsorted(bucket[at], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(ends)):
                part = at[ends[b] : ends[b + 1]]
                if kind:
                    rows.append((b, b"\1" + _pack48(h[part]).tobytes()))
                else:
                    docs, counts = np.unique(doc[part], return_counts=True)
                    rows.append((b, b"\0" + np.array([len(docs)], "<u4").tobytes() + keys[docs].tobytes() + counts.astype("<u4").tobytes() + _pack48(h[part]).tobytes()))
        if rows:
            yield record(_BLOBS, [b for b, _ in rows], [x for _, x in rows])
        at = np.flatnonzero((state == 1) | (state == 2))
        if len(at):
            known = list(_to_blocks(keys[doc[at]], _pack48(h[at]), 6, n))
            yield record(_BLOBS, [b for b, _ in known], [b"\2" + x for _, x in known])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = n_docs = 0
        for chunk, data, offsets in text_chunks(batches, CHUNK):
            _, _, _, doc, h = anchors(data, offsets)
            held.append((h, doc + n_docs, ids_of(chunk, "key").to_numpy()))
            n_held, n_docs = n_held + len(h), n_docs + chunk.num_rows
            if n_held >= HELD:
                yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                held, n_held, n_docs = [], 0, 0
        if n_held:
            yield from flush(*map(np.concatenate, zip(*held, strict=True)))

    return probes


def _answers(n: int):
    """Of one bucket: the hashes that documents of several tasks hold, for the blocks of these documents."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            hashes, keys, marks = [], [], [np.zeros(0, U64)]
            for (blob,) in rows:
                raw = np.frombuffer(blob, np.uint8)
                if raw[0] == 2:  # known where it was made
                    yield record(_BLOBS, [bucket], [raw[1:].tobytes()])
                elif raw[0] == 1:
                    marks.append(_unpack48(raw[1:]))
                else:
                    m = int(raw[1:5].view("<u4")[0])
                    keys.append(np.repeat(raw[5 : 5 + 8 * m].view("<i8"), raw[5 + 8 * m : 5 + 12 * m].view("<u4")))
                    hashes.append(_unpack48(raw[5 + 12 * m :]))
            if not hashes:
                continue
            h, key = np.concatenate(hashes), np.concatenate(keys)
            order = np.argsort(h)
            hs = h[order]
            same = hs[1:] == hs[:-1]
            shared = np.zeros(len(h), bool)
            shared[1:] |= same
            shared[:-1] |= same
            mark = np.unique(np.concatenate(marks))
            if len(mark):
                shared |= mark[np.minimum(np.searchsorted(mark, hs), len(mark) - 1)] == hs
            found = order[shared]
            if len(found):
                told = list(_to_blocks(key[found], _pack48(h[found]), 6, n))
                yield record(_BLOBS, [b for b, _ in told], [x for _, x in told])

    return answers


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the shared hashes of its documents."""
    for _, rows in _buckets(batches):
        keys, items = map(np.concatenate, zip(*(_from_blob(blob, 6) for (blob,) in rows), strict=True))
        yield record(_TOLD, *_by_key(keys, items, 6))


def _leads(data: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """16 leading bytes of each suffix and a salt, as sortable strings."""
    out = np.empty((len(at), 24), np.uint8)
    out[:, :16] = data[at[:, None] + np.arange(16)]
    out[:, 16:] = salt.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S24")


def splitters(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """n-1 splitters from the anchors of about `sample` documents (n, if that is more), up to SAMPLE_EACH of each."""
    sample = max(sample, n)
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, offsets in text_chunks(batches, CHUNK):
            at, _, _, doc, _ = anchors(data, offsets)
            each = np.bincount(doc, minlength=chunk.num_rows)
            rank = np.arange(len(at)) - (np.cumsum(each) - each)[doc]
            chosen = rank % np.maximum(1, -(-each // SAMPLE_EACH))[doc] == 0
            salt = mix(ids_of(chunk, "key").to_numpy().astype(U64)[doc[chosen]])
            yield record(pa.schema([("lead", pa.binary())]), _binary(_leads(data, at[chosen], salt).view(np.uint8), np.arange(chosen.sum() + 1) * 24))

    found = some.mapInArrow(leads, "lead binary").toArrow().column("lead")
    keys = np.sort(np.frombuffer(b"".join(x.as_py() for x in found), "S24"))
    if not len(keys):
        return keys
    cuts = keys[(np.arange(1, n) * len(keys)) // n]
    strings = np.ascontiguousarray(cuts).view(np.uint8).reshape(-1, 24).copy()
    same = (strings[1:, :16] == strings[:-1, :16]).all(axis=1)
    strings[~np.concatenate(([False], same)), 16:] = 0  # a string is only cut inside if it fills a bucket
    return strings.reshape(-1).view("S24")


def _suffixes(cuts: np.ndarray):
    """Sends the suffixes at shared anchors, with their windows, to range buckets."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for chunk, data, offsets in text_chunks(batches, CHUNK):
            at, lo, hi, doc, h = anchors(data, offsets)
            told = ids_of(chunk, "told").to_pylist()
            of = np.repeat(np.arange(chunk.num_rows), [len(x) // 6 for x in told])
            known = _unpack48(np.frombuffer(b"".join(told), np.uint8))
            salt = U64(0xD6E8FEB86659FD93)
            shared = np.flatnonzero(ids_of(chunk).is_valid().to_numpy(zero_copy_only=False)[doc] & np.isin(mix((h & _LOW48) + doc.astype(U64) * salt), mix(known + of.astype(U64) * salt)))
            if not len(shared):
                continue
            at, lo, hi, doc = at[shared], lo[shared], hi[shared], doc[shared]
            key, ids = ids_of(chunk, "key").to_numpy(), pc.fill_null(ids_of(chunk), 0).to_numpy()
            bucket = np.searchsorted(cuts, _leads(data, at, mix(key.astype(U64)[doc])), "right")
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(len(cuts) + 2))
            rows = []
            for b in np.flatnonzero(np.diff(ends)):
                part = order[ends[b] : ends[b + 1]]
                docs, number = np.unique(doc[part], return_inverse=True)
                size = hi[part] - lo[part] + LENGTH - 1
                row = (number.astype("<u4"), (lo[part] - offsets[doc[part]]).astype("<u4"), (at[part] - lo[part]).astype("u1"), size.astype("u1"))
                parts = (np.concatenate((key[docs], ids[docs])).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), b"".join(x.tobytes() for x in row), data[ragged(lo[part], size)].tobytes())
                rows.append((b, *map(packer.compress, parts)))
            yield record(_SUFFIXES, *map(list, zip(*rows, strict=True)))

    return suffixes


def multikey_quicksort(words: np.ndarray, small: int = SMALL) -> np.ndarray:
    """An order that sorts rows of words: parts split three ways by a word around a median of some, and equal ones go on with the next word."""
    order, left = np.arange(len(words)), [(0, len(words), 0)]
    while left:
        lo, hi, k = left.pop()
        part = order[lo:hi]
        if len(part) <= small:
            rest = words[part, k:].astype(">u8")
            order[lo:hi] = part[np.argsort(rest.view(f"S{8 * rest.shape[1]}").reshape(-1), kind="stable")]
            continue
        word = words[part, k]
        some = np.sort(word[:: max(1, len(word) // 99)])
        less, more = word < some[len(some) // 2], word > some[len(some) // 2]
        below, above = part[less], part[more]
        order[lo:hi] = np.concatenate((below, part[~(less | more)], above))
        left += [(lo, lo + len(below), k), (hi - len(above), hi, k)]
        if k + 1 < words.shape[1]:
            left.append((lo + len(below), hi - len(above), k + 1))
    return order


def begins(words: np.ndarray) -> np.ndarray:
    """Whether each of the sorted rows differs from its neighbour before."""
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)
    return new


def _window_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each place on, as words that sort as the bytes do."""
    window, out = eight_bytes(data), np.empty((len(at), WORDS), U64)
    for k in range(WORDS):
        out[:, k] = window[np.minimum(at + 8 * k, len(data))].byteswap()
    out[:, -1] &= ~U64((1 << 8 * (8 * WORDS - LENGTH)) - 1)
    return out


def _sortable(raw: np.ndarray, offset: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of 96 bytes of each suffix: from the anchor on, then what stands before it, then both lengths."""
    rows = np.zeros((len(offset), 96), np.uint8)
    for lo in range(0, len(offset), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        n = size[part]
        row = np.repeat(np.arange(len(n)) + lo, n)
        within = ragged(-before[part], n)
        rows[row, np.where(within < 0, within + 88, within)] = raw[ragged(offset[part], n)]
    rows[:, 88], rows[:, 89] = before, size
    return rows


def _slabs(rows: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sorted suffixes of about SLAB bytes, cut where the anchor's string changes."""
    change = np.flatnonzero((rows[1:, :ANCHOR] != rows[:-1, :ANCHOR]).any(axis=1)) + 1
    ends, lo = np.cumsum(size), 0
    while lo < len(rows):
        full = int(np.searchsorted(ends, ends[lo] - size[lo] + SLAB, "right"))
        at = int(np.searchsorted(change, max(full, lo + 1)))
        hi = int(change[at]) if full < len(rows) and at < len(change) else len(rows)
        yield lo, hi
        lo = hi


def _spans(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), _SPAN)
    out["id"], out["lo"], out["hi"] = ids, lo, hi
    return out.view(np.uint8)


def _unpacked(rows: Iterator[tuple]) -> tuple[np.ndarray, ...]:
    """Of the suffixes of a bucket: document's key and id, first window, bytes before the anchor, bytes, and all their bytes joined."""
    parts, unpacker = [], zstandard.ZstdDecompressor()
    for packed in rows:
        d, r, x = (np.frombuffer(unpacker.decompress(y), np.uint8) for y in packed)
        d, m = np.ascontiguousarray(d.reshape(8, -1).T).view("<i8").reshape(2, -1), len(r) // 10
        number = r[: 4 * m].view("<u4")
        parts.append((d[0][number], d[1][number], r[4 * m : 8 * m].view("<u4").astype(np.int64), r[8 * m : 9 * m].astype(np.int64), r[9 * m :].astype(np.int64), x))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _compared(cuts: np.ndarray, n: int):
    """Of each bucket: windows that a smaller id holds, and undecided ones of strings that span buckets."""
    strings = np.array([c[:16] for c in cuts.tolist()], "S16")
    edges = strings[1:][strings[1:] == strings[:-1]]  # strings that go on in the next bucket

    def compare(key, ids, start, before, size, raw) -> Iterator[tuple[int, int, bytes]]:
        offset = np.cumsum(size) - size
        rows = _sortable(raw, offset, before, size)
        words = rows.view(">u8").astype(U64)
        order = multikey_quicksort(words)
        new = begins(words[order])
        del words
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        later = ids > least[group]
        # Copies of a suffix with a smaller id lose all its windows.
        left = []
        found = [(key[later], ids[later], start[later], start[later] + size[later] - LENGTH + 1)]
        first = np.flatnonzero(new)
        for lo, hi in _slabs(rows[order[first]], size[order[first]]):
            one = order[first[lo:hi]]
            width = size[one] - LENGTH + 1
            of = np.repeat(np.arange(lo, hi), width)
            data, at = raw[ragged(offset[one], size[one])], ragged(np.cumsum(size[one]) - size[one], width)
            words = _window_words(data, at)
            by = multikey_quicksort(words)
            begin = np.flatnonzero(begins(words[by]))
            smallest = np.minimum.reduceat(least[of[by]], begin)
            held = np.empty(len(by), bool)
            held[by] = least[of[by]] > np.repeat(smallest, np.diff(np.append(begin, len(by))))
            # Rows of the smallest id get the verdicts of their windows.
            own = order[first[lo] : first[hi] if hi < len(first) else len(order)]
            own = own[~later[own]]
            each = width[group[own] - lo]
            spot = ragged((np.cumsum(width) - width)[group[own] - lo], each)
            row, place = np.repeat(own, each), ragged(start[own], each)
            yes = held[spot]
            r, w = row[yes], place[yes]
            if len(r):
                fresh = np.concatenate(([0], np.flatnonzero((r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)) + 1))
                found.append((key[r[fresh]], ids[r[fresh]], w[fresh], w[np.append(fresh[1:], len(r)) - 1] + 1))
            open_ = np.isin(np.ascontiguousarray(rows[own, :16]).reshape(-1).view("S16"), edges)
            undecided = np.flatnonzero(np.repeat(open_, each) & ~yes)
            if len(undecided):
                r, spot = row[undecided], spot[undecided]
                item = np.empty(len(r), _OPEN)
                item["key"], item["id"], item["lo"], item["hi"], item["words"] = key[r], ids[r], place[undecided], place[undecided] + 1, words[spot]
                left.append((span_hashes(data, at[spot], at[spot] + LENGTH).view(np.int64), item.view(np.uint8).reshape(-1, _OPEN.itemsize)))
        keys, *columns = map(np.concatenate, zip(*found, strict=True))
        if len(keys):
            yield from ((b, 0, x) for b, x in _to_blocks(keys, _spans(*columns), _SPAN.itemsize, n))
        if left:
            yield from ((b, 1, x) for b, x in _to_blocks(*map(np.concatenate, zip(*left, strict=True)), _OPEN.itemsize, n))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for _, rows in _buckets(batches):
            out = list(compare(*_unpacked(rows)))
            if out:
                yield record(_FOUND, [r[0] for r in out], [r[1] for r in out], [packer.compress(r[2]) for r in out])

    return compared


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Duplicate windows by document: those of a block, and those open ones of the block that a smaller id holds elsewhere."""
    unpacker = zstandard.ZstdDecompressor()
    for _, blobs in _buckets(batches):
        found, left = [], []
        for kind, blob in blobs:
            (left if kind else found).append(_from_blob(unpacker.decompress(blob), _OPEN.itemsize if kind else _SPAN.itemsize))
        if left:
            _, items = map(np.concatenate, zip(*left, strict=True))
            rows = np.ascontiguousarray(items).reshape(-1).view(_OPEN)
            rows = rows[multikey_quicksort(rows["words"])]
            first = np.flatnonzero(begins(rows["words"]))
            least = np.minimum.reduceat(rows["id"], first)
            rows = rows[rows["id"] > np.repeat(least, np.diff(np.append(first, len(rows))))]
            found.append((rows["key"], _spans(rows["id"], rows["lo"], rows["hi"]).reshape(-1, _SPAN.itemsize)))
        yield record(_TOLD, *_by_key(*map(np.concatenate, zip(*found, strict=True)), _SPAN.itemsize))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, data, offsets in text_chunks(batches):
        edge = np.zeros(len(data) + 1, np.int32)
        for d, (own, blobs) in enumerate(zip(ids_of(chunk).to_pylist(), ids_of(chunk, "told").to_pylist(), strict=True)):
            if blobs and own is not None:
                spans = np.frombuffer(b"".join(blobs), _SPAN)
                spans = spans[spans["id"] == own]
                np.add.at(edge, spans["lo"] + offsets[d], 1)
                np.add.at(edge, spans["hi"] + offsets[d] + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[inner] = gone[inner]
        total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, begins))
        kept, ends = data[~gone].tobytes(), offsets - total[offsets]
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield record(_OUT, ids_of(chunk), np.diff(offsets), total[offsets[1:]] - total[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]], sha)


def intervals(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with a key, (key, told: their duplicate windows))."""
    n = partitions(documents.sparkSession)
    rows = texts(documents).withColumn("key", row_key())
    known = rows.where("doc_id is not null")
    each = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (n * BUCKET)))  # buckets in a partition
    m = n * each
    cuts = splitters(known, m)
    dealt = rows.repartition(n, "key")
    probes = _dealt(known.mapInArrow(_probes(m), "bucket int, blob binary"), n, each)
    answers = _dealt(probes.mapInArrow(_answers(m), "bucket int, blob binary"), n, each).mapInArrow(_told, "key long, told binary")
    # No filter on the dealt rows: the same exchange then serves the last join too.
    shared = dealt.join(answers.hint("shuffle_hash"), "key").select("doc_id", "key", "text", "told")
    suffixes = _dealt(shared.mapInArrow(_suffixes(cuts), "bucket int, docs binary, rows binary, bytes binary"), n, each)
    found = _dealt(suffixes.mapInArrow(_compared(cuts, m), "bucket int, kind int, blob binary"), n, each)
    return dealt, found.mapInArrow(_intervals, "key long, told binary").groupBy("key").agg(F.collect_list("told").alias("told"))


def remove(documents: DataFrame) -> DataFrame:
    """One row per document, as the module says."""
    dealt, found = intervals(documents)
    both = dealt.join(found.hint("shuffle_hash"), "key", "left")  # by the key alone, as the rows are dealt
    return both.select("doc_id", "text", "told").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))


SQL = r"""
with doc as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select r, doc_id, p, substr(x, 2 * p + 1, 100) as s from (select r, doc_id, x, unnest(range(0, length(x) // 2 - 49)) as p from doc where doc_id is not null)),
first as (select s, min(doc_id) as d from win group by s having count(*) > 1),
cover as (select distinct r, unnest(range(p, p + 50)) as b from win join first using (s) where doc_id > d),
spans as (select r, count(*) as n, count(*) filter (where gap) as runs from (select r, coalesce(b - lag(b) over (partition by r order by b), 2) > 1 as gap from cover) group by r),
left_ as (select r, string_agg(substr(x, 2 * b + 1, 2), '' order by b) as y from (select r, x, unnest(range(0, length(x) // 2)) as b from doc where r in (select r from spans)) anti join cover using (r, b) group by r)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(runs, 0)::bigint as n_spans,
    sha256(unhex(case when n is null then x else coalesce(y, '') end)) as kept_sha256
from doc left join spans using (r) left join left_ using (r)
"""
