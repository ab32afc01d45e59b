"""Benchmark decontamination with suffix arrays over the training text.

Documents are read in shards of about SHARD bytes of text: a shard's words become ids of the benchmark's vocabulary
(found by hash, compared byte by byte), and its suffix array sorts the suffixes that stay inside that vocabulary
for as long as the shortest window (no other suffix can match). Every test suffix, cut to its window, is
binary-searched there; equal windows at successive places of one item join to the longest verbatim matches, which
give the hit words, the items and the longest match of each document.

The benchmark is the stated query set. It is cut into blocks of about BLOCK bytes of text by a hash; each block's
vocabulary and sorted windows are built once, by a task of their own, written to shared storage and broadcast one by
one. What is sent grows with the benchmark, not with the corpus. A worker keeps blocks of OPEN bytes together open and
maps the others again for each shard; none is ever built a second time, so time is linear in the documents and in the blocks.
No shuffle of documents is needed. Null and empty texts have no words; items without words match nothing;
items without an id can hit words but are not listed; repeated item ids count once.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, EMPTY_SHA, LOWER, U64, Spans, doc_of, ids_of, materialize, numbered, ragged, record, span_hashes, table, text_chunks, texts, word_spans

#: Words in a window, bytes of training text in a shard, of benchmark text in a block, of blocks that stay open, and places that are expanded at a time.
WINDOW, SHARD, BLOCK, OPEN, EXPANDED = 10, 2 << 20, 2 << 20, 256 << 20, 1 << 21
_FILTER = 22

_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64())])
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, starts and ends of the words in them, and word bounds of the documents."""
    data = LOWER[data]
    return data, *word_spans(data, offsets, ALNUM)


class Block:
    """A benchmark block: its vocabulary and its windows, sorted, with the places they come from."""

    def __init__(self, item_ids: list[str | None], item_texts: list[str], window: int = WINDOW):
        raw = [t.encode() for t in item_texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        data, starts, ends, bounds = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
        h = span_hashes(data, starts, ends)
        number, first = numbered(data, starts, ends, h)
        self.window, self.item_ids = window, item_ids
        self.vocabulary = Spans()
        self.vocabulary.add(data, starts[first], ends[first], h[first])
        ids = number + 1
        n = np.diff(bounds)
        length = np.minimum(n, window)
        per_item = np.where(n > 0, n - length + 1, 0)
        self.item = np.repeat(np.arange(len(n), dtype=np.int32), per_item)
        self.at = ragged(np.zeros(len(n), np.int64), per_item).astype(np.int32)  # place in the item
        self.length = length.astype(np.int8)[self.item]
        places = (bounds[:-1][self.item] + self.at)[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < self.length[:, None], ids[np.minimum(places, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
        self.distinct, number = np.unique(_pack(rows), return_inverse=True)
        self.order = np.argsort(number, kind="stable").astype(np.int32)
        self.from_ = np.searchsorted(number[self.order], np.arange(len(self.distinct) + 1))
        self.lengths = self.length[self.order][self.from_[:-1]].astype(np.int64)
        self.least = int(self.lengths.min()) if len(self.lengths) else 0

    def known(self) -> np.ndarray:
        """A bitmap of the vocabulary's hashes, which most other words miss."""
        maybe = np.zeros(1 << _FILTER, bool)
        maybe[(self.vocabulary.hash >> U64(64 - _FILTER)).astype(np.int64)] = True
        return maybe

    def search(self, maybe: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number in the shard, number of a distinct window) of all occurrences. maybe: known(); h: the words' hashes."""
        none = np.zeros(0, np.int64)
        if not len(self.distinct) or not len(h):
            return none, none
        known = np.flatnonzero(maybe[(h >> U64(64 - _FILTER)).astype(np.int64)])
        found = self.vocabulary.find(data, starts[known], ends[known], h[known]) + 1
        known, found = known[found > 0], found[found > 0]
        if not len(known):
            return none, none
        doc = np.searchsorted(bounds, known, "right")
        breaks = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc) != 0)) + 1
        stops = np.concatenate((breaks, [len(known)]))
        left = np.repeat(stops, np.diff(np.concatenate(([0], stops)))) - np.arange(len(known))
        suffixes = np.flatnonzero(left >= self.least)
        if not len(suffixes):
            return none, none
        step = np.arange(self.window)
        rows = np.where(step < left[suffixes][:, None], found[np.minimum(suffixes[:, None] + step, len(found) - 1)], 0)
        keys = _pack(rows)
        array = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys = keys[array]
        low = np.searchsorted(keys, self.distinct)
        high = np.searchsorted(keys, _beyond(self.distinct, self.lengths, self.window))
        word, number = known[suffixes[array[ragged(low, high - low)]]], np.repeat(np.arange(len(self.distinct)), high - low)
        order = np.argsort(word, kind="stable")
        return word[order], number[order]

    def matches(self, word: np.ndarray, number: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(word number, item, place in the item, words) of the longest verbatim matches, about EXPANDED places or one document at a time. doc: the words' documents."""
        places = np.diff(self.from_)[number]
        total, ends = np.cumsum(places), np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
        lo = 0
        while lo < len(word):
            full = int(np.searchsorted(total, total[lo] - places[lo] + EXPANDED, "right"))
            hi = int(max(ends[max(np.searchsorted(ends, full, "right") - 1, 0)], ends[np.searchsorted(ends, lo, "right")]))
            n, k = places[lo:hi], number[lo:hi]
            place = self.order[ragged(self.from_[k], n)]
            w = np.repeat(word[lo:hi], n)
            item, at, length = self.item[place], self.at[place], self.length[place]
            order = np.lexsort((w, w - at, item))
            w, item, at, length = w[order], item[order], at[order], length[order]
            new = np.ones(len(w), bool)
            new[1:] = (np.diff(item) != 0) | (np.diff(w - at) != 0) | (np.diff(w) != 1) | (np.diff(np.repeat(doc[lo:hi], n)[order]) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(w)) - 1
            yield w[first], item[first], at[first], w[last] - w[first] + length[last]
            lo = hi


def _pack(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the rows do; 0 ends a row."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").reshape(-1) if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


def _beyond(keys: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The least key above all that begin with each key."""
    rows = np.frombuffer(keys.astype(f"S{4 * window}").tobytes(), ">u4").reshape(-1, window).astype(np.int64)
    rows[np.arange(len(rows)), lengths - 1] += 1
    return _pack(rows)


_PACKED = pa.schema([("block", pa.int32()), ("blob", pa.binary())])


def blocks(benchmark: DataFrame, block_bytes: int | None = None) -> list:
    """The benchmark as broadcasts of pickled blocks of about block_bytes of text each, every one built once."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (block_bytes or BLOCK))
    if not n:
        return []

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, list[tuple[str | None, str]]] = {}
        for batch in batches:
            for k, *item in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                items.setdefault(k, []).append(item)
        for k, some in items.items():
            yield record(_PACKED, [k], [pickle.dumps(Block([i for i, _ in some], [t for _, t in some]), protocol=5)])

    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int").alias("block")
    stored = materialize(rows.select(number, "item_id", "text").repartitionById(n, F.col("block")).mapInArrow(built, "block int, blob binary"), "op2-blocks")
    sent = []
    for k in sorted(r.block for r in stored.select("block").collect()):  # a row for each block
        sent.append(spark.sparkContext.broadcast(bytes(stored.where(F.col("block") == k).first().blob)))
    return sent


class _Opened:
    """The blocks, one after the other, with their bitmaps; OPEN bytes of them stay open."""

    def __init__(self, sent: list):
        self.sent, self.open, self.held = sent, {}, 0

    def __iter__(self) -> Iterator[tuple[Block, np.ndarray]]:
        for i, b in enumerate(self.sent):
            if i in self.open:
                yield self.open[i]
                continue
            blob = b.value
            block = pickle.loads(blob)
            del b._value
            one = block, block.known()
            if self.held + len(blob) <= OPEN:
                self.open[i] = one
                self.held += len(blob)
            yield one


def _found(sent: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Shards: (rows, word bounds, an iterator of (block, documents of matches, matches))."""
    opened = _Opened(sent)
    for chunk, raw, offsets in text_chunks(batches, SHARD):
        data, starts, ends, bounds = words_of(raw, offsets)
        of, h = doc_of(bounds), span_hashes(data, starts, ends)

        def matched() -> Iterator[tuple]:
            for block, maybe in opened:
                word, number = block.search(maybe, data, starts, ends, h, bounds)
                for found in block.matches(word, number, of[word]) if len(word) else ():
                    yield block, of[found[0]], found

        yield chunk, bounds, matched()


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, as the module says, from its longest matches; longest: words of the longest, 0 without one."""
    sent = blocks(benchmark)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, bounds, matched in _found(sent, batches):
            edge = np.zeros(int(bounds[-1]) + 1, np.int32)
            longest = np.zeros(chunk.num_rows, np.int64)
            listed: dict[int, set[str]] = {}
            for block, doc, (word, item, _, n) in matched:
                np.add.at(edge, word, 1)
                np.add.at(edge, word + n, -1)
                np.maximum.at(longest, doc, n)
                pairs = np.unique((doc << 32) | item)
                for d, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
                    if block.item_ids[i] is not None:
                        listed.setdefault(d, set()).add(block.item_ids[i])
            covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
            n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
            n_items, sha = np.zeros(chunk.num_rows, np.int64), [EMPTY_SHA] * chunk.num_rows
            for d, items in listed.items():
                n_items[d], sha[d] = len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            yield record(_REPORT, ids_of(chunk), np.diff(bounds), n_hit, n_items, sha, n_hit > 0, longest)

    return texts(documents).mapInArrow(judged, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Longest verbatim matches (of a window at least) with their places: doc_id, item_id, doc_word, item_word, n_words."""
    sent = blocks(benchmark)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, bounds, matched in _found(sent, batches):
            for block, doc, (word, item, at, n) in matched:
                yield record(_MATCHES, ids_of(chunk).take(pa.array(doc)), [block.item_ids[i] for i in item.tolist()], word - bounds[doc], at.astype(np.int64), n)

    return texts(documents).mapInArrow(found, "doc_id long, item_id string, doc_word long, item_word long, n_words long")


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """The documents of which no more than `share` of the words are hit; all their columns stay."""
    bad = report(documents, benchmark).where(F.col("n_hit") > share * F.col("n_words")).select(F.col("doc_id").alias("__doc_id")).distinct()
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with doc as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
item as (
    select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
span as (select q, item_id, w, least(len(w), 10) as l from item where len(w) > 0),
win as (select q, item_id, l, j, array_to_string(w[j : j + l - 1], ' ') as k from (select *, unnest(range(1, len(w) - l + 2)) as j from span)),
place as (select r, i, list(x) over (partition by r order by i rows between current row and 9 following) as w from (select r, unnest(w) as x, generate_subscripts(w, 1) as i from doc)),
part as (
    select r, i, l, array_to_string(w[1 : l], ' ') as k
    from place, (select distinct l from win) where l <= len(w)),
hit as (select r, i, part.l, q, item_id, j from part join win using (l, k)),
spot as (select r, count(distinct p) as n from (select r, unnest(range(i, i + l)) as p from (select distinct r, i, l from hit)) group by r),
listed as (select r, count(*) as n, string_agg(s, ',' order by s) as s from (select distinct r, item_id::varchar as s from hit where item_id is not null) group by r),
run as (select r, l, i - row_number() over (partition by r, q, i - j order by i) as start, q, i - j as shift from hit),
longest as (select r, max(n) as n from (select r, count(*) + any_value(l) - 1 as n from run group by r, q, shift, start) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(spot.n, 0)::bigint as n_hit, coalesce(listed.n, 0)::bigint as n_items,
    sha256(coalesce(listed.s, '')) as items_sha256, coalesce(spot.n, 0) > 0 as contaminated, coalesce(longest.n, 0)::bigint as longest
from doc left join spot using (r) left join listed using (r) left join longest using (r)
"""
