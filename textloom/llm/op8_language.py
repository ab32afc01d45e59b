"""Language ID by compression: the language whose raw-content dictionary compresses a text best.

For each language a dictionary of at most DICTIONARY bytes is made of pieces of sampled
documents, about SAMPLE of each language, just more than it holds (chosen by a hash of the id, so the
sample's size does not grow with the corpus); a piece is taken at a hashed place of the whole text. A whole text, A-Z lower-cased and
between two blanks, is compressed in blocks of BLOCK bytes with each dictionary; the smallest sum wins, and a lead
over the next of less than MARGIN of its size is a rejection. FILL follows every block: it costs all
languages the same few bytes, and without it zstandard stores a short block as it is. Texts of all lengths go the same way.
One narrow pass; the dictionaries are broadcast, of which LANGUAGES bounds the number.

Null texts and texts without a letter are `und` with score 0 and rejected; without any labelled document all are.
The score is the lead as a share of the runner-up's size (1 if there is only one language). Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, ids_of, record, table, text_chunks

#: Bytes of a dictionary; documents sampled for a language (expected number) and bytes taken of each; bytes of a block; level; least lead.
DICTIONARY, SAMPLE, PIECE, BLOCK, LEVEL, MARGIN = 1 << 15, 120, 300, 512, 9, 0.02
#: Bytes after a block, and languages at most: more are an error, not a choice of some.
FILL, LANGUAGES = bytes(64), 2048
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each language, from documents that are not held out."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id is not null and lang is not null and text is not null").where(~_held_out())
    known_of = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not known_of:
        return {}
    if len(known_of) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    chosen = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for lang, n in known_of.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(min(1.0, sample / n) * (1 << 30))))
    pieces: dict[str, list[bytes]] = {lang: [] for lang in known_of}
    at = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    for r in known.where(chosen).select("doc_id", "lang", F.substring(F.col("text"), at, F.lit(PIECE)).alias("text")).orderBy(F.xxhash64("doc_id"), "text").collect():
        pieces[r.lang].append(r.text.encode())
    return {lang: b"\n".join(dict.fromkeys(pieces[lang])).lower()[-DICTIONARY:] for lang in sorted(pieces) if pieces[lang]}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    made = []
    for raw in dictionaries.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def sizes(text: bytes, tools: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes that a lower-cased text takes with each dictionary."""
    padded = b" " + text + b" "
    blocks = [padded[x : x + BLOCK] + FILL for x in range(0, len(padded), BLOCK)]
    return [sum(len(tool.compress(x)) for x in blocks) for tool in tools]


def predict(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """One row per document: held_out, lang_pred, score, accepted."""
    sent = documents.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY bytes for each language, of which learn() bounds the number

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tools = list(sent.value), compressors(sent.value)
        for chunk, data, offsets in text_chunks(batches):
            raw, letters = LOWER[data].tobytes(), ids_of(chunk, "letters").to_pylist()
            pred, score, sure = [], np.zeros(chunk.num_rows), np.zeros(chunk.num_rows, bool)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if not letters[i] or not names:
                    pred.append("und")
                    continue
                took = sizes(raw[a:b], tools)
                best, *rest = sorted(took)
                pred.append(names[took.index(best)])
                score[i] = (rest[0] - best) / rest[0] if rest else 1.0
                sure[i] = score[i] >= margin
            yield record(_OUT, ids_of(chunk), ids_of(chunk, "held_out"), pred, score, sure)

    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), letters.alias("letters"), _held_out().alias("held_out"))
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, learn(documents))
