"""Language by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary, filled from at most ROWS of its learning
documents, short ones first, up to DICTIONARY bytes. A text is cut into pieces, each is encoded
with every dictionary, and the smallest total wins. A narrow margin marks the answer as rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal totals go
to the language with more learning documents, then by name; rows that repeat a document get the
same answer, and those among the learning documents' ROWS are learned from once each; a null doc_id is answered but never learned from; with nothing to learn from every
answer is ``und``; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, record

#: Bounds of what a language is learned from, and of the languages: of more, the most frequent are learned.
ROWS, DICTIONARY, LANGUAGES = 200, 110_000, 256
SHORT = 2000
PIECE, LEVEL = 4096, 1
#: Bytes of difference that divide a language's odds by e; a margin below which an answer is rejected.
TEMPERATURE, NARROW = 6.0, 0.01
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def learn_dictionaries(docs: DataFrame, learns: Column) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more learning documents first."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learns, F.lit(False)))
    known = known.select("doc_id", "lang", F.length("text").alias("size"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"))
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    counts = {r["lang"]: r["count"] for r in common}
    order = Window.partitionBy("lang").orderBy(F.col("size") > SHORT, "h", "doc_id", "size", "th")
    chosen = known.filter(F.col("lang").isin(list(counts))).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= ROWS)
    chosen = chosen.select("doc_id", "lang", "th", "k")
    texts = docs.withColumn("th", F.xxhash64("text")).select("doc_id", "lang", "th", "text").join(F.broadcast(chosen), ["doc_id", "lang", "th"])  # ROWS per language
    part = F.substring("text", 1, DICTIONARY)  # no more of a text fits in a dictionary
    rows = texts.groupBy("lang", "k").agg(F.first(part).alias("text")).orderBy("lang", "k").toLocalIterator()  # a repeated row counts once
    out: dict[str, bytes] = {}
    for r in rows:
        if len(out.get(r["lang"], b"")) < DICTIONARY:
            out[r["lang"]] = out.get(r["lang"], b"") + (r["text"] + "\n").encode()
    return sorted(((lang, data[:DICTIONARY]) for lang, data in out.items()), key=lambda x: (-counts[x[0]], x[0]))


class Encoders:
    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.names = [lang for lang, _ in dictionaries]
        self.encoders = []
        for _, data in dictionaries:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False))

    def answer(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = text.encode()
        pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
        sizes = np.array([sum([len(e.compress(p)) for p in pieces]) for e in self.encoders], np.float64)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / sizes[best]) if len(others) else 1.0
        score = float(1 / (1 + np.exp(-(others - sizes[best]) / TEMPERATURE).sum()))
        return self.names[best], score, margin, margin < NARROW


def languages(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    def answered(batches):
        encoders = Encoders(dictionaries)
        for batch in batches:
            out = [(d, *encoders.answer(t)) for d, t in columns_of(batch, "doc_id", "text")]
            yield record(schema, list(zip(*out, strict=True)) or [[]] * 5)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(answered, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
