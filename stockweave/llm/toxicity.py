"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

A model is fitted on at most SAMPLE labelled rows, drawn by a hash of doc_id from the rows that
``learns`` allows. The sample gives a lexicon (words much more frequent in toxic documents) next
to a fixed one, and the trees. Features: densities of lexicon words, lexicon words near a second
person, capitals, punctuation, obfuscated lexicon words. All documents are scored in one pass.

Defined results: null and empty texts score as a text without words; a doc_id that is null, or
not labelled, is scored but never learned from; of several labels of a doc_id the highest holds;
rows that repeat a document score alike; without labels every score is 0; an empty table gives
no row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Calibrated, fit_calibrated
from .common import columns_of, kept, keyed, record

#: Labelled rows that the model is fitted on, at most; words of the learned lexicon, at most.
SAMPLE, LEXICON = 12_000, 300
# Insults and second-person words of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb clown scum trash garbage worthless pathetic disgusting loser losers fool imbecile filth vermin "
    "idiotisch dummkopf trottel abschaum arschloch wertlos erbärmlich widerlich dumm "
    "idiote imbécile crétin stupide connard salaud ordure minable dégoûtant "
    "idiota imbécil estúpido estúpida basura patético asqueroso tonto inútil".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LETTERS = str.maketrans("@$!013457*", "asioieasti")
WORD = re.compile(r"[^\W\d_]+")
INSIDE = re.compile(r"(?<=[^\W\d_])[@$!*0-9]+(?=[^\W\d_])")
IS_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
N_FEATURES = 18


def hidden_words(text: str) -> list[str]:
    """Words of a lower-cased text with signs among their letters, the signs read as letters."""
    out, done = [], 0
    for m in INSIDE.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a and a > done and text[a - 1] not in " \t\n\r":
            a -= 1
        b = m.end()
        while b < len(text) and text[b] not in " \t\n\r":
            b += 1
        out.append("".join(WORD.findall(text[a:b].translate(LETTERS))))
        done = b
    return out


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    lower = text.lower()
    words = WORD.findall(lower)
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    learned = [(i, w) for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[w] for _, w in learned]
    near = sum(any(w in SECOND for w in words[max(0, i - 5) : i + 6]) for i in {*fixed, *(i for i, _ in learned)})
    hidden = hidden_words(lower)
    found = sum(w in INSULTS or w in lexicon for w in hidden)
    size = max(1, len(text))
    upper = int(np.count_nonzero(IS_UPPER[np.frombuffer(text.encode(), np.uint8)]))
    return [
        math.log1p(n), len(fixed), len(fixed) / n, len(learned), len(learned) / n, sum(weights), sum(weights) / n, max(weights, default=0.0),
        len({w for _, w in learned}), found, len(hidden) / n, near, near / n, upper / size, text.count("!") / size, text.count("?") / size,
        (text.count(",") + text.count(".") + text.count("*") + text.count("$") + text.count("%")) / size, len(lower) / n,
    ]


def fold(name: str = "doc_id", parts: int = 5) -> Column:
    """crc32(doc_id as text) modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col(name).cast("string")) % parts


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], model: Calibrated) -> None:
        self.lexicon, self.model = lexicon, model

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t or "", self.lexicon) for t in texts], np.float64).reshape(-1, N_FEATURES)
        return self.model.score(x)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learns: Column) -> ToxicityModel:
    """``learns``: which doc_ids may be learned from."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.coalesce(learns, F.lit(False))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # SAMPLE rows at most
    texts = kept(texts, "toxicity-sample")
    if texts.count() > SAMPLE:  # a doc_id repeats
        texts = kept(texts.orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE), "toxicity-sample")
    word = pa.schema([("word", pa.string()), ("toxic", pa.int32())])

    def spread(batches):
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in columns_of(batch, "text", "toxic"):
                lower = (text or "").lower()
                out += [(w, toxic) for w in {*WORD.findall(lower), *hidden_words(lower)}]
            yield record(word, list(zip(*out, strict=True)) or [[], []])

    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = texts.select("text", "toxic").mapInArrow(spread, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    chosen = counts.filter(F.col("bad") >= 3).withColumn("w", odds).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "word").limit(LEXICON).collect()
    lexicon = {r["word"]: float(r["w"]) for r in chosen}
    row = pa.schema([("k", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measured(batches):
        for batch in batches:
            out = [(d, t, features(x or "", lexicon)) for d, x, t in columns_of(batch, "doc_id", "text", "toxic")]
            yield record(row, list(zip(*out, strict=True)) or [[], [], []])

    rows = texts.mapInArrow(measured, "k long, toxic int, x array<double>").orderBy("k").collect()  # SAMPLE rows at most
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, N_FEATURES)
    y = np.array([r["toxic"] for r in rows], np.float64)
    held = np.array([hash_of(r["k"]) % 4 == 0 for r in rows], bool)
    return ToxicityModel(lexicon, fit_calibrated(x, y, held))


def hash_of(k: int) -> int:
    return (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, th, score, predicted of every row; th is the hash of its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches):
        for batch in batches:
            score = model.score(batch.column("text").to_pylist())
            yield record(schema, [batch.column("doc_id"), batch.column("th"), score, (score >= 0.5).astype(np.int32)])

    return keyed(docs).mapInArrow(scored, "doc_id long, th long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that score below one half."""

    def kept_rows(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(kept_rows, docs.schema)
