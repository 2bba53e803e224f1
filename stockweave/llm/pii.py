"""Personal data: format rules plus candidates that boosted trees accept.

The rules (``base_spans``) always hold. Generators then propose further spans, overlapping ones
too: addresses with spelled-out signs, and any group of digits with separators. Trees score each
by its format and context. They learn from a sample of documents: spans that a rule accepts, and
the same spans with their tell-tale signs spelled out or taken away, against proposals that no
rule accepts. A proposal is redacted when its calibrated score reaches THRESHOLD and it
overlaps no span chosen before, higher scores first.

Defined results: null and empty texts have no spans; rows that repeat a document get the same
spans; null doc_ids are handled like others; an empty table gives no row; offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Calibrated, fit_calibrated
from .common import columns_of, keyed, record

KINDS = ("email", "ip", "card", "phone")
#: Documents that the trees learn from, and proposals of theirs, at most.
SAMPLE, PROPOSALS = 3000, 40_000
THRESHOLD = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits: from the run's start it would have reached as far
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
SPELLED = re.compile(r"[\[(] ?(?:at|AT) ?[\])]| at (?=[A-Za-z0-9-]{1,63}(?: dot | ?[\[(] ?dot ?[\])]))")
BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?$")
AFTER = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]{1,63})+")
DIGITS = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9])")
HINTS = re.compile(r"(?i)phone|tel|call|mobile|fax|mail|contact|card|visa|account|ip|address|host")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans that the rules accept: per kind leftmost and not overlapping, failing matches dropped."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    """High-recall candidates, which may overlap one another and the rules' spans."""
    out = []
    for m in SPELLED.finditer(text):
        left = BEFORE.search(text, max(0, m.start() - 65), m.start())
        right = AFTER.match(text, m.end())
        if left and right:
            out.append(("email", left.start(), right.end()))
    for m in DIGITS.finditer(text):
        n = len(NOT_DIGIT.sub("", m.group()))
        kind = "ip" if m.group().count(".") == 3 and n <= 12 else "card" if n > 15 else "phone"
        out.append((kind, *m.span()))
    return out


def span_features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 30) : a], text[b : b + 1]
    digits = NOT_DIGIT.sub("", s)
    groups = [g for g in re.split("[^0-9]+", s) if g]
    return [
        *(float(kind == k) for k in KINDS), b - a, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("("), float("dot" in s.lower()), float("@" in s), float(before[-1:] == "+" or s[:1] == "+"),
        float(luhn(digits)) if digits else 0.0, float(bool(HINTS.search(before))), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ".,-/$€%#"), float(after in tuple("%€$")),
    ]


def altered(text: str, span: Span) -> tuple[str, Span]:
    """The text with the span's sign spelled out, or left away, and the span as a generator proposes it."""
    kind, a, b = span
    s = text[a:b]
    if kind == "email":
        s = s.replace("@", " at ").replace(".", " dot ") if b % 2 else s.replace("@", " [at] ")
    elif kind == "phone":
        s = s[1:]
    return text[max(0, a - 40) : a] + s + text[b : b + 40], (kind, min(a, 40), min(a, 40) + len(s))


class Covered:
    """Stretches of a text, without overlaps and in order."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: Span) -> bool:
        k = bisect_right(self.ends, span[1])
        return k < len(self.ends) and self.starts[k] < span[2]

    def add(self, span: Span) -> None:
        """``span`` meets no stretch."""
        insort(self.starts, span[1])
        insort(self.ends, span[2])


def fit_spans(docs: DataFrame) -> Calibrated:
    rich = docs.filter(F.col("text").rlike("[@+][0-9A-Za-z]|[0-9]{4}| at "))
    chosen = rich.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).orderBy(F.xxhash64("_id", "_th")).limit(SAMPLE).distinct()
    mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    texts = docs.join(F.broadcast(chosen), mine).select("doc_id", "text")  # SAMPLE rows
    schema = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measured(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in columns_of(batch, "doc_id", "text"):
                base = base_spans(text)
                ruled = Covered(base)
                rows += [(doc_id, 1, span_features(text, s)) for s in base]
                rows += [(doc_id, 1, span_features(*altered(text, s))) for s in base]
                rows += [(doc_id, 0, span_features(text, s)) for s in proposals(text) if not ruled.meets(s)]
            yield record(schema, list(zip(*rows, strict=True)) or [[], [], []])

    rows = texts.mapInArrow(measured, "k long, y int, x array<double>").orderBy(F.xxhash64("k", "x"), "k", "x").limit(PROPOSALS).collect()  # bounded
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(span_features("", ("email", 0, 0))))
    y = np.array([r["y"] for r in rows], np.float64)
    return fit_calibrated(x, y, np.arange(len(y)) % 4 == 0, rounds=40)


def all_spans(text: str, model: Calibrated) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and these with the accepted proposals, both by kind and start."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    by_place = lambda s: (order[s[0]], s[1], s[2])
    taken, covered = list(base), Covered(base)
    more = [s for s in proposals(text) if not covered.meets(s)]
    if more:
        score = model.score(np.array([span_features(text, s) for s in more], np.float64))
        for k in np.argsort(-score, kind="stable").tolist():
            if score[k] >= THRESHOLD and not covered.meets(more[k]):
                taken.append(more[k])
                covered.add(more[k])
    return sorted(base, key=by_place), sorted(taken, key=by_place)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Calibrated) -> DataFrame:
    """doc_id, th, counts of the rules' spans by kind, base_sha256, spans, clean (the redacted text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("clean", pa.string())])

    def found(batches):
        for batch in batches:
            rows = []
            for doc_id, th, text in columns_of(batch, "doc_id", "th", "text"):
                base, every = all_spans(text or "", model)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, th, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), None if text is None else redacted(text, every)))
            yield record(schema, list(zip(*rows, strict=True)) or [[]] * len(schema))

    return docs.mapInArrow(found, "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string")


def find_personal_data(docs: DataFrame) -> DataFrame:
    docs = keyed(docs)
    return personal_data(docs, fit_spans(docs))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with spans replaced in ``text``; ``n_chars``, if there, follows the text."""
    model = fit_spans(keyed(docs))

    def cleaned(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [None if t is None else redacted(t, all_spans(t, model)[1]) for t in batch.column("text").to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts]).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(cleaned, docs.schema)
