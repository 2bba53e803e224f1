"""Passages that occur in more than one place, found by anchors and settled exactly.

An anchor scheme gives every window (a run of ``size`` words or bytes) a key that depends on the
window's content alone. Consecutive windows of a text with one key make a context: the stretch
that those windows cover. So equal windows always lie in contexts of one key (for repeats within a text: in different contexts), and:

1. keys seen once need no more work: no window there has an equal one;
2. contexts equal as a whole are counted by an aggregate that combines before the shuffle, so a
   passage in a third of all texts costs a row per task;
3. only keys with differing contexts need their content. One copy of each such context is cut
   from its text and the scheme settles which windows are equal, many keys in a task. A key with
   more differing contexts than a task holds is settled by an aggregate over its windows.

A scheme has ``size`` (of a window, in its units); ``limit`` (units of
differing contexts of one key that a task settles); ``contexts(texts)``,
which yields (text number, key, first window, windows, hash of the stretch); ``stretches(text,
places)``, the stretches' bytes; ``windows(content)``, the bytes of each of its windows; and
``settle(contents, firsts)``, a flag for each window of each content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, kept, keyed, record, same_row

#: Keys are settled together up to so many bytes.
CHUNK = 400_000
#: Windows of a context; a longer run of one key is several contexts.
MOST = 1024
BATCH = 600_000


def runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of equal keys that begin anew at ``starts``, cut at MOST."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(keys)))
    if len(length) and length.max() > MOST:
        extra = [np.arange(a, a + n, MOST) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        at = np.concatenate(extra)
        length = np.diff(np.append(at, len(keys)))
    return at, length


def context_rows(docs: DataFrame, scheme) -> DataFrame:
    """doc_id, th, start and windows of every context with its key and the hash of its stretch."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("ctx", pa.int64())])

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            held, size = [], 0
            for row in columns_of(batch, "doc_id", "th", "text"):
                held.append(row)
                size += len(row[2] or "")
                if size > BATCH:
                    rows += placed(held)
                    held, size = [], 0
            rows += placed(held)
            yield record(schema, list(zip(*rows, strict=True)) or [[]] * 6)

    def placed(held: list[tuple]) -> Iterator[tuple]:
        for i, key, start, windows, ctx in scheme.contexts([t or "" for _, _, t in held]):
            yield held[i][0], held[i][1], start, windows, key, ctx

    return docs.mapInArrow(cut, "doc_id long, th long, start int, windows int, key long, ctx long")


def flagged_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, scheme, name: str, earlier_only: bool) -> DataFrame:
    """Ranges of words or bytes to remove: doc_id, th, ranges (pairs of start and end).

    ``earlier_only``: a window counts when an equal one starts in a document of a smaller doc_id
    (null is larger than any); otherwise when an equal one starts anywhere else.
    """
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    size = scheme.size
    rows = kept(context_rows(docs, scheme), f"{name}-contexts")
    again = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    again = kept(again, f"{name}-keys")  # read back, so that the join's skewed keys can be split
    found = kept(rows.join(again, "key", "left_semi"), f"{name}-candidates")

    same = ["key", "windows", "ctx"]
    contexts = kept(found.groupBy(*same).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min(F.struct("doc_id", "th", "start")).alias("place")), f"{name}-distinct")
    mixed = contexts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("windows") + size).alias("width"), F.min("first").alias("a"), F.max("first").alias("b"))
    mixed = mixed.filter("n > 1 and a < b" if earlier_only else "n > 1")
    mixed = kept(mixed.select("key", (F.col("width") > scheme.limit).alias("hot")), f"{name}-mixed")
    asked = contexts.drop("n").join(mixed, "key")
    contents = kept(_contents(docs, asked, scheme), f"{name}-contents")
    settled = _settled(contents.filter(~F.col("hot")), scheme).unionByName(_settled_hot(contents.filter("hot"), scheme, earlier_only))

    whole = contexts.filter(F.col("n") > 1).select(*same, "first")
    joined = found.join(whole, same)
    if earlier_only:
        joined = joined.filter(order > F.col("first"))
    ends: Callable[[Column, Column], Column] = lambda a, b: F.struct(a.cast("int").alias("a"), (b + (size - 1)).cast("int").alias("b"))
    ranges = joined.select("doc_id", "th", ends(F.col("start"), F.col("start") + F.col("windows")).alias("r"))
    parts = found.join(settled, same).select("doc_id", "th", "start", F.explode("flagged").alias("f"))
    ranges = ranges.unionByName(parts.select("doc_id", "th", ends(F.col("start") + F.col("f.a"), F.col("start") + F.col("f.b")).alias("r")))
    return ranges.groupBy("doc_id", "th").agg(F.collect_set("r").alias("ranges"))  # no longer than the text


def _contents(docs: DataFrame, asked: DataFrame, scheme) -> DataFrame:
    """The content of one occurrence of each asked context."""
    per_text = asked.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.th").alias("th")).agg(
        F.collect_list(F.struct("key", "windows", "ctx", "first", "hot", F.col("place.start").alias("start"))).alias("asked"))
    joined = docs.join(per_text, same_row(docs, per_text)).select(docs["text"], "asked")
    schema = pa.schema([("key", pa.int64()), ("windows", pa.int32()), ("ctx", pa.int64()), ("first", pa.int64()), ("hot", pa.bool_()), ("content", pa.binary())])

    def cut(batches):
        for batch in batches:
            for text, wanted in columns_of(batch, "text", "asked"):
                taken = scheme.stretches(text, [(w["start"], w["windows"]) for w in wanted])
                yield record(schema, [[w[k] for w in wanted] for k in ("key", "windows", "ctx", "first", "hot")] + [taken])

    return joined.mapInArrow(cut, "key long, windows int, ctx long, first long, hot boolean, content binary")


FLAGGED = "key long, windows int, ctx long, flagged array<struct<a: int, b: int>>"
FLAGGED_ARROW = pa.schema([("key", pa.int64()), ("windows", pa.int32()), ("ctx", pa.int64()), ("flagged", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _settled(contents: DataFrame, scheme) -> DataFrame:
    """Flagged windows of keys whose contexts fit a task; rows come sorted by key."""

    def flush(held: dict[tuple, tuple]):
        out = []
        flags = scheme.settle([c for _, c in held.values()], [f for f, _ in held.values()])
        for name, own in zip(held, flags, strict=True):
            if own.any():
                out.append((*name, [{"a": a, "b": b} for a, b in flagged_runs(own)]))
        return record(FLAGGED_ARROW, list(zip(*out, strict=True)) or [[]] * 4)

    def settle(batches):
        held: dict[tuple, tuple] = {}  # rows that repeat a document give a context twice
        size, last = 0, None
        for batch in batches:
            for key, windows, ctx, first, content in columns_of(batch, "key", "windows", "ctx", "first", "content"):
                if size > CHUNK and key != last:
                    yield flush(held)
                    held, size = {}, 0
                held[key, windows, ctx] = (first, content)
                size, last = size + len(content), key
        if held:
            yield flush(held)

    dealt = contents.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "windows", "ctx", "first", "content").mapInArrow(settle, FLAGGED)


def _settled_hot(contents: DataFrame, scheme, earlier_only: bool) -> DataFrame:
    """The same for keys with too many differing contexts: an aggregate over their windows."""
    schema = pa.schema([("key", pa.int64()), ("windows", pa.int32()), ("ctx", pa.int64()), ("first", pa.int64()), ("i", pa.int32()), ("name", pa.binary())])

    def spread(batches):
        for batch in batches:
            for key, windows, ctx, first, content in columns_of(batch, "key", "windows", "ctx", "first", "content"):
                names = [xxhash.xxh3_128_digest(w) for w in scheme.windows(content)]
                n = len(names)
                yield record(schema, [[key] * n, [windows] * n, [ctx] * n, [first] * n, range(n), names])

    each = kept(contents.dropDuplicates(["key", "windows", "ctx"]).mapInArrow(spread, "key long, windows int, ctx long, first long, i int, name binary"), "hot-windows")
    groups = each.groupBy("key", "name").agg(F.count("*").alias("n"), F.min("first").alias("least"))
    hit = each.join(groups, ["key", "name"]).filter(F.col("first") > F.col("least") if earlier_only else F.col("n") > 1)

    def joined(batches):
        for batch in batches:
            rows = []
            for key, windows, ctx, places in columns_of(batch, "key", "windows", "ctx", "places"):
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                rows.append((key, windows, ctx, [{"a": a, "b": b} for a, b in flagged_runs(flags)]))
            yield record(FLAGGED_ARROW, list(zip(*rows, strict=True)) or [[]] * 4)

    return hit.groupBy("key", "windows", "ctx").agg(F.collect_list("i").alias("places")).mapInArrow(joined, FLAGGED)  # MOST places at most


def removals(docs: DataFrame, scheme, name: str, earlier_only: bool, cut: Callable, schema: pa.Schema, columns: str) -> DataFrame:
    """Rows of ``cut(doc_id, text, merged ranges)`` for every document."""
    docs = keyed(docs)
    ranges = repeated_ranges(docs, scheme, name, earlier_only)
    joined = docs.join(ranges, same_row(docs, ranges), "left").select(docs["doc_id"], docs["text"], ranges["ranges"])

    def rows(batches):
        for batch in batches:
            for doc_ids, texts, own in [(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]:
                made = [cut(d, t or "", merged([(r["a"], r["b"]) for r in o or []])) for d, t, o in zip(doc_ids, texts, own, strict=True)]
                yield record(schema, list(zip(*made, strict=True)) or [[]] * len(schema))

    return joined.mapInArrow(rows, columns)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
