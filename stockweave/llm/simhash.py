"""Near-duplicates by SimHash fingerprints that meet at the anchors of a covering code.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit of one of their
halves. The anchors of a half are the codewords of the Hamming code of length 31, which is
perfect with covering radius 1, followed by either value of the 32nd bit. A half goes to every
anchor within radius plus threshold, 1 + 1: with s the syndrome, the codeword at distance 1
under both values of the last bit and the 15 codewords at distance 2; a codeword goes to itself
under both values. Only different fingerprints are compared, anchor by anchor, and each anchor
passes on a spanning forest of its links, never all pairs.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other;
equal texts have equal fingerprints and so one component; rows that repeat a doc_id keep a
fingerprint each and share the component's least doc_id; a null doc_id is never a component's
name unless all its members are null; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, keyed, record, text_hash
from .components import components

DISTANCE = 3
#: Fingerprints of one anchor that are compared at a time.
BLOCK = 4096
SYNDROME = [int(sum(((1 << (p - 1)) for p in range(1, 32) if p >> k & 1))) for k in range(5)]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` lower-cased words, of all words if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], "<u8")
    ends = np.append(np.flatnonzero(np.frombuffer(flat, np.uint8) == 32), len(flat))
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - size or None]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), "<u8", len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th, fp (signed 64-bit) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def made(batches):
        for batch in batches:
            yield record(schema, [batch.column("doc_id"), batch.column("th"), [fingerprint(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]])

    return keyed(docs).mapInArrow(made, "doc_id long, th long, fp long")


def parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64) & 1


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor within radius plus threshold of a fingerprint's halves."""
    out_a, out_f = [], []
    for half in (0, 1):
        value = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
        last, word = value >> 31, value & 0x7FFFFFFF
        syndrome = sum(parity(word & m) << k for k, m in enumerate(SYNDROME))
        nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        for bit in (last, 1 - last):
            out_a.append(half << 33 | bit << 32 | nearest)
            out_f.append(fps)
        off = syndrome > 0
        for i in range(1, 32):
            pair = i ^ syndrome
            own = off & (i < pair)
            out_a.append((half << 33 | last << 32 | word ^ (1 << (i - 1)) ^ (1 << np.maximum(pair - 1, 0)))[own])
            out_f.append(fps[own])
    return np.concatenate(out_a), np.concatenate(out_f)


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one anchor's fingerprints: for each component, from its members."""
    bits, n = fps.view(np.uint64), len(fps)
    root = np.arange(n)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = np.bitwise_count(bits[i : i + BLOCK, None] ^ bits[None, j : j + BLOCK]) <= distance
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            a, b = a[a < b], b[a < b]
            while True:  # each link takes both ends to the lesser root, until none changes
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                root = root[root]
                if (before == root).all() and (root[a] == root[b]).all():
                    break
    own = np.flatnonzero(root != np.arange(n))
    return fps[own], fps[root[own]]


def linked(anchor: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by anchor."""
    at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(at, len(anchor)))
    bits, a, b = fps.view(np.uint64), [], []
    for k in range(1, 8):  # small anchors: each row with the k-th next one
        own = (anchor[:-k] == anchor[k:]) & (np.bitwise_count(bits[:-k] ^ bits[k:]) <= distance) & (np.repeat(size, size)[:-k] <= 8)
        a.append(fps[:-k][own])
        b.append(fps[k:][own])
    for s, n in zip(at[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        x, y = forest(fps[s : s + n], distance)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect what the fingerprints within ``distance`` connect. fps: fp, distinct."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves cover a distance of 3 at most")
    pair = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
    link = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches):
        for batch in batches:
            yield record(pair, list(anchors(batch.column(0).to_numpy(zero_copy_only=False))))

    def compared(batches) -> Iterator[pa.RecordBatch]:
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor = np.concatenate((anchor, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            if len(anchor) > 200_000 and anchor[0] != anchor[-1]:
                cut = int(np.searchsorted(anchor, anchor[-1]))
                yield record(link, list(linked(anchor[:cut], fp[:cut], distance)))
                anchor, fp = anchor[cut:], fp[cut:]
        if len(anchor):
            yield record(link, list(linked(anchor, fp, distance)))

    dealt = fps.select("fp").mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """doc_id, th, fp, root (a fingerprint that stands for the component), component_id (its least doc_id) of every row."""
    own = kept(fingerprints(docs, shingle), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(fps, distance))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, that are their component's first by doc_id, then by hash of the text."""
    return first_of_each(docs, kept(near_duplicates(docs, shingle, distance), "near-duplicates"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first among those of one root. found: doc_id, th, root of every row."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.th").alias("_th"))
    stay = docs.join(first, docs["doc_id"].eqNullSafe(first["_id"]) & (text_hash() == first["_th"]), "left_semi")
    repeated = found.groupBy("doc_id", "th").count().filter("count > 1")
    if repeated.isEmpty():
        return stay
    own = next(name for name in (f"_th{i}" for i in count()) if name not in {c.lower() for c in docs.columns})  # no column of the table
    return stay.withColumn(own, text_hash()).dropDuplicates(["doc_id", own]).drop(own)


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
