"""Substring dedup of byte strings by suffix arrays, built with a difference cover modulo 3.

Before sorting, the text is reduced without loss: the least hash of a window's short substrings
is its key, and only contexts that share a key with a differing one go on (``repeats.py``). Spark
deals these by key; a task sorts the suffixes of its keys' contexts: it sorts and names the
triples at positions 1 and 2 modulo 3, recurses on the names until they are unique or as long as
a window, sorts the remaining suffixes by one character and the next one's rank, merges both by
rank, and compares the prefixes of neighbours.

Defined results: null and empty texts have no bytes; a text shorter than a window loses nothing;
rows that repeat a document are copies of one another; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import removals, runs

U = np.uint64
#: Odd multipliers of the substring hash.
MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]
GRAM = 8 * len(MULTIPLIERS)
#: Low bits of a hash that give way to the place; the same for texts of all lengths.
PLACE_BITS = U(32)


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as an integer."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def window_anchors(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of the least hash of its substrings of GRAM bytes, and that hash.

    Of those that agree in the upper bits the leftmost counts, so two windows with one place are
    never equal, and equal windows have their places alike, however long their texts are.
    """
    at, n = words_at(data), len(data) - GRAM + 1
    h = at[:n] * MULTIPLIERS[0]
    h ^= h >> U(29)
    for j, m in enumerate(MULTIPLIERS[1:], 1):
        h += at[8 * j : 8 * j + n]
        h *= m
        h ^= h >> U(32)
    low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(n, dtype=np.uint64)
    width, count, step = size - GRAM + 1, len(data) - size + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    place = (np.minimum(low[:count], low[width - step : width - step + count]) & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    return place, h


def named(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks of values from 1 on, equal ones alike; whether all differ."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(values), np.int64)
    names[order] = np.cumsum(new)
    return names, bool(new.all())


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix; suffixes that agree in ``depth`` characters may come in any order.

    Characters are 1 to 2**21 - 1, and the text has fewer than 2**21 of them.
    """
    n = len(text)
    t = np.concatenate((text, np.zeros(3, np.int64)))
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i : i + 3].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names, unique = named((t[sample] << 42) | (t[sample + 1] << 21) | t[np.minimum(sample + 2, n + 2)])
    if not unique:
        if depth > 3:
            names = suffix_ranks(names, -(-depth // 3)) + 1
        else:
            order = np.argsort(names, kind="stable")
            names = np.empty(len(sample), np.int64)
            names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rest = np.arange(0, n, 3)
    key = (t[rest] << 21) | rank[rest + 1]
    rest = rest[np.argsort(key)]
    # of the sampled suffixes, those before each remaining one
    first = np.sort((t[one] << 21) | rank[one + 1])
    second = np.sort((t[two] << 42) | (t[two + 1] << 21) | rank[two + 2])
    before = np.searchsorted(first, (t[rest] << 21) | rank[rest + 1])
    before += np.searchsorted(second, (t[rest] << 42) | (t[rest + 1] << 21) | rank[rest + 2])
    before = np.maximum.accumulate(before)
    out = np.empty(n + 1, np.int64)
    out[rest] = np.arange(len(rest)) + before
    earlier = np.cumsum(np.bincount(before, minlength=len(sample) + 1))
    out[sample] = names - 1 + earlier[names - 1]
    out = out[:n]
    return out - 1 if n % 3 == 1 else out  # the empty suffix came first


class ByteScheme:
    """Windows of ``size`` consecutive UTF-8 bytes."""

    limit = 1_500_000  # suffixes of a chunk have ranks below 2**21

    def __init__(self, size: int = 200) -> None:
        assert size >= GRAM
        self.size = size

    def contexts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        none = np.zeros(0, np.int64)
        for i, text in enumerate(texts):
            data = text.encode()
            if len(data) < self.size:
                continue
            place, h = window_anchors(data, self.size)
            at, length = runs(place, none)
            for p, n, key in zip(at.tolist(), length.tolist(), h[place[at]].view(np.int64).tolist(), strict=True):
                yield i, key, p, n, xxhash.xxh3_64_intdigest(data[p : p + n + self.size - 1]) - (1 << 63)

    def stretches(self, text: str, places: list[tuple[int, int]]) -> list[bytes]:
        data = text.encode()
        return [data[p : p + n + self.size - 1] for p, n in places]

    def windows(self, content: bytes) -> list[bytes]:
        return [content[k : k + self.size] for k in range(len(content) - self.size + 1)]

    def settle(self, contents: list[bytes], firsts: list[int]) -> list[np.ndarray]:
        """Windows that start in two places of the contents."""
        data = b"\0".join(contents)
        text = np.frombuffer(data, np.uint8).astype(np.int64) + 2
        sizes = np.array([len(c) for c in contents])
        begin = np.cumsum(sizes + 1) - sizes - 1
        text[begin[1:] - 1] = 1
        is_window = np.zeros(len(data), bool)
        for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            is_window[b : b + n - self.size + 1] = True
        order = np.empty(len(data), np.int64)
        order[suffix_ranks(text, self.size)] = np.arange(len(data))
        order = order[is_window[order]]
        left, right, at = order[:-1], order[1:], words_at(data)
        for k in [*range(0, self.size - 7, 8), self.size - 8]:
            same = at[left + k] == at[right + k]
            left, right = left[same], right[same]
        hit = np.zeros(len(data), bool)
        hit[left] = hit[right] = True
        return [hit[b : b + n - self.size + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def without_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """Each document without the bytes of any string of ``size`` bytes that starts anywhere else too.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(doc_id, text, ranges):
        data, at, rest = text.encode(), 0, []
        for a, b in ranges:
            rest.append(data[at:a])
            at = b
        left = b"".join([*rest, data[at:]])
        return doc_id, len(data), len(data) - len(left), len(ranges), hashlib.sha256(left).hexdigest(), left

    return removals(docs, ByteScheme(size), "difference-cover", False, cut, schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
