"""Substring dedup of word runs by recompression.

A round names runs of one symbol, then pairs of neighbours: a hash splits the symbols into left
and right ones, and a left one followed by a right one becomes a new symbol. Names are hashes of
what they replace, so every task gives equal runs and pairs the same global name without a table
of names, and equal substrings carry the same symbols but for a few at each end. Per window the
rounds keep which symbols depend on nothing outside the window; the least run of three of them, of
the highest round that has one, is the window's key. Windows with a shared symbol are then compared in full
(``repeats.py``).

Defined results: null and empty texts have no words and stay as they are; a text of fewer words
than a window loses nothing; rows that repeat a doc_id never count as earlier than one another;
a null doc_id is later than all others; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import removals, runs

ROUNDS = 3
#: Neighbouring symbols that make a key; one alone is a phrase that recurs by chance.
GRAM = 3
U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A value per byte, and powers of an odd base with their inverses, for the hashes of words.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * A)
BASE = U(0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x)))) for x in (BASE, inverse))


def word_symbols(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, starts and ends of words that are joined by one space."""
    data = np.frombuffer(flat, np.uint8)
    space = np.flatnonzero(data == 32)
    start, end = np.concatenate(([0], space + 1)), np.append(space, len(data))
    power, inverse = powers(1 << max(16, len(data).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * power[: len(data)])))
    return mix((total[end] - total[start]) * inverse[start]), start, end


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each pair of bounds, none empty."""
    power = np.floor(np.log2(high - low)).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    table, width = values, 1
    for k in range(int(power.max()) + 1):
        own = power == k
        out[own] = np.minimum(table[low[own]], table[high[own] - width])
        if len(table) > width:
            table, width = np.minimum(table[:-width], table[width:]), 2 * width
    return out


def window_keys(symbols: np.ndarray, first: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The key of the window at each of ``starts``. ``first`` marks the symbols that begin a text."""
    low, high = starts.copy(), starts + size
    live = np.ones(len(starts), bool)
    levels = [(symbols, low, high, live)]
    for level in range(1, ROUNDS + 1):
        # runs: the outermost symbol of a window may go on outside
        new = first.copy()
        new[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        length = np.diff(np.append(at, len(symbols)))
        letter = symbols[at]
        named = np.where(length > 1, mix(letter + U(level) * A + length.astype(np.uint64) * B), letter)
        side = (mix(letter ^ U(level) * C) & U(1)).astype(bool)  # True: right
        first = first[at]
        low, high = run[np.where(live, low, 0)] + 1, run[np.where(live, high - 1, 0)]
        live = live & (high > low)
        # pairs: a right one at the left edge, or a left one at the right edge, may belong to a pair
        # that reaches outside, unless the letter next to it, which is known, rules that out
        low, high = np.where(live, low, 1), np.where(live, high, 1)
        pair = np.zeros(len(named), bool)
        pair[:-1] = ~side[:-1] & side[1:] & ~first[1:]
        low = low + pair[low - 1]
        high = high - pair[np.minimum(high, len(named)) - 1]
        live = live & (high > low)
        head = np.ones(len(named), bool)
        head[1:] = ~pair[:-1]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        symbols = named[at]
        both = pair[at]
        symbols[both] = mix(symbols[both] * A + mix(named[at[both] + 1] + U(level) * B))
        first = first[at]
        low, high = np.where(live, group[np.where(live, low, 0)], 0), np.where(live, group[np.where(live, high - 1, 0)] + 1, 1)
        levels.append((symbols, low, high, live))
    keys, open_ = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for level in range(ROUNDS, -1, -1):
        symbols, low, high, live = levels[level]
        own = open_ & live & (high - low >= GRAM)
        if own.any():
            gram = symbols ^ A
            for k in range(1, GRAM):
                gram = mix(gram[:-1] * A + symbols[k:])
            keys[own] = mix(least(mix(gram), low[own], high[own] - GRAM + 1) + U(level))
            open_ &= ~own
    return keys


class WordScheme:
    """Windows of ``size`` consecutive words."""

    limit = 2_000_000

    def __init__(self, size: int = 50) -> None:
        self.size = size

    def contexts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        flats = [(i, b" ".join(t.encode().split())) for i, t in enumerate(texts)]
        held = [(i, f, n) for i, f, n in ((i, f, f.count(b" ") + 1) for i, f in flats) if n >= self.size]
        if not held:
            return
        flat = b" ".join([f for _, f, _ in held])
        counts = np.array([n for _, _, n in held])
        ends = np.cumsum(counts)
        begin = ends - counts
        with np.errstate(over="ignore"):
            symbols, byte, stop = word_symbols(flat)
            first = np.zeros(len(symbols), bool)
            first[begin] = True
            starts = np.flatnonzero(np.arange(len(symbols)) + self.size <= np.repeat(ends, counts))
            keys = window_keys(symbols, first, starts, self.size)
        of = np.repeat(np.arange(len(held)), counts - self.size + 1)
        at, length = runs(keys, np.flatnonzero(np.diff(of, prepend=-1)))
        text, place = of[at], starts[at]
        byte, stop = byte[place], stop[place + length + self.size - 2]
        rows = zip(text.tolist(), (place - begin[text]).tolist(), length.tolist(), keys[at].view(np.int64).tolist(), byte.tolist(), stop.tolist(), strict=True)
        for k, p, n, key, a, b in rows:
            yield held[k][0], key, p, n, xxhash.xxh3_64_intdigest(flat[a:b]) - (1 << 63)

    def stretches(self, text: str, places: list[tuple[int, int]]) -> list[bytes]:
        words = text.encode().split()
        return [b" ".join(words[p : p + n + self.size - 1]) for p, n in places]

    def windows(self, content: bytes) -> list[bytes]:
        words = content.split(b" ")
        offset = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
        return [content[offset[k] : offset[k + self.size] - 1] for k in range(len(words) - self.size + 1)]

    def settle(self, contents: list[bytes], firsts: list[int]) -> list[np.ndarray]:
        """Windows that also start in a context of a smaller first document, by 128-bit digests of their words."""
        all_windows = [list(map(xxhash.xxh3_128_digest, self.windows(c))) for c in contents]
        seen: dict[bytes, int] = {}
        for windows, first in zip(all_windows, firsts, strict=True):
            for w in windows:
                if seen.setdefault(w, first) > first:
                    seen[w] = first
        return [np.fromiter((seen[w] < first for w in windows), bool, len(windows)) for windows, first in zip(all_windows, firsts, strict=True)]


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """Each document without the words that a smaller doc_id's document also has, by whole windows.

    doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(doc_id, text, ranges):
        words = text.encode().split()
        rest, at = [], 0
        for a, b in ranges:
            rest += words[at:a]
            at = b
        rest += words[at:]
        left = b" ".join(rest)
        return doc_id, len(words), len(words) - len(rest), hashlib.sha256(left).hexdigest(), left.decode()

    return removals(docs, WordScheme(size), "recompression", True, cut, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
