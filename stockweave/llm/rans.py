"""Static range asymmetric numeral system for token ids, many interleaved lanes at a time.

A block codes token i in lane i mod K, one row of K tokens per step. States are 64-bit and
renormalise by 32-bit words; frequencies sum to 2**SCALE. A block holds:

    magic 4s, tokens u64, lanes u32, rows between checkpoints u32, checkpoints u32, words u64, crc32 of the ids u32,
    states of lanes u64 * K, per checkpoint: word offset u64 and states u64 * K, the words u32, crc32 of all before u32

The decoder begins at the block's start or at any checkpoint. No ids make a block of one empty row, which decodes to no ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sQIIIQI")
MAGIC = b"RNS1"
#: Wide rows keep the time in numpy; a checkpoint is as large as a row of states.
LANES, EVERY = 4096, 128


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 each, so that any id can be coded."""
    total = 1 << SCALE
    if len(counts) > total // 2:
        raise ValueError("vocabulary too large for the table")
    share = counts.astype(np.float64) / max(1, counts.sum())
    out = 1 + np.floor(share * (total - len(counts))).astype(np.int64)
    out[np.argmax(out)] += total - out.sum()
    return out


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - SCALE)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, -(-n // 64)))
        rows = -(-n // lanes)
        grid = np.zeros(rows * lanes, np.uint32)
        grid[:n] = ids
        grid = grid.reshape(rows, lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []
        written, shift, scale, low = 0, np.uint64(32), np.uint64(SCALE), np.uint64(0xFFFFFFFF)
        for r in range(rows - 1, -1, -1):
            if (r + 1) % EVERY == 0 and r + 1 < rows:
                marks.append((r + 1, written, state.copy()))
            f = self.freq[grid[r]]
            over = state >= self.limit[grid[r]]
            if over.any():
                words.append((state[over] & low).astype("<u4"))
                written += len(words[-1])
                state[over] >>= shift
            q = state // f
            state = (q << scale) + (state - q * f) + self.start[grid[r]]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        body = [HEAD.pack(MAGIC, n, lanes, EVERY, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes())), state.astype("<u8").tobytes()]
        for _, before, at in marks[::-1]:
            body += [struct.pack("<Q", len(stream) - before), at.astype("<u8").tobytes()]
        body.append(stream.tobytes())
        data = b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, data: bytes, checkpoint: int = 0) -> np.ndarray:
        """The ids from the given checkpoint on (0: the start); raises ValueError on a wrong checksum."""
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        magic, n, lanes, every, marks, size, crc = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at, step = HEAD.size, 8 + 8 * lanes
        stream = np.frombuffer(data, "<u4", size, at + 8 * lanes + step * marks)
        place, row = 0, checkpoint * every
        state = np.frombuffer(data, "<u8", lanes, at).copy()
        if checkpoint:
            begin = at + 8 * lanes + step * (checkpoint - 1)
            place = struct.unpack_from("<Q", data, begin)[0]
            state = np.frombuffer(data, "<u8", lanes, begin + 8).copy()
        rows = -(-n // lanes)
        out = np.empty((max(0, rows - row), lanes), np.uint32)
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for r in range(len(out)):
            slot = state & mask
            s = self.symbol[slot]
            out[r] = s
            state = self.freq[s] * (state >> scale) + slot - self.start[s]
            under = state < LOW
            k = int(np.count_nonzero(under))
            if k:
                state[under] = (state[under] << shift) | stream[place : place + k]
                place += k
        ids = out.reshape(-1)[: max(0, n - row * lanes)]
        if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("ids differ from those written")
        return ids
