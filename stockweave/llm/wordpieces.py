"""Token ids of whole texts from a public BPE file, one call of the library per distinct word.

Both pre-tokenizers in use cut at every space between two non-space characters, so a text's ids
are its space-separated parts' ids in a row. Parts repeat, so they are kept in a bounded cache
of the worker. A part with characters outside plain Latin text goes through the library's whole
encoder; so does a text, or the stretch of it, without such a space.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

# The byte-level pre-tokenizer's pattern.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Never white space, in any Unicode version.
EDGE = "[!-~¡-¬®-ᙹ]"
SAFE_SPACE = re.compile(f"(?<={EDGE}) (?={EDGE})")
EDGES = re.compile(f"{EDGE}(.*{EDGE})?", re.DOTALL)
#: No combining marks, one lower-case form each.
PLAIN = re.compile("[!-~¡-¬®-įı-ſ\n]+")
#: Entries of a cache's generation.
PARTS, PIECES = 400_000, 250_000
#: Signs that end a word; after letters they are one piece in both pre-tokenizers.
TAIL = ".,!?;:"


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Unsafe(Exception):
    """A part that begins or ends with white space."""


class Recent(dict):
    """A cache of two generations: when the younger is full it becomes the older, whose entries in use move back."""

    def __init__(self, size: int) -> None:
        self.size, self.older = size, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key: str) -> bytes:
        data = self.older.get(key)
        if data is None:
            data = self.made(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = data
        return data


class Parts(Recent):
    """ids by part, as little-endian unsigned 32-bit integers."""

    def __init__(self, owner: WordPieces) -> None:
        super().__init__(PARTS)
        self.owner = owner

    def made(self, part: str) -> bytes:
        owner, core = self.owner, part.rstrip(TAIL)
        if core.isalpha() and (core.isascii() or PLAIN.fullmatch(core)):
            ids = owner.pieces[owner.lead + (core.lower() if owner.lower else core)]
            return ids + owner.pieces[part[len(core) :]] if len(core) < len(part) else ids
        if EDGES.fullmatch(part):
            return owner.part(owner.lead + part)
        raise Unsafe


class Pieces(Recent):
    """ids by what the pre-tokenizer cuts out."""

    def __init__(self, owner: WordPieces) -> None:
        super().__init__(PIECES)
        self.tokenize, self.alphabet = owner.model.tokenize, byte_characters()

    def made(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            word = piece.replace(" ", self.alphabet[32])
        else:
            word = "".join([self.alphabet[b] for b in piece.encode()])
        ids = [t.id for t in self.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordPieces:
    """``encode(text)`` gives the ids of the library's ``encode(text, add_special_tokens=False)`` as bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = "Lowercase" in kinds
        if self.lower:
            self.lead, pattern = "", spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            self.lead, pattern = " ", BYTE_LEVEL_PATTERN
        self.pattern = regex.compile(pattern)
        self.parts, self.pieces = Parts(self), Pieces(self)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def forget(self) -> None:
        """Empty the caches."""
        self.parts.forget()
        self.pieces.forget()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self.part(first) + b"".join(map(self.parts.__getitem__, rest))
        except Unsafe:
            first, *rest = SAFE_SPACE.split(text)
            return self.part(first) + b"".join([self.parts[p] if EDGES.fullmatch(p) else self.part(self.lead + p) for p in rest])

    def part(self, part: str) -> bytes:
        if not PLAIN.fullmatch(part.removeprefix(self.lead) if self.lead else part):
            return np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(part.lower() if self.lower else part)))


@lru_cache(maxsize=2)
def wordpieces(path: str) -> WordPieces:
    """One per Python worker and file; workers are reused between tasks."""
    return WordPieces(path)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
