"""Byte-level BPE by a local rank file: ids of whole texts with the tiktoken library, and their bytes again.

The library's pattern never matches across the place between a character that is no white space and
the white space after it, nor before the last white-space character of a run: what stands there is
encoded alike on either side. A long text is cut at such places, one at least for every CHUNK
characters where there are any; between two of them stands one run of white space and one of other
characters. White space too long for the pattern's matcher, whose stack a run of about a million
characters exhausts, is one match by itself and goes straight to the merges. Ids are decoded to raw
bytes, which need not be valid UTF-8 token by token.

Defined results: null and empty texts have no ids and decode to no bytes; every row gives one row,
repeated ones too; an empty table gives none. Special tokens' strings are plain text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, record

# Unicode's white space.
WHITE = "\t-\r \x85\xa0  -     　"
AFTER_WORD = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
LEAD = re.compile(f"[{WHITE}]+")
CHUNK = 50_000


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One per Python worker, file and pattern; a line of the file is a token in base64 and its rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only between a word and the white space after it."""
    at = 0
    while len(text) - at > size:
        cut = AFTER_WORD.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def text_ids(encoding: tiktoken.Encoding, text: str, size: int = CHUNK) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for chunk in chunks(text, size):
        if len(chunk) <= 2 * size:
            ids += encoding.encode_ordinary(chunk)
        else:
            for part in words_and_gaps(chunk, size):
                gap = LEAD.fullmatch(part)
                ids += encoding._encode_single_piece(part.encode()) if gap else encoding.encode_ordinary(part)
    return ids


def words_and_gaps(chunk: str, size: int) -> Iterator[str]:
    """A long chunk cut before every word, long white space apart: all but its last character, which belongs to what follows."""
    at = 0
    for gap in re.finditer(f"[{WHITE}]{{{size},}}", chunk):
        if gap.start() > at:
            yield chunk[at : gap.start()]
        at = gap.end() if gap.end() == len(chunk) else gap.end() - 1
        yield chunk[gap.start() : at]
    if at < len(chunk):
        yield chunk[at:]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, th (the text's hash), n_tokens, ids: little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            ids = [np.asarray(text_ids(encoding, t or ""), "<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield record(schema, [batch.column("doc_id"), batch.column("th"), ids])

    out = keyed(docs).mapInArrow(encode, "doc_id long, th long, ids binary")
    return out.select("doc_id", "th", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``encoded`` and ``bytes``, what the ids stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])

    def decode(batches):
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            data = [encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield record(schema, [*(batch.column(n) for n in ("doc_id", "th", "n_tokens", "ids")), data])

    return tokens.select("doc_id", "th", "n_tokens", "ids").mapInArrow(decode, "doc_id long, th long, n_tokens long, ids binary, bytes binary")
