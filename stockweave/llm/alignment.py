"""Tokens of two tokenizers linked where they end at the same byte.

Tokenizer A (a byte-level BPE file) encodes a space and the text, tokenizer B (a sentencepiece file)
the text, before which it puts a space itself, so both spell the same bytes. Within a task texts
are taken in slices of SLICE characters and stay in Arrow: texts are cut into words at spaces that no
token of either spans, each distinct word is encoded once and its ids are taken for all its
occurrences. Ids are lists whose flattened values and parent indices give one row per token, segmented cumulative sums of the tokens' lengths give the
byte at which each ends in its document, and a hash join on document and end finds the common ends.
They cut both token lists into groups; the last tokens of a group are linked.

A link's tokens end together, so the bytes of one are a suffix of the other's. Two vocabularies
therefore have at most as many linkable pairs as there are suffixes of A's tokens in B and of B's in
A (324,297 for the files in use), whatever the corpus. Partial counts of pairs, made by
``Table.group_by`` in each task, are merged by Spark and only then sent back to all tasks, with each
pair's place among those of its B id; ``pair_bound`` gives the bound and a table beyond it is refused.

Defined results: null and empty texts, and texts that one of the tokenizers doesn't spell back
byte by byte (such as those that hold U+2581), have no tokens: all counts zero, no link, the digest
''. Rows that repeat a doc_id are rows of their own. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, keyed
from .wordpieces import EDGE, SAFE_SPACE, byte_characters, wordpieces

#: Characters of the texts that are aligned at once, links that are counted at once; a longer text is a slice of its own.
SLICE = 500_000
#: Distinct words whose ids a worker keeps between slices.
CACHED = 150_000
EDGED = rf"(?s)\A{EDGE}(.*{EDGE})?\z"
WORD_SIGN = "▁"
COUNTS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
ALIGNED = "doc_id long, th long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_a array<int>, link_b array<int>"
_ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("th", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32()))])


class Tokenizers:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = wordpieces(path_a)
        alphabet = {c: bytes([i]) for i, c in enumerate(byte_characters())}
        with open(path_a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * self.a.size
        for token, i in vocab.items():
            if all(c in alphabet for c in token):
                self.bytes_a[i] = b"".join([alphabet[c] for c in token])
        model = self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace(WORD_SIGN, " ").encode()
            for i, p in enumerate(pieces)]
        self.space = model.piece_to_id(WORD_SIGN)  # the library encodes '' as nothing
        #: Whether no piece holds a space after another character, so that words are encoded apart.
        self.apart = self.space != model.unk_id() and not any(re.search(f"[^{WORD_SIGN}]{WORD_SIGN}", p) for p in pieces)
        self.lengths_a, self.lengths_b = (pa.array([len(x) for x in table], pa.int32()) for table in (self.bytes_a, self.bytes_b))
        # An id with the sign after it: within a list, at a group's end on A's side, on B's side, at a document's end.
        self.shown = pa.array([f"{i}{sign}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in (",", "|", ";", "")], pa.binary())
        self.spelt_a, self.spelt_b = pa.array(self.bytes_a, pa.binary()), pa.array(self.bytes_b, pa.binary())


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def pair_bound(path_a: str, path_b: str) -> int:
    """How many pairs of ids can be linked: one's bytes are the other's suffix."""
    both = tokenizers(path_a, path_b)
    a, b = Counter(filter(None, both.bytes_a)), Counter(filter(None, both.bytes_b))
    longer_a = sum(n * b[x[i:]] for x, n in a.items() for i in range(len(x)))
    return longer_a + sum(n * a[x[i:]] for x, n in b.items() for i in range(1, len(x)))


def apart(words: pa.Array) -> np.ndarray:
    """Which words begin and end with characters that are surely no white space."""
    return pc.match_substring_regex(words, EDGED).to_numpy(zero_copy_only=False)


def unit_lists(texts: pa.Array, both: Tokenizers) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """Places of texts and their units, which are cut at spaces between two such characters."""
    words = pc.split_pattern(texts, " ")
    flat = words.flatten().dictionary_encode()
    unsafe = np.full(len(texts), not both.apart)
    unsafe[pc.list_parent_indices(words).to_numpy()[~apart(flat.dictionary)[flat.indices.to_numpy()]]] = True
    at = np.flatnonzero(~unsafe)
    if len(at):
        yield at, words if len(at) == len(texts) else words.take(pa.array(at))
    at = np.flatnonzero(unsafe)
    if len(at):
        yield at, pa.array([SAFE_SPACE.split(t) if both.apart else [t] for t in texts.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))


def spells(ids: pa.ListArray, table: pa.Array, wanted: pa.Array) -> np.ndarray:
    """Which lists of ids spell the bytes wanted."""
    tokens = table.take(ids.flatten())
    got = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.frombuffer(tokens.buffers()[1], np.int32)[ids.offsets.to_numpy()]), tokens.buffers()[2]])
    return pc.equal(got, wanted).to_numpy(zero_copy_only=False)


def token_lists(units: pa.ListArray, both: Tokenizers) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
    """A's and B's ids of every text, and which texts both spell back."""
    coded, parents = units.flatten().dictionary_encode(), pc.list_parent_indices(units).to_numpy()
    distinct, parts, ends = coded.dictionary.to_pylist(), both.a.parts, units.offsets.to_numpy()
    one = [parts[u] if edged else both.a.part(" " + u) for u, edged in zip(distinct, apart(coded.dictionary).tolist(), strict=True)]
    places = pa.array(np.cumsum([0, *(len(x) // 4 for x in one)]), pa.int32())
    lists = [pa.ListArray.from_arrays(places, pa.array(np.frombuffer(b"".join(one), np.int32)))]
    lists.append(pa.array([x or [both.space] for x in both.b.encode(distinct, num_threads=1)], pa.list_(pa.int32())))
    wanted = pc.binary_join_element_wise("", coded.dictionary, " ").cast(pa.binary())
    spelt = spells(lists[0], both.spelt_a, wanted) & spells(lists[1], both.spelt_b, wanted)
    out = []
    for ids in lists:
        ids = ids.take(coded.indices)
        out.append(pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[ends - ends[0]]), ids.flatten()))
    good = np.ones(len(units), bool)
    good[parents[~spelt[coded.indices.to_numpy()]]] = False
    return *out, good


def token_rows(lists: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """One row per token of a slice's documents: doc (its place in the slice), end (the byte after it) and its place among all."""
    doc, flat = pc.list_parent_indices(lists).cast(pa.int32()), lists.flatten()
    total = pc.cumulative_sum(lengths.take(flat).cast(pa.int64()))
    before = np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]  # bytes of the documents before
    end = pc.subtract(total, pa.array(before).take(doc)).cast(pa.int32())
    return pa.table({"doc": doc, "end": end, name: pa.array(np.arange(len(flat), dtype=np.int32))})


def common_ends(a: pa.ListArray, b: pa.ListArray, both: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, place of A's token, place of B's token for every common end, in order."""
    rows = token_rows(a, both.lengths_a, "at_a").join(token_rows(b, both.lengths_b, "at_b"), ["doc", "end"], join_type="inner", use_threads=False)
    at_a = rows["at_a"].to_numpy()
    order = np.argsort(at_a, kind="stable")
    return rows["doc"].to_numpy()[order], at_a[order], rows["at_b"].to_numpy()[order]


def shown_groups(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Codes into ``Tokenizers.shown`` for all tokens of a slice in the order of the groups' text; ``last``: groups that end a document."""
    code_a, code_b = a * 4, b * 4
    code_a[at_a] += 1
    code_b[at_b] += np.where(last, 3, 2).astype(np.int32)
    out = np.empty(len(a) + len(b), np.int32)
    out[np.arange(len(a)) + np.repeat(np.concatenate([[0], at_b[:-1] + 1]), np.diff(at_a, prepend=-1))] = code_a
    out[np.arange(len(b)) + np.repeat(at_a + 1, np.diff(at_b, prepend=-1))] = code_b
    return out


def aligned_units(units: pa.ListArray, both: Tokenizers) -> tuple[np.ndarray, list[str], pa.ListArray, pa.ListArray]:
    """n_a, n_b and n_groups in rows, digests and the linked ids of a slice's texts, given by their units."""
    lists_a, lists_b, good = token_lists(units, both)
    counts, digests = np.zeros((3, len(units)), np.int64), [""] * len(units)
    at = np.flatnonzero(good)
    links = [np.zeros(0, np.int32)] * 2
    if len(at):
        a, b = (lists_a, lists_b) if len(at) == len(units) else (lists_a.take(pa.array(at)), lists_b.take(pa.array(at)))
        doc, at_a, at_b = common_ends(a, b, both)
        flat_a, flat_b = a.flatten().to_numpy(), b.flatten().to_numpy()
        shown = both.shown.take(pa.array(shown_groups(flat_a, flat_b, at_a, at_b, np.append(doc[1:] != doc[:-1], True))))
        counts[:, at] = pc.list_value_length(a).to_numpy(), pc.list_value_length(b).to_numpy(), np.bincount(doc, minlength=len(at))
        place, data = np.frombuffer(shown.buffers()[1], np.int32)[: len(shown) + 1], memoryview(shown.buffers()[2])
        ends = place[np.concatenate([[0], np.cumsum(counts[0, at] + counts[1, at])])].tolist()
        for k, i in enumerate(at.tolist()):
            digests[i] = hashlib.sha256(data[ends[k] : ends[k + 1]]).hexdigest()
        links = [flat_a[at_a], flat_b[at_b]]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts[2])]).astype(np.int32))
    return counts, digests, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in links)


def aligned_slice(batch: pa.RecordBatch, both: Tokenizers) -> Iterator[pa.RecordBatch]:
    """One row per row of a slice."""
    filled = pc.fill_null(pc.greater(pc.binary_length(batch.column("text")), 0), False)
    empty, batch = batch.filter(pc.invert(filled)), batch.filter(filled)
    if empty.num_rows:
        none, zero = pa.array([[]] * empty.num_rows, pa.list_(pa.int32())), np.zeros(empty.num_rows, np.int64)
        yield row_batch(empty, [zero] * 3, [""] * empty.num_rows, none, none)
    if batch.num_rows:
        for at, units in unit_lists(batch.column("text"), both):
            yield row_batch(batch.take(pa.array(at)), *aligned_units(units, both))


def row_batch(rows: pa.RecordBatch, counts: np.ndarray, digests: list[str], link_a: pa.ListArray, link_b: pa.ListArray) -> pa.RecordBatch:
    n_a, n_b, n = map(pa.array, counts)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), n_a, n_b, n, n, pa.array(digests, pa.string()), link_a, link_b], schema=_ALIGNED)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its tokens' numbers, groups, links (link_a, link_b: the linked ids in order) and the digest of its groups."""

    def align(batches):
        both = tokenizers(path_a, path_b)
        for batch in portions(batches, lambda b: pc.fill_null(pc.utf8_length(b.column("text")), 0)):
            yield from aligned_slice(batch, both)
            for cache in (both.a.parts, both.a.pieces):
                if len(cache) > CACHED:
                    cache.clear()
            pa.default_memory_pool().release_unused()

    return keyed(docs).mapInArrow(align, ALIGNED)


def link_number(batch: pa.RecordBatch) -> pa.Array:
    return pc.list_value_length(batch.column("link_a"))


def portions(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the rows of each have a size of SLICE at most, or are one row."""
    for batch in batches:
        ends, start = np.cumsum(size(batch).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n: how many links of all documents hold the pair."""

    def count(batches):
        part: list[pa.Table] = []
        for batch in portions(batches, link_number):
            rows = pa.table({"a": pc.list_flatten(batch.column("link_a")), "b": pc.list_flatten(batch.column("link_b"))})
            part.append(rows.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
            if len(part) == 8:
                part = [merged(part)]
        if part:
            yield from merged(part).cast(COUNTS).to_batches()

    return links.select("link_a", "link_b").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


def ranked(counts: DataFrame) -> DataFrame:
    """The counts with ``best``: whether a pair's count is its B id's highest."""
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(links: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """The documents with n_best and count_sum; ``counts`` holds at most ``bound`` rows."""
    table = counts.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"more linked pairs than the vocabularies allow: {bound}")
    key = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    sent = links.sparkSession.sparkContext.broadcast((key[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64)))
    names = [n for n in links.columns if n not in ("link_a", "link_b")]

    def score(batches):
        keys, n, best = sent.value
        for batch in portions(batches, link_number):
            a, b = batch.column("link_a"), batch.column("link_b")
            pair = pc.list_flatten(a).to_numpy().astype(np.int64) << 32 | pc.list_flatten(b).to_numpy().astype(np.int64)
            place, doc = np.searchsorted(keys, pair), pc.list_parent_indices(a)
            sums = pa.table({"doc": doc, "n": n[place], "best": best[place]}).group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
            totals = np.zeros((2, batch.num_rows), np.int64)
            totals[:, sums["doc"].to_numpy()] = sums["best_sum"].to_numpy(), sums["n_sum"].to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(totals[0]), pa.array(totals[1])], [*names, "n_best", "count_sum"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema if f.name in names)
    return links.mapInArrow(score, f"{types}, n_best long, count_sum long")


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``aligned`` without the links, with n_best and count_sum."""
    links = kept(aligned(docs, path_a, path_b), "aligned")
    counts = kept(ranked(pair_counts(links)), "pair-counts")
    return scored(links, counts, pair_bound(path_a, path_b))


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The table of pairs alone: a, b, n, best."""
    return ranked(pair_counts(aligned(docs, path_a, path_b)))

