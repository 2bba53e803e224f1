"""Rank-file BPE, token alignment and the filter audit against brute force."""

import base64
import hashlib
import json
import random
import re
import struct
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from stockweave.llm import alignment, filter_audit, rank_bpe
from stockweave.llm.queries import QUERIES, SQL
from stockweave.llm.wordpieces import byte_characters

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, part string, mask int, ids int, digest int, first int"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    """Documents with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(3)
    signs = ["word", "Ünï", "日本語", "  ", " ", "\n", "\t", "<|endoftext|>", "<s>", "<0x0A>", "🙂", "don't", "12345", "...", "　", "x" * 70, "\x85", "'s"]
    rows = [(1, None, None), (2, "", "a"), (3, " ", ""), (4, "one", "a"), (5, "one", "b"), (5, "one", "b"), (5, "two", "b"), (None, "one", "a"), (None, None, "a"), (6, "under ▁ score", "a")]
    rows += [(7, "A B C D " * 40, "a"), (8, "A B C D " * 40, None), (9, " ".join(f"w{i}" for i in range(80)), "c"), (10, "UPPER lower # sign", "c"), (11, "UPPER lower # sign", "c")]
    rows += [(12, "".join(rng.choice(signs, 40_000)), "a"), (13, "y" * 150_000, "a"), (14, " " * 120_000 + "end", "a"), (15, "a\x00b", "a"), (16, " lead and trail  ", "a")]
    rows += [(20 + k, "".join(rng.choice(signs, 1 + 2 * k)), "ab"[k % 2]) for k in range(60)]
    return rows


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet'").fetchall()


@pytest.fixture(scope="module", params=["cases", "real"])
def documents(request, cases, real):
    return cases if request.param == "cases" else real


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_bpe(spark, documents, library):
    got = rank_bpe.decoded(rank_bpe.encoded(frame(spark, documents), RANKS, PATTERN), RANKS, PATTERN)
    want = []
    for i, t, _ in documents:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.bytes)) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_rank_bpe_query(spark, real, library):
    want = []
    for i, t, _ in real:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    same(QUERIES["op11_rank_bpe"](spark, FOLDER), want)


def test_chunks_encode_alike(library):
    rng = random.Random(1)
    signs = ["a", "bc", " ", "  ", "\n", "\t", "　", "é", "1", "'s", "'", "^", "日本", "\x1c", "\x85", "\xa0", "x" * 40, " " * 30, "\n" * 25, "​"]
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 120)))
        for size in (1, 3, 10, 20):
            assert rank_bpe.text_ids(library, text, size) == library.encode_ordinary(text)
            assert "".join(rank_bpe.chunks(text, size)) == text


def test_white_space_beyond_the_matchers_stack(library):
    for text in (" " * 1_500_000, "a" + "\n" * 1_500_000 + "b"):
        ids = rank_bpe.text_ids(library, text)
        assert library.decode_bytes(ids).decode() == text
    assert rank_bpe.text_ids(library, "a" + "\n" * 1_500_000 + "b")[-2:] == library.encode_ordinary("\nb")[-2:]


def test_white_space_is_unicodes():
    assert {c for c in map(chr, range(0x11000)) if rank_bpe.LEAD.fullmatch(c)} == {c for c in map(chr, range(0x11000)) if c.isspace()} - set("\x1c\x1d\x1e\x1f")


def brute_alignment(documents):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    alphabet = {c: i for i, c in enumerate(byte_characters())}
    with open(A, encoding="utf-8") as file:
        spelt = {i: bytes(map(alphabet.get, t)) for t, i in json.load(file)["model"]["vocab"].items()}
    rows, counts = [], Counter()

    def ends(data):
        at, out = 0, {}
        for place, x in enumerate(data):
            at += len(x)
            out[at] = place
        return out

    for i, t, _ in documents:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        pieces = map(two.id_to_piece, b)
        x, y = [spelt[k] for k in a], [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, pieces, strict=True)]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            rows.append((i, [], [], [], ""))
            continue
        ends_a, ends_b = ends(x), ends(y)
        shown, links, last = [], [], (0, 0)
        for end in sorted(ends_a.keys() & ends_b.keys()):
            p, q = ends_a[end] + 1, ends_b[end] + 1
            shown.append(",".join(map(str, a[last[0] : p])) + "|" + ",".join(map(str, b[last[1] : q])))
            links.append((a[p - 1], b[q - 1]))
            last = p, q
        counts.update(links)
        rows.append((i, a, b, links, sha(";".join(shown).encode())))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(i, len(a), len(b), len(links), len(links), digest, sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)) for i, a, b, links, digest in rows]


def test_alignment(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 5000)
    same(alignment.token_alignment(frame(spark, documents), A, B).drop("th"), brute_alignment(documents))


def test_alignment_query(spark, real):
    got = QUERIES["op12_token_alignment"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    same(got, brute_alignment(real))


def test_linked_pairs_stay_within_the_bound_of_the_vocabularies(spark, documents):
    pairs = alignment.linked_pairs(frame(spark, documents), A, B).collect()
    both = alignment.tokenizers(A, B)
    assert 0 < len(pairs) <= alignment.pair_bound(A, B) == 324_297
    assert all(both.bytes_a[r.a].endswith(both.bytes_b[r.b]) or both.bytes_b[r.b].endswith(both.bytes_a[r.a]) for r in pairs)
    few = spark.createDataFrame([(1, 2, 3, True), (2, 2, 1, False)], "a int, b int, n long, best boolean")
    with pytest.raises(ValueError, match="vocabularies"):
        alignment.scored(alignment.aligned(frame(spark, documents[:3]), A, B), few, 1)


def brute_audit(documents, labels):
    least, marks = {}, defaultdict(lambda: [0, 0])
    for i, t, _ in documents:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], quality == 1), max(marks[i][1], toxic == 1)]
    parts = defaultdict(list)
    for i, t, s in documents:
        t = t or ""
        w = SPACE.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[s or ""].append(({f for f in fails if fails[f]}, *(marks[i] if i is not None else (0, 0))))
    for part, rows in parts.items():
        out, total = [], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:k])]
                total[f] += len(here)
                out.append((f, "".join(order), k + 1, sum(not r[0] & set(order[: k + 1]) for r in rows), len(here), sum(f in r[0] for r in rows) - len(here),
                            sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
        yield from ((part, *row[1:], total[row[0]]) for row in out)


LABELS = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (7, 1, 1), (8, None, 1), (9, 1, 0), (10, 1, None), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_filter_audit(spark, cases):
    labels = spark.createDataFrame([(*r, "x", 1) for r in LABELS], "doc_id long, quality int, toxic int, part string, n int")
    same(filter_audit.filter_audit(frame(spark, cases), labels), brute_audit(cases, LABELS))


def test_filter_audit_query_is_its_sql(spark):
    got = QUERIES["op13_filter_audit"](spark, FOLDER)
    sql = SQL["op13_filter_audit"].replace("documents", f"'{FOLDER}/documents.parquet'").replace("FROM labels", f"FROM '{FOLDER}/labels.parquet'")
    want = duckdb.sql(sql)
    assert want.columns == got.columns
    same(got, want.fetchall())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert rank_bpe.decoded(rank_bpe.encoded(none, RANKS, PATTERN), RANKS, PATTERN).collect() == []
    assert alignment.token_alignment(none, A, B).collect() == []
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
