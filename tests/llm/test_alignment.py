"""Alignment held against the libraries and plain sums."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import alignment, queries
from tessera.llm.bpe import Codec, packed_ids

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(name) for name in queries.ALIGNED)
LETTERS = ["a", "b", " ", "  ", "▁", "é", "中", "\n", "\t", "🙂", " the", "ing", "\x00", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "ﬁ", "　", "\xa0", "'s", "12"]


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, texts):
    """n_a, n_b, groups' text and links of each text."""
    tokenizer, model = libraries
    codec, pieces = alignment._loaded(A, B)
    out = []
    for text in texts:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        if b"".join(pieces.tokens[i] for i in b) != (" " + (text or "")).encode() or b"".join(codec.tokens[i] for i in a) != (" " + (text or "")).encode():
            out.append((0, 0, "", []))
            continue
        ends = [np.cumsum([len(side.tokens[i]) for i in ids]).tolist() for side, ids in ((codec, a), (pieces, b))]
        groups, links, low = [], [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            part = [[i for i, e in zip(ids, at, strict=True) if low < e <= end] for ids, at in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links.append((part[0][-1], part[1][-1]))
            low = end
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def strengths(found):
    counts = Counter(link for *_, links in found for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashed(t)) for n_a, n_b, t, links in found]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(LETTERS), max_size=30).map("".join), min_size=1, max_size=4))
def test_slices_are_what_the_libraries_give(libraries, texts):
    codec, pieces = alignment._loaded(A, B)
    got = alignment._aligned(texts, codec, pieces, alignment.Digits(len(codec.tokens)))
    want = brute(libraries, texts)
    assert list(zip(got["n_a"], got["n_b"], got["n_groups"], got["groups"], strict=True)) == [(a, b, len(links), t) for a, b, t, links in want]
    assert got["links"] == [np.array(links, "<u4").tobytes() for *_, links in want]


def test_texts_encoded_whole(libraries, monkeypatch):
    codec, pieces = alignment._loaded(A, B)
    monkeypatch.setattr(pieces, "apart", False)
    got = alignment._aligned(["the  cat\n", "x▁y"], codec, pieces, alignment.Digits(len(codec.tokens)))
    assert got["groups"] == [x[2] for x in brute(libraries, ["the  cat\n", "x▁y"])]


def names(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_query_against_libraries(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, strengths(brute(libraries, texts.values())), strict=True))
    assert {r.doc_id: names(r) for r in queries.op11_token_alignment(spark, SF).collect()} == want


def test_odd_rows(spark, libraries, tmp_path):
    texts = ["", None, "   \n\t", "a", "a b c", "a b c", "é ß 中文 🙂", "x" * 70_000, "word " * 5000, "▁a", "<s>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "a"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.selectExpr("*", "1 as batch", "2 as pair", "'x' as groups", "3 as links").write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    want = sorted(zip([r[0] for r in rows], strengths(brute(libraries, [r[1] for r in rows])), strict=True), key=repr)
    assert sorted(((r.doc_id, names(r)) for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()), key=repr) == want
    assert queries.op11_token_alignment(spark, str(tmp_path / "none")).collect() == []


def test_pair_counts(spark):
    pairs = spark.createDataFrame([(1 << 32 | 5, 2), (1 << 32 | 5, 1), (2 << 32 | 5, 3), (3 << 32 | 5, 1), (3 << 32 | 6, 1)], "pair long, n long")
    got = {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r["count"], r.best) for r in alignment.pair_counts(pairs).collect()}
    assert got == {(1, 5): (3, True), (2, 5): (3, True), (3, 5): (1, False), (3, 6): (1, True)}


def test_packed_ids_and_first_pairs():
    from tessera.llm import bpe

    codec = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"\xff\x00": 259})
    assert codec.two[ord("a") << 8 | ord("b")] == 256 and codec.two[0xFF00] == 259 and codec.two[0] == len(codec.tokens)
    assert codec.merge(b"xabcbc\xff\x00a") == [ord("x"), 258, 257, 259, ord("a")] and codec.merge(b"") == []
    assert bpe.packed_ids([1, 2**32 - 1]) == b"\x01\0\0\0\xff\xff\xff\xff" and bpe.packed_ids([]) == b""


def test_pieces_are_merged_many_at_once(monkeypatch):
    """One step a row gives what merging each piece alone gives: ties, repeats, whole tokens out of reach of merges, long pieces."""
    codec = alignment.byte_codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"aeinorst") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))) for _ in range(1000)] + [b"a" * n for n in range(1, 200)] * 2 + [b"ab" * 32] * 20
    want = [packed_ids(codec.merge(p)) for p in pieces]
    small = Codec({bytes([b]): b for b in range(256)} | {b"aaa": 300, b"ab": 301, b"abab": 302, b"bc": 299, b"abc": 310})
    few = [b"aaa", b"aaaa", b"abcab", b"ababab", b"abca"] * 20
    assert small.merge_all(few) == [packed_ids(small.merge(p)) for p in few]
    alone, merge = [], Codec.merge
    monkeypatch.setattr(Codec, "merge", lambda self, piece: (alone.append(piece), merge(self, piece))[1])
    assert codec.merge_all(pieces) == want
    assert len(alone) < len(pieces) / 5
    assert codec.merge_all([]) == []
    assert Codec({b"a": 0, b"b": 1, b"ab": 2}).merge_all([b"ab", b"ba"] * 20) == [packed_ids([2]), packed_ids([1, 0])] * 20
