"""Packing and BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from copse.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd() -> list[str]:
    rng = random.Random(1)
    marks = "aaabcdefghijklmnopqrstuvwxyz  '.,!?<|>0123456789éßÉΣσİıŒ中文字日本🎉́  \t\n\x1c\x85'"
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 900, "ab" * 700 + "c", "don't we'll 'S", "<|endoftext|>x <|startoftext|>", "  two  blanks \n and\n\nlines ", ""]


def test_words_encode_as_the_library_does(odd):
    model, library = bpe.word_bpe(WORD), Tokenizer.from_file(WORD)
    for text, ids in zip(odd, model.encode_all(odd), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_proposals_are_verified_not_trusted():
    model = bpe.WordBPE(WORD)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    exact = [np.array(model.merge([*w[:-1], w[-1] + model.end]), model.kind).tobytes() for w in words]
    model.exact_merges = 0
    assert model.learn(words) == exact
    assert 0 < model.exact_merges < len(words)


def test_merging_side_by_side(monkeypatch):
    """Words of all lengths and bytes, repeated letters, symbols that no vocabulary has, in portions of any size."""
    model, rng = bpe.word_bpe(WORD), random.Random(3)
    words = ["".join(rng.choice(marks) for _ in range(rng.randint(1, n))) for marks, n in (("etaoinshr", 14), ("aab", 60), (model.alphabet, 8), ("th", 399), ("x", 30)) for _ in range(300)]
    words += ["Ŀſ", "aĿb", "a"]  # the first has characters that stand for no byte
    exact = [model.merge([*w[:-1], w[-1] + model.end]) for w in words]
    assert [m.tolist() for m in model.merge_many(words)] == exact
    packed = [np.array(x, model.kind).tobytes() for x in exact[:-3]]
    assert model.learn(words[:-3]) == packed
    monkeypatch.setattr(bpe, "MERGED", 100)
    assert model.learn(words[:-3]) == packed


def test_new_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 60)
    model, library = bpe.WordBPE(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    assert model.encode_all(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_query(spark, folder):
    library = Tokenizer.from_file(WORD)
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op10_bpe(spark, folder).collect())) == sorted(want)
    full = {r["doc_id"]: r for r in bpe.encode(spark.read.parquet(f"{folder}/documents.parquet"), WORD).collect()}
    assert full[0]["ids"] == [] and full[0]["decoded"] == ""


def test_bytes_encode_as_the_library_does(odd):
    model, library = packing.byte_bpe(BYTE), Tokenizer.from_file(BYTE)
    for text in odd:
        assert np.frombuffer(model.encode(text), model.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def check_pieces(pieces: list, docs: list, length: int = 1024) -> None:
    """Each id of each document lies in one piece, sequences have no gap, and only tails are short, by powers of two."""
    library = Tokenizer.from_file(BYTE)
    want = sorted((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in docs)
    sequences = defaultdict(list)
    of = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        of[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"], p["ids_crc32"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at == length or at & (at - 1) == 0
    texts = defaultdict(list)
    for d, ids in want:
        texts[d].append(ids)
    assert set(of) == set(texts)
    for d, versions in texts.items():
        wanted = sorted(len(v) for v in versions)
        assert sum(n for _, n, _, _ in of[d]) == sum(wanted)
        if len(versions) == 1:
            at = 0
            for start, n, total, crc in sorted(of[d]):
                assert start == at and total == len(versions[0])
                assert crc == zlib.crc32(np.array(versions[0][start : start + n], "<u4").tobytes())
                at += n


def test_packing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_pieces(packing.op2_packing(spark, folder).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_over_blocks_and_segments(spark, sf_dir, monkeypatch):
    """Many small blocks, long documents in segments: windows still hold the corpus' proportions."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 40_000)
    monkeypatch.setattr(packing, "SEGMENT", 700)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the segment size is used by the workers
    rows = docs.select("doc_id", "source", "text")
    pieces = packing.pack(rows, BYTE, with_ids=True).collect()
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])
    for p in pieces[:200]:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
    assert len({p["sequence_id"] >> 24 for p in pieces}) > 3


def test_serve_follows_targets_and_carries_deficits():
    share = np.array([0.5, 0.3, 0.2])
    taken = packing.serve(np.array([50_000, 30_000, 20_000]), share, np.zeros(3), 1000)
    assert (taken.sum(1) == 1000).all() and np.abs(np.cumsum(taken, 0) - np.outer(np.arange(1, 101) * 1000, share)).max() <= 1
    assert taken.sum(0).tolist() == [50_000, 30_000, 20_000]
    # a queue that is owed tokens is served first, until it is even
    owed = packing.serve(np.array([50_000, 30_000, 20_000]), share, np.array([-600.0, 0.0, 600.0]), 1000)
    assert owed[0, 2] == 800 and owed[0, 0] == 0 and owed.sum(0).tolist() == [50_000, 30_000, 20_000]
    # empty queues and unknown targets
    assert packing.serve(np.array([0, 5]), np.array([1.0, 0.0]), np.zeros(2), 1000).tolist() == [[0, 5]]
    assert packing.serve(np.array([3, 5]), np.zeros(2), np.zeros(2), 4).sum(0).tolist() == [3, 5]
    assert packing.serve(np.zeros(2, int), np.ones(2), np.zeros(2), 4).shape == (0, 2)


def test_given_targets(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "word " * 400) for i in range(400)], "doc_id long, source string, text string")
    pieces = packing.pack(docs, BYTE, targets={"a": 3.0, "b": 1.0}).collect()
    first = [p for p in pieces if p["sequence_id"] < 64]
    share = sum(p["length"] for p in first if p["doc_id"] % 2) / sum(p["length"] for p in first)
    assert abs(share - 0.75) < 0.01
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_running_sums(spark, monkeypatch):
    """Over chunks of blocks, with a null source and blocks that some sources lack."""
    monkeypatch.setattr(packing, "CHUNK", 4)
    rng = random.Random(4)
    rows = [(b, s, float(rng.randint(1, 9))) for b in range(30) for s in ("a", "b", None) if rng.random() < 0.7]
    table = spark.createDataFrame(rows, "block long, source string, n double").repartition(5)
    got = sorted(map(str, packing.running(table, "n", "served", "source").collect()))
    want = [(b, s, n, float(sum(m for c, t, m in rows if t == s and c < b))) for b, s, n in rows]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, "block long, source string, n double, served double").collect())
