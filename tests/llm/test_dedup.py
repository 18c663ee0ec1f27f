"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from copse.llm import exact_dedup, simhash


def lower_az(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_heavy_digests(spark):
    """Frequent digests are found whatever partition they lie in, and only few rows are broadcast."""
    rng = random.Random(1)
    rows = [(i, f"heavy {i % 3}") for i in range(900)] + [(i, f"rare {rng.random()}") for i in range(900, 1500)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    table = exact_dedup.digest_table(docs)
    heavy = exact_dedup.heavy_hitters(table, 16).collect()
    assert len(heavy) == 3 and all(r["n"] == 300 for r in heavy)
    got = {r["doc_id"]: r for r in exact_dedup.decide(table, 16).collect()}
    assert {r["keep_id"] for i, r in got.items() if i < 900} == {897, 898, 899}
    assert sum(r["kept"] for r in got.values()) == 603


def test_merge_counts():
    rng = random.Random(2)
    stream = [rng.choice("aaaaabbbcdefghij") for _ in range(5000)]
    counts: dict = {}
    for at in range(0, len(stream), 50):
        for x in stream[at : at + 50]:
            counts[x] = counts.get(x, 0) + 1
        counts = exact_dedup.merge_counts(counts, 4)
    assert len(counts) <= 4
    for x in set(stream):
        true = stream.count(x)
        assert true - 5000 / 5 <= counts.get(x, 0) <= true


def test_dedup_keeps_one_row_of_each_text(spark, hard):
    wide = hard.withColumn("digest", F.lit("mine")).withColumn("group_size", F.lit(1))
    got = exact_dedup.dedup(wide)
    assert got.columns == wide.columns
    best: dict = {}
    for r in hard.collect():
        k = lower_az(r["text"])
        best[k] = max(best.get(k, -1), -1 if r["doc_id"] is None else r["doc_id"])
    kept = sorted((lower_az(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect())
    assert kept == sorted(best.items())


def test_op1_spares_the_executors_heap(spark, folder, monkeypatch):
    """No text travels back from Python, and the hex digits avoid lower(), whose first call title-cases all of Unicode (about 3 GB of garbage)."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = exact_dedup.op1_exact_dedup(spark, folder)
    assert "lower(" not in plan(got)
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text_sha256"]) for r in got.collect()) == sorted((r["doc_id"], hashlib.sha256(lower_az(r["text"]).encode()).hexdigest()) for r in texts)
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name: df)
    returned = re.findall(r"MapInArrow .*\[([^]]*)\]", plan(exact_dedup.digest_table(spark.read.parquet(f"{folder}/documents.parquet"))))
    assert [re.findall(r"(\w+)#", x) for x in returned] == [["doc_id", "digest"]]


def brute_fingerprint(text: str | None, k: int = 4) -> int:
    w = re.findall(r"[^\x20\x09-\x0d]+", lower_az(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], radius: int = 4) -> list[int]:
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark, folder):
    rows = sorted({(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}, key=lambda r: (r[0], r[1] or ""))
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    want = {(rows[i][0], format(fps[i], "016x"), least[roots[i]]) for i in range(len(rows))}
    assert {tuple(r) for r in simhash.op8_simhash(spark, folder).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_bucket_links_are_the_components(seed):
    """Small and large buckets, scattered and clustered fingerprints, chains of near ones."""
    rng = np.random.default_rng(seed)
    sizes = [5, 1, 300, 2, 40, 2500][: 5 + seed % 2]
    fps = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    for i in range(1, len(fps)):
        if rng.random() < 0.5:
            v = int(fps[i - 1])
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(b)
            fps[i] = v
    a, b = (fps[x] for x in simhash.links(fps[:, None], np.array(sizes)))
    at, want = 0, []
    for n in sizes:
        part = fps[at : at + n]
        near = np.bitwise_count(part[:, None] ^ part[None]) <= 4
        label = np.arange(n)
        while True:
            new = np.where(near, label[None], n).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        want += [(int(part[label[i]]), int(part[i])) for i in range(n) if label[i] != i]
        at += n
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want)


def test_hot_bucket_is_cut_into_tiles(spark, monkeypatch):
    """More nodes under one key than a task compares: pairs of tiles find every link."""
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) & (2**64 - 1) for _ in range(400)})
    prints = spark.createDataFrame([(i, simhash.signed(f & (2**64 - 1))) for i, f in enumerate(fps)], "doc_id long, f0 long").persist()
    roots = brute_components([f & (2**64 - 1) for f in fps])
    assert {(r["doc_id"], r["component_id"]) for r in simhash.assign(prints).collect()} == set(enumerate(roots))


@pytest.mark.parametrize("words", [1, 3, 8])
def test_distances_by_brute_force(words):
    """Counters of every width, near and far lanes, lanes that count for nothing, with one pivot and side by side."""
    rng = np.random.default_rng(words)
    fps = rng.integers(0, 2**64, (700, words), dtype=np.uint64)
    for i in range(1, 700, 2):
        fps[i] = fps[0]
        for b in rng.integers(0, 64 * words, rng.integers(0, 120)):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    far = np.bitwise_count(fps[0] ^ fps).sum(1)
    p = simhash.planes(fps)[:, : -(-700 // 64)]
    ok = np.zeros(p.shape[1] * 64, np.uint8)
    ok[:700] = rng.random(700) < 0.8
    bits = np.unpackbits(fps[:1].astype("<u8").view(np.uint8), bitorder="little")
    one = np.where(bits == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None].repeat(p.shape[1], 1)
    for radius in (0, 1, 4, 7, 8, 15, 16, 31, 64, 92):
        got = simhash.lanes_of(simhash.within(simhash.differences(one, p), simhash.packed(ok), 64 * words, radius))
        assert got.tolist() == np.flatnonzero((far <= radius) & (ok[:700] == 1)).tolist()


@pytest.mark.parametrize("sizes", [[3000], [2] * 1500, [2049, 900, 51]])
def test_wide_links_are_the_components(sizes):
    """Small and large buckets of wide prints: chains, copies at all distances about the radius, unlike ones."""
    rng, radius = np.random.default_rng(len(sizes)), simhash.radius_of(0.8)
    fps = rng.integers(0, 2**64, (sum(sizes), simhash.WORDS), dtype=np.uint64)
    for i in range(1, len(fps)):
        if rng.random() < 0.6:
            fps[i] = fps[i - 1]
            for b in rng.permutation(64 * simhash.WORDS)[: rng.integers(radius - 60, radius + 30)]:
                fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    early = simhash.early_radius(radius)
    roots, members = simhash.links(fps, np.array(sizes), radius, early)
    got = np.arange(len(fps))
    got[members] = roots
    at = 0
    for n in sizes:
        far = [np.bitwise_count(fps[at + i] ^ fps[at : at + n]) for i in range(n)]
        near = np.stack([(d.sum(1) <= radius) & (d[:, :2].sum(1) <= early) for d in far])
        label = np.arange(n)
        while True:
            new = np.where(near, label[None], n).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        assert (got[at : at + n] - at == label).all()
        at += n


def test_near_copies_go_and_others_stay(spark):
    """Single words changed in texts of a few hundred words; texts of the same vocabulary that only share words stay."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.randint(250, 500))] for _ in range(120)]
    copies = []
    for t in texts[:60]:
        c = list(t)
        c[rng.randrange(len(c))] = "changed"
        copies.append(c)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    assert set(range(120)) <= kept
    assert len(kept - set(range(120))) <= 6


def wide_components(prints: list[list[int]], keys: list[list[tuple[int, int]]], radius: int) -> list[int]:
    """The rule by all pairs: a key in common, and the radius, also in the first bits."""
    label, early = list(range(len(prints))), simhash.early_radius(radius)
    pairs = [
        (i, j)
        for i, a in enumerate(prints)
        for j, b in enumerate(prints[:i])
        if sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= radius
        and sum((x ^ y).bit_count() for x, y in zip(a[:2], b[:2], strict=True)) <= early
        and any(all(not (a[w] ^ b[w]) & m for w, m in key) for key in keys)
    ]
    while True:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def chains(rng: random.Random) -> list[str]:
    """Chains of edited copies, some of which share words of their prints, short texts, repeated and empty ones."""
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts = ["", "", "one", "one two three four five six", "one two three four five seven"]
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(60, 900))]
        for _ in range(rng.randint(2, 8)):
            texts.append(" ".join(t))
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
    return texts


def test_dedup_by_brute_force(spark):
    """By default parameters, prints with equal parts included."""
    texts = chains(random.Random(12))
    prints = [simhash.fingerprint(t.encode(), 5, simhash.WORDS) for t in texts]
    assert sum(a != b and any(x == y for x, y in zip(a, b, strict=True)) for i, a in enumerate(prints) for b in prints[:i]) > 5
    n = len({tuple(p) for p in prints})
    roots = wide_components(prints, simhash.slices(n, 0.8), simhash.radius_of(0.8))
    assert len(set(roots)) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.dedup(docs).collect()} == set(roots)
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0"))
    assert sorted(r["doc_id"] for r in simhash.dedup(twice).collect()) == sorted(set(roots))


@pytest.mark.parametrize("n", [1000, 10**7, 10**10])
def test_recall_and_precision_by_similarity(n):
    """Texts of 300 words with words changed to a wanted Jaccard similarity: keys and radius find those of 0.8, and hardly any of 0.6."""
    rng, radius, keys = random.Random(n), simhash.radius_of(0.8), simhash.slices(n, 0.8)
    found: dict[int, list[bool]] = {8: [], 6: []}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for _ in range(150):
        words = [str(rng.random()) for _ in range(rng.randint(100, 500))]
        copy = list(words)
        while True:
            copy[rng.randrange(len(copy))] = str(rng.random())
            a, b = shingles(words), shingles(copy)
            j = len(a & b) / len(a | b)
            if j < 0.55:
                break
            if 0.8 <= j < 0.83 or 0.58 <= j < 0.61:
                x, y = (simhash.fingerprint(" ".join(w).encode(), 5, simhash.WORDS) for w in (words, copy))
                near = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= radius
                found[8 if j >= 0.8 else 6].append(near and any(all(not (x[w] ^ y[w]) & m for w, m in key) for key in keys))
    assert sum(found[8]) >= 0.9 * len(found[8]) > 50
    assert sum(found[6]) <= 0.05 * len(found[6])


def test_short_texts_spread_over_all_bits():
    """Unlike texts of two or four shingles differ in half of the bits, as long ones do."""
    rng = random.Random(2)
    for n in (6, 8, 300):
        prints = [simhash.fingerprint(" ".join(str(rng.random()) for _ in range(n)).encode(), 5, simhash.WORDS) for _ in range(200)]
        apart = [(x ^ y).bit_count() for a, b in zip(prints, prints[1:], strict=False) for x, y in zip(a, b, strict=True)]
        assert 30.5 < sum(apart) / len(apart) < 33.5


def test_key_masks_leave_no_pair_out():
    for n in (10, 10**9, 10**12):
        masks = simhash.key_masks(n)
        rng = random.Random(n)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & flips for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200), (301, 200)], "a long, b long")
    got = {(r["v"], r["root"]) for r in simhash.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 101)} | {(300, 200), (301, 200)}


def test_near_dedup_keeps_one_of_each_component(spark, hard):
    wide = hard.withColumn("f0", F.lit("mine"))
    got = simhash.dedup(wide, 4, None)
    assert got.columns == wide.columns
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    assert got.count() == len(set(roots))
    unique = hard.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"]) for r in unique.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in simhash.dedup(unique, 4, None).collect()) == sorted({rows[r][0] for r in roots})
