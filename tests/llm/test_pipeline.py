"""The pipeline, stage by stage against brute force, and on hard documents."""

from __future__ import annotations

import random
import re

import corpus_pipeline

from copse.llm.common import materialise


def lower_az(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "test-stage")
        after = docs.collect()
        assert docs.columns == columns
        ids = {r["doc_id"] for r in after}
        if name == "language ID":
            assert all(r["doc_id"] in ids for r in before if r["text"] and sum(c.isalpha() for c in r["text"]) > 100)
        if name == "exact dedup":
            best: dict = {}
            for r in before:
                best[lower_az(r["text"])] = max(r["doc_id"], best.get(lower_az(r["text"]), -1))
            assert ids == set(best.values())
        if name == "SimHash near-dedup":
            assert ids <= {r["doc_id"] for r in before}
        if name == "personal data":
            assert len(after) == len(before) and not any("@mail" in (r["text"] or "") for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in before}


def shingles(text: str) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0d]+", lower_az(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_of_the_driver(spark, sf_dir):
    """Of what exact dedup keeps: at least nine in ten pairs of similarity 0.8 lose one, and whatever has no near copy stays."""
    docs = corpus_pipeline.exact_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    before = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    after = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    similar = {(a, b): len(x & y) / len(x | y) for a, x in before.items() for b, y in before.items() if a < b and x & y}
    near = [p for p, j in similar.items() if j >= 0.8]
    lone = set(before) - {i for p, j in similar.items() if j >= 0.5 for i in p}
    assert lone <= after and len(lone) > 100
    assert sum(a in after and b in after for a, b in near) <= 0.1 * len(near)


def test_made_near_copies(spark):
    """Copies with a few words changed go, by the stage's own settings, and one of each group stays."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    rows, groups = [], []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        members = []
        for _ in range(1 + g % 4):
            copy = list(base)
            for _ in range(len(copy) // 120):  # each changed word changes five shingles
                copy[rng.randrange(len(copy))] = "changed"
            members.append(len(rows))
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
        groups.append(members)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert all(kept & set(g) for g in groups)
    assert len(kept) <= len(groups) + 4


def test_hard_documents(spark, folder, nothing):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, nothing).count() == 0
