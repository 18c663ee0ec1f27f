"""Small documents that hold every hard case."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("copse.llm.registry")

WORDS = "the of and to in that it was for on are as with his they be at one have this from word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def hard_texts() -> list[str | None]:
    """Null, empty, blank, repeated, equal but for case, very long, odd characters, control strings."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    near = base[3].replace("the", "teh", 1) if "the" in base[3] else base[3] + " end"
    return [None, "", " ", "\n\t ", *base, base[0], base[0].upper(), base[0].lower(), near, prose(rng, 30_000), "x" * 50_000, "ÉÀ éà ß İı Σς", "日本語 テキスト 🎉", "a\x00b\x1cc\x85d e", "<|endoftext|> <|startoftext|>", "1 2 3", "one\ntwo\none\n\none", "a b c d e " * 30]


@pytest.fixture(scope="session")
def hard(spark):
    """doc_id, text, lang, source, n_chars; some doc_ids and whole rows repeat, some are null."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", None)[i % 3], len(t or "")) for i, t in enumerate(hard_texts())]
    rows += [rows[5], rows[5], rows[1], (rows[6][0], "another text under a doc_id that is taken", "en", "src1", 3), (None, "no id at all", "en", "src0", 1), (None, rows[7][1], "en", "src0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).persist()


@pytest.fixture(scope="session")
def folder(hard, tmp_path_factory):
    """The hard documents as an sf_dir."""
    path = tmp_path_factory.mktemp("hard")
    hard.filter("doc_id IS NOT NULL").write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="session")
def nothing(spark, hard, tmp_path_factory):
    """An sf_dir of empty tables."""
    path = tmp_path_factory.mktemp("nothing")
    hard.limit(0).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)
