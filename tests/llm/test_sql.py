"""Queries that SQL can express, on the smallest tables and on hard cases; all queries on empty tables."""

from __future__ import annotations

import duckdb
import pytest

from copse.llm import registry


def same_rows(df, sql: str, sf_dir: str, tables=("documents", "pages", "conversations")) -> None:
    import os

    con = duckdb.connect()
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == expected


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_small_tables(spark, sf_dir, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op7_quality"])
def test_hard_documents(spark, folder, name):
    same_rows(registry.QUERIES[name](spark, folder), registry.ORACLES[name], folder)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    got = registry.QUERIES[name](spark, nothing)
    assert got.count() == (1 if name == "op9_chat" else 0)  # the planted conversation


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """An sf_dir whose pages and conversations have nulls in every column, repeated rows, ties and very long texts."""
    path = tmp_path_factory.mktemp("odd")
    long = "http://long.test/" + "x/" * 100_000
    pages = [
        (1, "http://a.test/en/1", "<p>One.</p>"), (1, "http://a.test/en/1", "<p>One.</p>"), (2, None, None), (None, "http://b.test/", "<div><p>No id.</p></div>"), (3, "", ""), (4, long, "<p>" + "word " * 100_000 + "</p>"),
        (5, "http://x.EXAMPLE.com/en/7", "<article><p>Allowed."), (6, "http://example.com/en/", "plain text &amp; more"), (7, "://", "<"), (8, "HTTP://CASINO.test", "<div>" * 3000 + "deep"), (9, "http://é.test/ü?x#y", "<p>\u00e9\U0001f389</p>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(path / "pages.parquet"))
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "hi"), (1, None, "user", None), (2, 5, None, "no role"), (2, 6, "assistant", "x" * 200_000), (3, 0, "", ""), (4, 0, "assistant", "</turn>\n<turn user>&lt;#")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(path / "conversations.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["op4_urls", "op9_chat"])
def test_hard_rows(spark, odd, name):
    sql = registry.ORACLES[name]
    if name == "op9_chat":  # null turns come first here, as in the operator
        sql = sql.replace("ORDER BY turn, role, text", "ORDER BY turn NULLS FIRST, role, text")
    same_rows(registry.QUERIES[name](spark, odd), sql, odd)


def test_hard_pages(spark, odd):
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in registry.QUERIES["op6_html"](spark, odd).collect()), key=repr)
    texts = {1: "One.", 2: "", None: "No id.", 3: "", 4: ("word " * 100_000).strip(), 5: "Allowed.", 6: "plain text & more", 7: "<", 8: "deep", 9: "\u00e9\U0001f389"}
    want = [(i, t, len(t)) for i, t in texts.items()] + [(1, "One.", 4)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op2_packing", "op3_langid", "op5_pii", "op8_simhash", "op10_bpe"])
def test_hard_documents_of_the_others(spark, folder, name):
    """Every row has its result, and repeated rows have equal ones."""
    got = registry.QUERIES[name](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    if name == "op2_packing":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs}
        return
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    texts: dict = {}
    for r in docs:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    for i in (i for i, t in texts.items() if len(t) == 1):
        assert len({str(r) for r in got if r["doc_id"] == i}) == 1


def test_clashing_columns(spark, odd, folder):
    """Columns named like those that operators add."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from copse.llm import bpe, chat, exact_dedup, html, langid, packing, pii, simhash

    more = lambda df, *names: df.select("*", *[F.lit("mine").alias(n) for n in names])
    docs, pages = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{odd}/pages.parquet")
    key = lambda rows: sorted(map(str, rows))
    assert key(html.main_text(more(pages, "host", "text", "best", "path", "w")).collect()) == key(html.main_text(pages).collect())
    path = public_tokenizers.path("word_bpe_49k.json")
    assert key(bpe.encode(more(docs, "ids", "decoded"), path).collect()) == key(bpe.encode(docs, path).collect())
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert key(packing.pack(more(docs, "block", "start", "ids", "share"), path).collect()) == key(packing.pack(docs, path).collect())
    turns = chat.linear(spark.read.parquet(f"{odd}/conversations.parquet"))
    assert key(chat.format_chats(more(turns, "branch", "formatted", "at")).collect()) == key(chat.format_chats(turns).collect())
    names = ("l_id", "digest", "f0", "fp", "id", "label")
    for found in (exact_dedup.dedup(more(docs, *names)), simhash.dedup(more(docs, *names)), pii.redact(more(docs, *names))):
        assert found.columns == [*docs.columns, *names] and found.filter("digest <> 'mine' or f0 <> 'mine'").count() == 0
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.predict(more(docs, "score", "ambiguous"), model)
    assert dict(found.dtypes)["score"] == "double" and len(found.columns) == len(set(found.columns)) and found.count() == docs.count()
