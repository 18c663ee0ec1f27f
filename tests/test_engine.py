"""Layouts, streaming, and every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from copse import queries
from copse.functions.interval import Label
from copse.sources import layout, relational
from copse.sources.schema import NODE
from copse.sources.xml import shred
from copse.streaming.shredding import shred_stream, store_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_query(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert {r["tag"]: r["n"] for r in queries.shred_pages(spark, sf_dir).collect()}["page"] == pages


def test_every_row_is_a_node(spark, sf_dir, tmp_path):
    """Rows with one line number, or one turn, are nodes each."""
    flags = {r["l_returnflag"]: r["count"] for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()}
    tags = {r["tag"]: r["n"] for r in queries.tag_histogram(spark, sf_dir).collect()}
    assert tags["line"] == sum(flags.values())
    assert {f: tags[f"flag={f}"] for f in flags} == flags
    turns = [(1, 0, "user"), (1, 0, "user"), (1, 0, "assistant"), (1, 1, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["start"], r["tag"]) for r in queries.chat_tree(spark, str(tmp_path)).filter("level = 3").collect())
    assert [t for _, t in got] == ["assistant", "user", "user", ""]


@pytest.mark.parametrize("tree", ["sales", "chat", "geo"])
def test_large_documents_are_split(spark, sf_dir, tree, monkeypatch):
    """The labels are those of one task a document."""
    rows = lambda: sorted(map(str, queries.TREES[tree](spark, sf_dir).select(sorted(NODE.names)).collect()))
    whole = rows()
    monkeypatch.setattr(relational, "LARGE", 0)
    assert rows() == whole and len(whole) > 0


def test_orders_without_a_customer(spark, sf_dir, tmp_path, monkeypatch):
    """Documents whose root is missing get the same labels either way; no documents give none."""
    for t, where in (("customer", "c_custkey % 2 = 0"), ("orders", "true"), ("lineitem", "true")):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").filter(where).write.parquet(str(tmp_path / f"{t}.parquet"))
    labels = lambda tree: sorted(map(str, tree.select("doc_id", "start", "end", "level", "tag", "parent_start", "ancestors").collect()))
    whole = labels(queries.sales_tree(spark, str(tmp_path)))
    monkeypatch.setattr(relational, "LARGE", 0)
    assert labels(queries.sales_tree(spark, str(tmp_path))) == whole
    empty = spark.createDataFrame([], "doc_id long, k long, leaf int, tag string, kind string")
    assert relational.label(empty, ["k"], "leaf", large=True).count() == 0


def test_relations_of_all_levels(spark):
    """Counted without pairs as by comparing all pairs."""
    pages = ["<a><b><c>x</c><c/></b><b/></a>", "<a/>", "<a><a><a><a>y</a></a></a><b k='1'/></a>"]
    tree = shred(spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string"))
    rows = [(r["doc_id"], r["start"], r["end"], r["level"]) for r in tree.collect()]
    want: dict = {}
    for d, s1, e1, l1 in rows:
        for c, s2, e2, l2 in rows:
            if c == d:
                inside, outside = s1 < s2 and e1 > e2, s2 < s1 and e2 > e1
                code = (9 if l2 == l1 + 1 else 1) if inside else (10 if l1 == l2 + 1 else 2) if outside else 4 if s1 == s2 else 0
                want[code] = want.get(code, 0) + 1
    assert set(want) == {0, 1, 2, 4, 9, 10}
    assert {r["code"]: r["n"] for r in queries.relation_counts(tree).collect()} == want
    assert queries.relation_counts(tree.limit(0)).count() == 0


def test_shredded_nodes_by_brute_force(spark, tmp_path):
    """Labels, kinds and parents of pages, from walking the same markup by hand."""
    import html.parser

    pages = {1: '<div id="x" class="y"><p>one</p><p>two <b>three</b></p></div>', 2: "<ul><li>a</li><li>b</li></ul>"}
    spark.createDataFrame([(i, f"http://a.fr/{i}", h) for i, h in pages.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {i: [r for r in queries.shred_nodes(spark, str(tmp_path)).collect() if r["doc_id"] == i] for i in pages}
    for i, rows in got.items():
        names, texts, attributes = [], [], []
        walker = html.parser.HTMLParser()
        walker.handle_starttag = lambda tag, a: (names.append(tag), attributes.extend(a))
        walker.handle_data = lambda d: texts.append(d.strip())
        walker.feed(pages[i])
        by_kind = lambda kind: sorted(r["tag"] for r in rows if r["kind"] == kind)  # noqa: E731, B023
        assert [t for t in by_kind("element") if t != "page"] == sorted(names)
        assert by_kind("attribute") == sorted(k for k, _ in attributes) and by_kind("value") == sorted(v for _, v in attributes)
        assert by_kind("text") == sorted(texts)
        assert sorted(p for r in rows for p in (r["start"], r["end"])) == list(range(1, 2 * len(rows) + 1))
        for r in rows:
            around = [x for x in rows if x["start"] < r["start"] and x["end"] > r["end"]]
            assert r["level"] == len(around) + 1 and r["parent_start"] == max((x["start"] for x in around), default=None)


def test_structural_joins_never_become_products(spark, sf_dir):
    for name in ("pc_join_equi", "ad_join_equi", "ad_join_labels", "ad_join_bins", "twig_branch", "nj"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_layouts(spark, sf_dir, tmp_path):
    nodes = queries.nodes(spark, sf_dir)
    plan = layout.by_tag(nodes, "order")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan
    sorted_ = layout.store_by_interval(nodes, str(tmp_path / "by_interval"))
    assert sorted_.count() == nodes.count()
    me = Label.literal(7, 1, 1_000_000, 1)
    assert layout.by_interval(sorted_, me).count() == layout.by_interval(nodes, me).count() > 0
    assert layout.by_interval(sorted_, me, "child", "order").filter("level <> 2").count() == 0
    assert layout.by_tag_range(nodes).count() == nodes.count()
    with pytest.raises(ValueError):
        layout.by_interval(nodes, me, "parent")


def test_layout_for_many_tags(spark, sf_dir, tmp_path):
    """Texts are tags: a fixed number of folders, and a look-up reads one of them."""
    nodes = queries.xml_customers(spark, sf_dir)
    by_folder = layout.store_by_folder(nodes, str(tmp_path / "by_folder"))
    assert len([p for p in (tmp_path / "by_folder").iterdir() if p.is_dir()]) <= layout.FOLDERS
    for tag in ("order", "1-URG", "no such tag"):
        found = layout.by_tag(by_folder, tag)
        assert found.count() == nodes.filter(F.col("tag") == tag).count()
        assert "PartitionFilters: [isnotnull(folder" in found._jdf.queryExecution().executedPlan().toString()
    assert layout.by_tag(by_folder, "ORDER", ignore_case=True).count() == nodes.filter("tag = 'order'").count()
    tags = [r["tag"] for r in layout.in_tag_order(by_folder).collect()]
    assert tags == sorted(tags) == [r["tag"] for r in layout.index_only(by_folder, "tag", ordered=True).collect()]


def test_trees_are_built_again_when_their_files_change(spark, tmp_path):
    regions = lambda n: spark.createDataFrame([(i, f"R{i}") for i in range(n)], "r_regionkey long, r_name string").coalesce(1)
    spark.createDataFrame([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    counts = []
    for n in (2, 3, 3):
        regions(n).write.mode("overwrite").parquet(str(tmp_path / "region.parquet"))
        counts.append(queries.nodes(spark, str(tmp_path), "geo").filter("tag = 'region'").count())
    assert counts == [2, 3, 3]


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from copse.sources.shared import shared_root

    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError):
        shared_root(far)


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    docs = spark.createDataFrame([(i, f"<a><b>{i}</b></a>") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(source))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = store_stream(shred_stream(stream), str(out), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = layout.read_nodes(spark, str(out))
    want = shred(docs)
    key = lambda df: sorted(map(str, df.select("doc_id", "start", "end", "level", "tag").collect()))
    assert key(got) == key(want)
    assert layout.by_tag(got, "b").count() == 20
    with pytest.raises(ValueError):
        shred_stream(docs)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).filter(F.lit(True)).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
