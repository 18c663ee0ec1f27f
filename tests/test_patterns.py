"""Patterns and operators over witnesses: known row counts on the protein entries, under every strategy and order."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from copse.operators import witness
from copse.operators.structural import STRATEGIES, pairs
from copse.plans import render
from copse.plans.pattern import Pattern, Rule, parse_pattern
from copse.plans.planner import match, tag_counts
from copse.plans.query import Query, execute, parse_query
from copse.sources.xml import shred

ENTRIES = Path(__file__).parent / "fixtures" / "entries.xml"

#: Tags, rules, nodes in binding order, rows on the entries.
PATTERNS = {
    "p1": ("root Entry", "1 2 PC", [1, 2], 3),
    "p2": ("root Entry Org *", "1 2 PC, 2 3 PC, 3 4 PC", [1, 2, 3, 4], 30),
    "p3": ("root AC Autho *", "1 2 AD, 2 3 PC, 1 4 AD", [1, 2, 4, 3], 0),
    "p4": ("root Ref Autho Eston", "1 2 AD, 2 3 PC, 3 4 PC", [1, 2, 3, 4], 1),
    "p5": ("root Ref Autho Muell", "1 2 AD, 2 3 PC, 3 4 PC", [1, 2, 3, 4], 2),
    "p6": ("root AC P4306 Mod * Featu * ZINC", "1 2 AD, 2 3 PC, 1 4 AD, 4 5 PC, 1 6 AD, 6 7 PC, 7 8 AD", [1, 2, 4, 6, 3, 5, 7, 8], 0),
    "p7": ("root AC P4306 Ref *", "1 2 AD, 2 3 PC, 1 4 AD, 4 5 AD", [1, 2, 4, 3, 5], 0),
    "p8": ("root Entry P9661 Ref *", "1 2 PC, 2 3 AD, 2 4 AD, 4 5 AD", [1, 2, 3, 4, 5], 18),
    "p9": ("Entry Ref *", "1 2 AD, 2 3 PC", [1, 2, 3], 45),
    "q1": ("root Entry Org", "1 2 PC, 2 3 PC", [1, 2, 3], 30),
    "q2": ("root Entry Mod Org", "1 2 PC, 1 3 AD, 2 4 AD", [1, 2, 3, 4], 270),
    "q3": ("root Org", "1 2 AD", [1, 2], 30),
    "q4": ("Entry Mod", "1 2 AD", [1, 2], 9),
    "q5": ("root 100K_ Q6267 Ref Autho Muell", "1 2 AD, 1 3 AD, 1 4 AD, 4 5 PC, 5 6 PC", [1, 2, 3, 4, 5, 6], 2),
    "q6": ("root seqle 102 Speci Lycop", "1 2 AD, 2 3 PC, 1 4 AD, 4 5 PC", [1, 2, 4, 3, 5], 0),
}


def pattern(name: str) -> Pattern:
    tags, rules, _, _ = PATTERNS[name]
    tags = tags.split()
    return parse_pattern("\n".join([str(len(tags)), *tags, *rules.split(", ")]))


@pytest.fixture(scope="module")
def nodes(spark):
    return shred(spark.createDataFrame([(1, ENTRIES.read_text())], "doc_id long, text string")).persist()


#: Rows of each pattern on two smaller documents, as documents 1 and 2.
SMALLER = {"p1": (1, 1), "p2": (13, 13), "p3": (0, 0), "p4": (0, 0), "p5": (2, 0), "p6": (0, 0), "p7": (0, 0), "p8": (0, 0), "p9": (18, 0), "q1": (13, 13), "q2": (39, 39), "q3": (13, 13), "q4": (3, 3), "q5": (2, 0), "q6": (0, 0)}


@pytest.fixture(scope="module")
def smaller(spark):
    texts = [(i, (ENTRIES.parent / f"{name}.xml").read_text()) for i, name in enumerate(("one_entry", "cut_entry"), 1)]
    return shred(spark.createDataFrame(texts, "doc_id long, text string")).persist()


def test_smaller_documents(smaller):
    """Two documents in one table: matches never cross from one to the other."""
    assert {(r["doc_id"], r["n"], r["deep"], r["pairs"]) for r in smaller.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("level").alias("deep"), F.sum(F.col("level") - 1).alias("pairs")).collect()} == {(1, 200, 7, 687), (2, 63, 5, 170)}
    for name, want in SMALLER.items():
        got = {r["doc_id"]: r["count"] for r in match(smaller, pattern(name)).groupBy("doc_id").count().collect()}
        assert (got.get(1, 0), got.get(2, 0)) == want, name


def rows(df) -> list:
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", PATTERNS)
def test_patterns(nodes, name):
    p, (_, _, binding, n) = pattern(name), PATTERNS[name]
    assert p.binding() == binding
    assert match(nodes, p).count() == n


@pytest.mark.parametrize("name", ["p5", "p8", "q2"])
def test_plans_agree(nodes, name):
    p = pattern(name)
    want = rows(match(nodes, p))
    for strategy in STRATEGIES:
        assert rows(match(nodes, p, strategy)) == want
    assert rows(match(nodes, p, stitch=True)) == want
    assert rows(match(nodes, p, counts=tag_counts(nodes, p.tags))) == want
    # the reverse order binds the same nodes in other columns
    back, at = match(nodes, p, reverse=True), {p.position(n, True): p.position(n) for n in range(1, len(p.tags) + 1)}
    renamed = back.select("doc_id", *[back[f"{c}_{k}"].alias(f"{c}_{at[k]}") for k in at for c in witness.PARTS])
    assert rows(renamed) == want


def test_pair_joins(nodes):
    for strategy in STRATEGIES:
        assert pairs(nodes, "*", "*", "PC", strategy).count() == 501
        assert pairs(nodes, "*", "*", "AD", strategy).count() == 1681


def test_sample_witnesses(nodes):
    got = match(nodes, pattern("p4")).collect()[0]
    assert [(got[f"start_{k}"], got[f"end_{k}"], got[f"level_{k}"], got[f"tag_{k}"]) for k in range(1, 5)] == [(1, 1004, 1, "root"), (725, 762, 3, "Ref"), (746, 749, 4, "Autho"), (747, 748, 5, "Eston")]
    assert {(r["start_2"], r["start_3"], r["start_4"]) for r in match(nodes, pattern("p5")).collect()} == {(125, 150, 151), (171, 180, 181)}
    assert render.text(got) == "--root [1, 1004]\n  --Ref [725, 762]\n    --Autho [746, 749]\n      --Eston [747, 748]"


@pytest.mark.parametrize(
    ("one", "two", "op", "at", "n"),
    [("p1", "p4", "CP", (), 3), ("p1", "p9", "CP", (), 135), ("p4", "p5", "TJ", (2, 2), 2), ("p5", "p4", "TJ", (4, 4), 0), ("p1", "p9", "NJ", (2, 1), 45), ("p1", "p8", "NJ", (2, 2), 18)],
)
def test_operations_on_two_patterns(nodes, one, two, op, at, n):
    out = execute(nodes, Query(pattern(one), pattern(two), op, at))
    assert out.count() == n
    assert "root" in out.columns


def test_groups(nodes):
    sizes = lambda name, i: {r["tag"]: r["group_size"] for r in witness.groups(match(nodes, pattern(name)), i).collect()}
    assert sizes("p9", 3) == {"Autho": 20, "Cite": 5, "Comme": 4, "DB": 3, "Medli": 3, "num": 5, "pos": 5}
    assert sizes("p9", 2) == {"Ref": 45}
    four = sizes("p2", 4)
    assert len(four) == 20 and four["Bacil"] == 3 and four["Strut"] == 3 and four["Aves"] == 1
    members = execute(nodes, Query(pattern("p9"), None, "GRP", (3,))).collect()
    assert len(members) == 45
    for r in members:
        assert 1 <= r["member_no"] <= r["group_size"]
    assert {(r["group_no"], r["tag_3"]) for r in members} == set(enumerate(sorted(sizes("p9", 3)), 1))


def test_groups_over_many_parts(spark):
    """A tag that most witnesses have: places are right although its members lie in many parts."""
    rows = [(d, s, s + 1, 2, "hot" if (d + s) % 3 else f"t{d % 7}") for d in range(60) for s in range(1, 40, 2)]
    found = spark.createDataFrame(rows, "doc_id long, start_1 int, end_1 int, level_1 int, tag_1 string").repartition(13)
    got = sorted((r["tag_1"], r["doc_id"], r["start_1"], r["group_no"], r["member_no"], r["group_size"]) for r in witness.group(found, 1).collect())
    want, tags = [], sorted({r[4] for r in rows})
    for no, tag in enumerate(tags, 1):
        members = sorted((r[0], r[1]) for r in rows if r[4] == tag)
        want += [(tag, d, s, no, k, len(members)) for k, (d, s) in enumerate(members, 1)]
    assert got == sorted(want)
    assert [(r["tag"], r["group_no"]) for r in witness.groups(found, 1).orderBy("group_no").collect()] == [(t, k) for k, t in enumerate(tags, 1)]
    assert witness.group(found.limit(0), 1).count() == 0


def test_usual_strategy(nodes):
    from copse.operators.structural import LARGE, usual

    plain = nodes.drop("ancestors", "parent_start")
    assert (usual(nodes), usual(plain)) == ("equi", "labels")
    assert usual(plain.withColumn("end", F.col("end") + LARGE)) == "bins"
    assert rows(match(plain, pattern("p5"), strategy="auto")) == rows(match(nodes, pattern("p5"), strategy="auto"))


def test_sort(nodes):
    out = execute(nodes, Query(pattern("p9"), None, "SRT", (3,))).collect()
    assert [(out[0][f"tag_{k}"], out[0][f"start_{k}"], out[0][f"end_{k}"]) for k in (1, 2, 3)] == [("Entry", 2, 409), ("Ref", 125, 170), ("Autho", 150, 153)]
    keys = [(r["tag_3"], r["start_1"], r["start_2"], r["start_3"]) for r in out]
    assert keys == sorted(keys)


def test_witness_trees(nodes):
    edges = witness.tree_edges(match(nodes, pattern("p5"))).collect()
    assert len(edges) == 8 and {(r["tag"], r["parent_start"]) for r in edges} == {("root", None), ("Ref", 1), ("Autho", 125), ("Autho", 171), ("Muell", 150), ("Muell", 180)}
    assert witness.distinct(match(nodes, pattern("p5")).unionByName(match(nodes, pattern("p5")))).count() == 2
    assert "2 records" in render.counted(match(nodes, pattern("p5")))
    assert render.show(execute(nodes, Query(pattern("p1"), pattern("p4"), "CP"))).count("CP_root") == 3


def test_query_files(nodes, tmp_path):
    for name in ("p3", "p9"):
        tags, rules, _, _ = PATTERNS[name]
        (tmp_path / f"{name}.txt").write_text("\n".join([str(len(tags.split())), *tags.split(), *rules.split(", ")]))
    q = parse_query("ptree_1: p9\noperation: GRP 3\nbuf_size: 5, 10", tmp_path)
    assert execute(nodes, q).count() == 45
    assert parse_query("ptree_1: p9", tmp_path).operation == "SEL"
    with pytest.raises(ValueError, match="position 5"):
        parse_query("ptree_1: p3\noperation: GRP 5\nbuf_size: 5", tmp_path)
    for bad in ("operation: SEL", "ptree_1: p9\noperation: NO", "ptree_1: p9\noperation: CP", "ptree_1: p9\noperation: SRT"):
        with pytest.raises(ValueError):
            parse_query(bad, tmp_path)


def test_bad_patterns():
    for text in ("", "x", "2 a", "2 a b 1 2", "2 a b 1 2 XX", "2 a b 1 3 PC", "2 a b 1 1 PC", "2 a b", "4 a b c d 1 2 PC 3 4 PC"):
        with pytest.raises(ValueError):
            parse_pattern(text)
    assert parse_pattern("2 abcdefg b 1 2 PC").tags == ("abcde", "b")
    p = Pattern(("a", "b", "c"), (Rule(2, 3, "PC"), Rule(1, 2, "PC")))
    assert p.binding() == [2, 3, 1]


def test_wildcards_and_closing_rules(nodes):
    upward = Pattern(("*", "*", "Muell"), (Rule(2, 3, "PC"), Rule(1, 2, "AD")))
    # both forms name the Muell nodes with a parent and any ancestor of it
    assert match(nodes, upward).count() == match(nodes, Pattern(("*", "*", "Muell"), (Rule(1, 2, "AD"), Rule(2, 3, "PC")))).count() > 0
    closing = Pattern(("root", "Ref", "Autho"), (Rule(1, 2, "AD"), Rule(2, 3, "PC"), Rule(1, 3, "AD")))
    assert match(nodes, closing).count() == match(nodes, Pattern(("root", "Ref", "Autho"), (Rule(1, 2, "AD"), Rule(2, 3, "PC")))).count() == 20


def test_batch_run(spark, tmp_path):
    from copse.__main__ import run

    (tmp_path / "p5.txt").write_text("4 root Ref Autho Muell 1 2 AD 2 3 PC 3 4 PC")
    (tmp_path / "query").write_text("ptree_1: p5\noperation: SRT 2\nbuf_size: 5")
    out = run(spark, str(ENTRIES), str(tmp_path / "query"))
    assert "2 records returned by SRT, 4 nodes each" in out and out.count("--Muell") == 2
    assert "2 records returned by SEL" in run(spark, str(ENTRIES), str(tmp_path / "p5.txt"))
