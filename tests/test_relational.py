"""Relational basics on the sailors, boats and reservations, sorting and key look-ups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from copse import catalog
from copse.functions.cnf import Ref
from copse.operators import relational as rel
from copse.sources import table

# The tables and answers of the six queries.
SAILORS = """53|Bob Holloway|9|53.6
54|Susan Horowitz|1|34.2
57|Yannis Ioannidis|8|40.2
59|Deborah Joseph|10|39.8
61|Landwebber|8|56.7
63|James Larus|9|30.3
64|Barton Miller|5|43.7
67|David Parter|1|99.9
69|Raghu Ramakrishnan|9|37.1
71|Guri Sohi|10|42.1
73|Prasoon Tiwari|8|39.2
39|Anne Condon|3|30.3
47|Charles Fischer|6|46.3
49|James Goodman|4|50.3
50|Mark Hill|5|35.2
75|Mary Vernon|7|43.1
79|David Wood|3|39.2
84|Mark Smucker|9|25.3
87|Martin Reames|10|24.1
10|Mike Carey|9|40.3
21|David Dewitt|10|47.2
29|Tom Reps|7|39.1
31|Jeff Naughton|5|35.0
35|Miron Livny|7|37.6
37|Marv Solomon|10|48.9"""
BOATS = "1|Onion|white\n2|Buckey|red\n3|Enterprise|blue\n4|Voyager|green\n5|Wisconsin|red"
RESERVES = "10|1|05/10/95\n21|1|05/11/95\n10|2|05/11/95\n31|1|05/12/95\n10|3|05/13/95\n69|4|05/12/95\n69|5|05/14/95\n21|5|05/16/95\n57|2|05/10/95\n35|3|05/15/95"


def load(spark, name, columns, text):
    return catalog.create(spark, name, columns, [tuple(x.split("|")) for x in text.splitlines()])


@pytest.fixture(scope="module")
def tables(spark):
    sailors = load(spark, "sailors", [("sid", "int"), ("sname", "string"), ("rating", "int"), ("age", "double")], SAILORS)
    boats = load(spark, "boats", [("bid", "int"), ("bname", "string"), ("color", "string")], BOATS)
    reserves = load(spark, "reserves", [("rsid", "int"), ("rbid", "int"), ("date", "string")], RESERVES)
    yield sailors, boats, reserves
    for name in ("sailors", "boats", "reserves"):
        catalog.drop(spark, name)


def names(df) -> list[str]:
    return [r["sname"] for r in df.collect()]


def test_six_queries(tables):
    sailors, boats, reserves = tables
    booked = rel.theta_join(sailors, reserves, F.col("sid") == F.col("rsid"))
    with_boat = rel.theta_join(booked, boats, F.col("rbid") == F.col("bid"))
    one = rel.file_scan(booked, [[(Ref("rbid"), "=", 1)]], ["sname", "date"])
    assert sorted(map(tuple, one.collect())) == [("David Dewitt", "05/11/95"), ("Jeff Naughton", "05/12/95"), ("Mike Carey", "05/10/95")]
    red = rel.file_scan(with_boat, [[(Ref("color"), "=", "red")]])
    four = ["David Dewitt", "Mike Carey", "Raghu Ramakrishnan", "Yannis Ioannidis"]
    assert names(rel.sort(red, "sname")) == four
    assert sorted(names(booked)) == sorted(["Mike Carey"] * 3 + ["David Dewitt"] * 2 + ["Jeff Naughton", "Miron Livny", "Yannis Ioannidis"] + ["Raghu Ramakrishnan"] * 2)
    assert len(names(rel.distinct(booked.select("sname")))) == 6
    five = rel.file_scan(booked, [[(Ref("age"), ">", 40.0), (Ref("rating"), "<", 7)]], ["sname", "rating", "age"])
    assert sorted(map(tuple, five.collect())) == sorted([("Mike Carey", 9, 40.3)] * 3 + [("David Dewitt", 10, 47.2)] * 2 + [("Jeff Naughton", 5, 35.0), ("Yannis Ioannidis", 8, 40.2)])
    assert names(rel.sort(rel.file_scan(red, [[(Ref("rating"), ">", 7)]]), "sname")) == four
    merged = rel.merge_join(sailors, reserves, F.col("sid") == F.col("rsid"), F.col("rating") > 7)
    assert merged.count() == 8
    assert rel.theta_join(boats, reserves).count() == 50
    assert rel.project(boats, 2, "bid").columns == ["bname", "bid"]


def test_sort_and_ranges(spark):
    rng = random.Random(1000)
    values = [(rng.randint(-1000, 1000), rng.uniform(-5, 5), rng.choice("abcdef")) for _ in range(1000)]
    df = spark.createDataFrame(values, "i int, x double, s string")
    assert [r.i for r in rel.sort(df, "i").collect()] == sorted(v[0] for v in values)
    assert [r.x for r in rel.sort(df, "x", descending=True).collect()] == sorted((v[1] for v in values), reverse=True)
    assert rel.key_range(df, "i", 100, 900).count() == sum(100 <= v[0] <= 900 for v in values)
    assert rel.key_range(df, "s", "b", None).count() == sum(v[2] >= "b" for v in values)
    # equal rows that are not neighbours in the first column's order are found, too
    assert rel.distinct(df.select("s").unionByName(df.select("s"))).count() == 6


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    assert table.count(table.insert(df, df)) == 6
    assert [r.i for r in table.delete(df, F.col("s") == "a").orderBy("i").collect()] == [2, 3]
    assert [r.s for r in table.update(df, F.col("s") == "a", {"s": F.lit("z")}).orderBy("i").collect()] == ["z", "b", None]
    assert table.get(df, i=2).first()["s"] == "b"
    assert sorted(table.materialise(df, str(tmp_path / "t")).collect(), key=lambda r: r.i) == df.orderBy("i").collect()
    with pytest.raises(ValueError):
        table.update(df, F.lit(True), {"no": F.lit(1)})


def test_distinct_values_are_counted_exactly(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 7919).alias("k"), F.when(F.col("id") > 9, F.col("id")).alias("n"))
    assert {r["attribute"]: r["distinct"] for r in catalog.statistics(df).collect()} == {"id": 50_000, "k": 7919, "n": 49_990}


def test_catalog(spark, tables):
    assert {"sailors", "boats", "reserves"} <= set(catalog.relations(spark))
    assert catalog.attributes(spark, "boats") == [("bid", "int"), ("bname", "string"), ("color", "string")]
    stats = {r["attribute"]: r for r in catalog.statistics(tables[1]).collect()}
    assert (stats["bid"]["tuples"], stats["bid"]["least"], stats["bid"]["greatest"]) == (5, "1", "5")
    assert set(catalog.io_counters(spark)) == {"input", "shuffle_read", "shuffle_write"}
    with pytest.raises(ValueError):
        catalog.create(spark, "bad", [("a", "date")])
    with pytest.raises(ValueError):
        catalog.create(spark, "bad", [("a", "int")], [("1", "2")])


def test_index_and_stored_statistics(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 4 AS kind", "cast(id as string) AS name").repartition(7)
    rows = lambda x: sorted(map(tuple, x.select("id", "kind", "name").collect()))
    for i, (keys, folders) in enumerate(((("id",), False), (("kind", "id"), False), (("kind", "id"), True))):
        assert rows(catalog.add_index(df, str(tmp_path / f"index{i}"), *keys, folders=folders)) == rows(df)
    kept = catalog.analyze(df, str(tmp_path / "statistics"))
    assert {(r["attribute"], r["tuples"], r["distinct"]) for r in kept.collect()} == {("id", 1000, 1000), ("kind", 1000, 4), ("name", 1000, 1000)}
