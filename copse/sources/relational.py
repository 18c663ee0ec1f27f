"""Relational hierarchies as node tables, without a recursive walk.

With the 1-based preorder rank `pre` of a node in its document, its level and the number of nodes in its subtree, itself
included: start = 2 pre - level, end = start + 2 size - 1. The rank is one window over the document's key columns, the
sizes are counts by key prefix, and parents are the last node seen one level up; all of them share one partitioning by
document, so a tree costs one shuffle. Where some document has more than LARGE nodes, which would be one task, ranks come
from a range sort of the whole table instead, and sizes and ancestors from aggregates by key prefix; labels are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.sources.schema import NODE
from copse.sources.shared import numbered
from copse.sources.xml import shred


#: Nodes of a document that one task labels.
LARGE = 1 << 22


def label(rows: DataFrame, keys: list[str], leaf: str, large: bool | None = None) -> DataFrame:
    """The node table of rows (doc_id, *keys, leaf, tag, kind).

    A node's place is its keys, null from some key on; nodes with equal keys and no leaf number are inner nodes, whose leaf
    children have leaf numbers 1, 2, ... Children come in the order of the keys, leaves first.
    """
    depth = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in keys], F.lit(0))
    placed = rows.withColumn("_depth", depth).withColumn("level", F.col("_depth") + 1 + F.col(leaf).isNotNull().cast("int"))
    order = [F.col(c).asc_nulls_first() for c in (*keys, leaf)]
    if large:
        return _label_split(placed, keys, leaf, order)
    whole = Window.partitionBy("doc_id").orderBy(*order)
    size = F.when(F.col(leaf).isNotNull(), F.lit(1))
    for d in reversed(range(len(keys) + 1)):
        # ordered like the window of the whole document, so that one sort serves all of them
        below = Window.partitionBy("doc_id", *keys[:d]).orderBy(*order[d:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        size = size.when(F.col("_depth") == d, F.count("*").over(below))
    numbered = placed.withColumn("_size", size).withColumn("start", (2 * F.row_number().over(whole) - F.col("level")).cast("int"))
    seen = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = [F.last(F.when(F.col("level") == k, F.col("start")), ignorenulls=True).over(seen) for k in range(1, len(keys) + 2)]
    out = numbered.withColumn("end", (F.col("start") + 2 * F.col("_size") - 1).cast("int"))
    out = out.withColumn("_path", F.array(*above)).withColumn("ancestors", F.slice("_path", 1, F.col("level") - 1))
    return out.withColumn("parent_start", F.get("_path", F.col("level") - 2)).select(*[F.col(f.name).cast(f.dataType) for f in NODE])


def _label_split(placed: DataFrame, keys: list[str], leaf: str, order: list[Column]) -> DataFrame:
    """label() without a window over a document.

    Rows meet the first place and the number of nodes below each of their key prefixes in joins of stored tables, whose hot
    keys adaptive execution splits.
    """
    inner = F.col(leaf).isNull()
    out = ranked = numbered(placed, "_no", F.col("doc_id").asc_nulls_first(), *order)
    for d in range(len(keys) + 1):
        prefix = ["doc_id", *keys[:d]]
        head = F.min(F.when(inner & (F.col("_depth") == d), F.col("_no")))
        groups = ranked.filter(F.col("_depth") >= d).groupBy(*[F.col(c).alias(f"_g{d}_{c}") for c in prefix]).agg(F.min("_no").alias(f"_first{d}"), head.alias(f"_head{d}"), F.count("*").alias(f"_n{d}"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{d}_{c}")) for c in prefix])
        out = out.join(groups, same, "left").drop(*[f"_g{d}_{c}" for c in prefix])
    begin = lambda no, level: (2 * (no - F.col("_first0") + 1) - level).cast("int")
    size = F.when(~inner, F.lit(1))
    for d in range(len(keys) + 1):
        size = size.when(F.col("_depth") == d, F.col(f"_n{d}"))
    path = F.array(*[begin(F.col(f"_head{d}"), F.lit(d + 1)) for d in range(len(keys) + 1)])
    out = out.withColumn("start", begin(F.col("_no"), F.col("level"))).withColumn("end", (F.col("start") + 2 * size - 1).cast("int"))
    out = out.withColumn("ancestors", F.slice(path, 1, F.col("level") - 1)).withColumn("parent_start", F.get(path, F.col("level") - 2))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in NODE])


def _nodes(rows: DataFrame, keys: dict[str, Column], element: Column, *attributes: Column) -> DataFrame:
    """For label(): of each row, read once, an element and its attributes, which are its leaves 1, 2, ..."""
    node = lambda i, tag: F.struct((F.lit(i) if i else F.lit(None)).cast("int").alias("leaf"), tag.alias("tag"), F.lit("attribute" if i else "element").alias("kind"))
    made = F.inline(F.array(*[node(i, tag) for i, tag in enumerate((element, *attributes))]))
    return rows.select("doc_id", *[k.alias(name) for name, k in keys.items()], made)


def sales_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a customer: customer > order > line, with leaves for segment, status, priority and return flag.

    Each row of lineitem is a line, numbered in its order by line number and flag; rows that are equal in both give equal
    nodes, so labels don't depend on the order of the rows.
    """
    place = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").asc_nulls_first(), F.col("l_returnflag").asc_nulls_first())
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.row_number().over(place).cast("long").alias("n"), F.col("l_returnflag").alias("flag"))
    return _sales(spark, sf_dir, lines)


def _sales(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """The tree of lines (l_orderkey, n, flag) and what is above them."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none = F.lit(None).cast("long")
    customer = read("customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    orders = read("orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("doc_id", "o_orderkey", "n", "flag")
    o, n = F.col("o_orderkey"), F.col("n")
    parts = [
        _nodes(customer, {"o": none, "l": none}, F.lit("customer"), F.concat(F.lit("segment="), "c_mktsegment")),
        _nodes(orders, {"o": o, "l": none}, F.lit("order"), F.concat(F.lit("status="), "o_orderstatus"), F.concat(F.lit("priority="), "o_orderpriority")),
        _nodes(lines, {"o": o, "l": n}, F.lit("line"), F.concat(F.lit("flag="), "flag")),
    ]
    return label(reduce(DataFrame.unionByName, parts), ["o", "l"], "leaf")


def chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a conversation: chat > turn > role. Each row is a turn; those with one number come in the order of their roles."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.row_number().over(place).alias("turn"), "role")
    chats = rows.select("doc_id").distinct()
    turn = F.col("turn").cast("long")
    parts = [_nodes(chats, {"turn": F.lit(None).cast("long")}, F.lit("chat")), _nodes(rows, {"turn": turn}, F.lit("turn"), F.coalesce("role", F.lit("")))]
    return label(reduce(DataFrame.unionByName, parts), ["turn"], "leaf")


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a region: region > nation, by name."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").cast("long").alias("n"), "n_name")
    parts = [_nodes(region, {"n": F.lit(None).cast("long")}, F.lit("region"), F.col("r_name")), _nodes(nation, {"n": F.col("n")}, F.lit("nation"), F.col("n_name"))]
    return label(reduce(DataFrame.unionByName, parts), ["n"], "leaf")


def _element(name: str, *inside: Column, **attributes: Column) -> Column:
    """An XML element as a string column, with texts and attribute values escaped."""
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), escaped(v), F.lit('"')]
    return F.concat(*parts, F.lit(">"), *inside, F.lit(f"</{name}>"))


def escaped(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _documents(top: DataFrame, below: DataFrame, name: str, head: Column) -> DataFrame:
    """(doc_id, text): an XML document for each row of top (doc_id, ...), with the elements of below (doc_id, at, element) in the order of at."""
    inside = below.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "element"))).alias("parts"))
    joined = top.join(inside, "doc_id", "left")
    content = F.coalesce(F.concat_ws("", F.transform("parts", lambda x: x["element"])), F.lit(""))
    return joined.select("doc_id", _element(name, head, content).alias("text"))


def xml_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, written as XML documents and shredded; names and texts are cut to five characters."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    top = read("customer").select(F.col("c_custkey").cast("long").alias("doc_id"), "c_mktsegment")
    order = _element("order", _element("priority", escaped(F.col("o_orderpriority"))), status=F.col("o_orderstatus"))
    below = read("orders").select(F.col("o_custkey").cast("long").alias("doc_id"), F.col("o_orderkey").alias("at"), order.alias("element"))
    return shred(_documents(top, below, "customer", _element("segment", escaped(F.col("c_mktsegment")))))


def xml_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations, in the same way."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    top = read("region").select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name")
    nation = _element("nation", _element("name", escaped(F.col("n_name"))))
    below = read("nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("at"), nation.alias("element"))
    return shred(_documents(top, below, "region", _element("name", escaped(F.col("r_name")))))
