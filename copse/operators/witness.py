"""Operators over witness tables.

A witness is a match of a pattern: columns doc_id and, for the k-th bound node, start_k, end_k, level_k, tag_k, where k
counts nodes in binding order. Positions i and j of the operators are such k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.sources.shared import numbered

PARTS = ("start", "end", "level", "tag")


def width(witnesses: DataFrame) -> int:
    return sum(c.startswith("tag_") for c in witnesses.columns)


def check(witnesses: DataFrame, i: int) -> None:
    if not 1 <= i <= width(witnesses):
        raise ValueError(f"position {i} is not among the {width(witnesses)} bound nodes")


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns]), right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """CP: every witness of one pattern with every one of the other. The result is as large as that asks for."""
    a, b = sides(left, right)
    return a.crossJoin(b).withColumn("root", F.lit("CP_root"))


def tag_join(left: DataFrame, right: DataFrame, i: int, j: int) -> DataFrame:
    """TJ i j: equal tags at the left pattern's i and the right one's j."""
    check(left, i)
    check(right, j)
    a, b = sides(left, right)
    return a.join(b, F.col(f"left_tag_{i}") == F.col(f"right_tag_{j}")).withColumn("root", F.concat(F.lit("TJ_root_"), F.col(f"left_tag_{i}")))


def node_join(left: DataFrame, right: DataFrame, i: int, j: int) -> DataFrame:
    """NJ i j: the same node at both places."""
    check(left, i)
    check(right, j)
    a, b = sides(left, right)
    on = (F.col("left_doc_id") == F.col("right_doc_id")) & (F.col(f"left_start_{i}") == F.col(f"right_start_{j}")) & (F.col(f"left_end_{i}") == F.col(f"right_end_{j}"))
    return a.join(b, on).withColumn("root", F.concat(F.lit("NJ_root_["), F.col(f"left_start_{i}").cast("string"), F.lit(","), F.col(f"left_end_{i}").cast("string"), F.lit("]")))


def order(witnesses: DataFrame, i: int) -> list:
    return [F.col(f"tag_{i}"), F.col("doc_id"), *[F.col(f"start_{k}") for k in range(1, width(witnesses) + 1)]]


def sort(witnesses: DataFrame, i: int) -> DataFrame:
    """SRT i: ascending by the tag at position i, ties by document and starts."""
    check(witnesses, i)
    return witnesses.orderBy(*order(witnesses, i))


def group(witnesses: DataFrame, i: int) -> DataFrame:
    """GRP i: witnesses with their group's number (groups in order of the tag at position i) and their place in it.

    Members are kept, not aggregated. A member's place is its place among all witnesses less that of its group's first
    one, so a tag that most witnesses have is as many tasks as its size asks for.
    """
    check(witnesses, i)
    tag = f"tag_{i}"
    members = numbered(witnesses, "member_no", F.col(tag), F.col("doc_id"), *[F.col(f"start_{k}") for k in range(1, width(witnesses) + 1)])
    tags = members.groupBy(F.col(tag).alias("_tag")).agg(F.count("*").alias("group_size"), F.min("member_no").alias("_first"))
    joined = members.join(numbered(tags, "group_no", F.col("_tag")), F.col(tag).eqNullSafe(F.col("_tag")))
    return joined.select(*witnesses.columns, (F.col("member_no") - F.col("_first") + 1).alias("member_no"), "group_size", "group_no")


def groups(witnesses: DataFrame, i: int) -> DataFrame:
    """One row a group: its number, tag and size."""
    check(witnesses, i)
    return numbered(witnesses.groupBy(F.col(f"tag_{i}").alias("tag")).agg(F.count("*").alias("group_size")), "group_no", F.col("tag"))


def distinct(witnesses: DataFrame) -> DataFrame:
    return witnesses.dropDuplicates()


def tree_edges(witnesses: DataFrame) -> DataFrame:
    """Each witness as a tree: (witness, doc_id, start, end, level, tag, parent_start), a row a node; witness: the starts of its nodes.

    A node bound twice is one; a node's parent is the nearest other bound node around it, null at the root.
    """
    n = width(witnesses)
    node = lambda k: F.struct(*[F.col(f"{p}_{k}").alias(p) for p in PARTS])
    key = F.array(*[f"start_{k}" for k in range(1, n + 1)]).alias("witness")
    listed = witnesses.select(key, "doc_id", F.array_sort(F.array_distinct(F.array(*[node(k) for k in range(1, n + 1)]))).alias("nodes"))
    around = lambda x: F.filter("nodes", lambda y: (y["start"] < x["start"]) & (y["end"] > x["end"]))
    with_parent = F.transform("nodes", lambda x: F.struct(*[x[p].alias(p) for p in PARTS], F.array_max(F.transform(around(x), lambda y: y["start"])).alias("parent_start")))
    return listed.select("witness", "doc_id", F.explode(with_parent).alias("n")).select("witness", "doc_id", "n.*")
