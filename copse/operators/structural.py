"""Structural joins.

Catalyst plans a containment predicate as a product of both sides. Three rewrites give it an equality to work with:
equi   parent-child on (doc_id, parent start), ancestor-descendant on (doc_id, ancestor's start) after exploding each
       node's ancestors, which costs the sum of the depths;
labels the equality of doc_id, the containment as a residual: for node tables that have labels only;
bins   as labels, but starts are put into bins that an ancestor covers: for very large documents.

Exploded ancestors are kept only on the levels on which the upper nodes lie, so the root of a large document, which all its
nodes have among their ancestors, is no hot key of a join that doesn't ask for it. usual() picks a strategy for a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("equi", "labels", "bins")
BIN = 1024
#: Positions in a document from which on pairs inside one document are too many for `labels`.
LARGE = 1 << 14


def usual(nodes: DataFrame) -> str:
    """equi where the table has ancestors; else bins if some document is large, and labels if none is. One aggregate."""
    if "ancestors" in nodes.columns and "parent_start" in nodes.columns:
        return "equi"
    return "bins" if (nodes.agg(F.max("end")).first()[0] or 0) > LARGE else "labels"


def named(nodes: DataFrame, i: int | str, tag: str | None = "*") -> DataFrame:
    """A pattern node's candidates with columns of its own; * or None: any tag."""
    if tag not in (None, "*"):
        nodes = nodes.filter(F.col("tag") == tag)
    extra = [c for c in ("parent_start", "ancestors") if c in nodes.columns]
    return nodes.select(F.col("doc_id").alias(f"doc_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in ("start", "end", "level", "tag", *extra)])


def holds(a: int | str, d: int | str, axis: str) -> Column:
    """The test itself between two bound nodes."""
    inside = (F.col(f"doc_{a}") == F.col(f"doc_{d}")) & (F.col(f"start_{a}") < F.col(f"start_{d}")) & (F.col(f"end_{a}") > F.col(f"end_{d}"))
    return inside & (F.col(f"level_{d}") == F.col(f"level_{a}") + 1) if axis == "PC" else inside


def structural_join(left: DataFrame, right: DataFrame, a: int | str, d: int | str, axis: str, strategy: str = "equi", width: int = BIN, levels: DataFrame | None = None) -> DataFrame:
    """Joins two tables of named nodes, one of which has node a (the upper one) and the other d. axis: PC or AD.

    levels: rows (level), one for each level of the upper nodes, at most as many as the tree is deep.
    """
    if axis not in ("PC", "AD"):
        raise ValueError(f"axis {axis} is neither PC nor AD")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    upper, lower = (left, right) if f"start_{a}" in left.columns else (right, left)
    doc = F.col(f"doc_{a}") == F.col(f"doc_{d}")
    if strategy == "equi" and axis == "PC":
        return upper.join(lower, doc & (F.col(f"start_{a}") == F.col(f"parent_start_{d}")))
    if strategy == "equi":
        key, at = f"_anc_{d}", f"_at_{d}"
        lower = lower.select("*", F.posexplode(f"ancestors_{d}").alias(at, key))
        if levels is not None:
            lower = lower.join(F.broadcast(levels.select(F.col("level").alias("_level"))), F.col(at) + 1 == F.col("_level"), "left_semi")
        lower = lower.drop(at)
        return upper.join(lower, doc & (F.col(f"start_{a}") == F.col(key))).drop(key)
    if strategy == "labels":
        return upper.join(lower, holds(a, d, axis))
    # each lower node has one bin, so no pair comes twice
    upper = upper.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"start_{a}") / width), F.floor(F.col(f"end_{a}") / width))))
    lower = lower.withColumn("_at", F.floor(F.col(f"start_{d}") / width))
    return upper.join(lower, (F.col("_bin") == F.col("_at")) & holds(a, d, axis)).drop("_bin", "_at")


def levels_of(nodes: DataFrame, tag: str) -> DataFrame | None:
    """The levels on which nodes of a tag lie; none for any tag."""
    return None if tag == "*" else nodes.filter(F.col("tag") == tag).select("level").distinct()


def pairs(nodes: DataFrame, upper: str, lower: str, axis: str, strategy: str = "equi") -> DataFrame:
    """All (upper, lower) pairs of two tags."""
    joined = structural_join(named(nodes, 1, upper), named(nodes, 2, lower), 1, 2, axis, strategy, levels=levels_of(nodes, upper))
    return joined.select(F.col("doc_1").alias("doc_id"), *[f"{c}_{i}" for i in (1, 2) for c in ("start", "end", "level", "tag")])


def node_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes that two tables share."""
    a, b = named(left, 1), named(right, 2)
    joined = a.join(b, (F.col("doc_1") == F.col("doc_2")) & (F.col("start_1") == F.col("start_2")) & (F.col("end_1") == F.col("end_2")))
    return joined.select(F.col("doc_1").alias("doc_id"), *[f"{c}_{i}" for i in (1, 2) for c in ("start", "end", "level", "tag")])
