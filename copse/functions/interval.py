"""Relations between interval labels (doc_id, start, end, level), as Column expressions.

Labels are well nested: the intervals of two nodes of one document are disjoint or one strictly holds the other. Every
relation holds within one document only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of relation(): fixed values.
PARENT, ANCESTOR, CHILD, DESCENDANT, EQUAL, OVERLAP, DISJOINT = 9, 1, 10, 2, 4, 3, 0


@dataclass(frozen=True)
class Label:
    """The columns of one node."""

    doc: Column
    start: Column
    end: Column
    level: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "", doc: str = "doc_id") -> Label:
        name = lambda c: F.col(f"{prefix}{c}{suffix}")
        return Label(F.col(doc), name("start"), name("end"), name("level"))

    @staticmethod
    def literal(doc: int, start: int, end: int, level: int) -> Label:
        return Label(F.lit(doc), F.lit(start), F.lit(end), F.lit(level))


def contains(a: Label, b: Label) -> Column:
    return (a.doc == b.doc) & (a.start < b.start) & (a.end > b.end)


def is_ancestor(a: Label, b: Label) -> Column:
    return contains(a, b)


def is_descendant(a: Label, b: Label) -> Column:
    return contains(b, a)


def is_parent(a: Label, b: Label) -> Column:
    return contains(a, b) & (b.level == a.level + 1)


def is_child(a: Label, b: Label) -> Column:
    return is_parent(b, a)


def same(a: Label, b: Label) -> Column:
    return (a.doc == b.doc) & (a.start == b.start) & (a.end == b.end)


def different(a: Label, b: Label) -> Column:
    return ~same(a, b)


def disjoint(a: Label, b: Label) -> Column:
    return (a.doc != b.doc) | (a.end < b.start) | (a.start > b.end)


def relation(a: Label, b: Label) -> Column:
    """One code for how a stands to b."""
    return (
        F.when(is_parent(a, b), PARENT)
        .when(is_ancestor(a, b), ANCESTOR)
        .when(is_child(a, b), CHILD)
        .when(is_descendant(a, b), DESCENDANT)
        .when(same(a, b), EQUAL)
        .when(disjoint(a, b), DISJOINT)
        .otherwise(OVERLAP)
    )


def invalid(label: Label) -> Column:
    """True for labels that no tree has."""
    return (label.start < 1) | (label.end <= label.start) | (label.level < 1)
