"""Filters in conjunctive normal form: a list of clauses, each a list of conditions of which one has to hold."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from copse.functions import interval
from copse.functions.interval import Label

SCALAR = {"=": operator.eq, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "!=": operator.ne}
STRUCTURAL = {"same": interval.same, "different": interval.different, "parent": interval.is_parent, "child": interval.is_child, "ancestor": interval.is_ancestor, "descendant": interval.is_descendant}


class Ref(str):
    """A column by name; any other operand is a literal."""


def _operand(x) -> Column:
    return F.col(x) if isinstance(x, Ref) else x if isinstance(x, Column) else F.lit(x)


def condition(left, op: str, right, ignore_case: bool = False) -> Column:
    if op in STRUCTURAL:
        if not (isinstance(left, Label) and isinstance(right, Label)):
            raise ValueError(f"{op} compares labels")
        return STRUCTURAL[op](left, right)
    if op == "between":
        lo, hi = right
        return _operand(left).between(_operand(lo), _operand(hi))
    if op not in SCALAR:
        raise ValueError(f"unknown operator {op}")
    a, b = _operand(left), _operand(right)
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    return SCALAR[op](a, b)


def cnf(clauses: list[list[tuple]] | None) -> Column:
    """AND of the clauses, OR within each; no clause: true."""
    if not clauses:
        return F.lit(True)
    if not all(clauses):
        raise ValueError("an empty clause is never true")
    return reduce(operator.and_, (reduce(operator.or_, (condition(*c) for c in clause)) for clause in clauses))
