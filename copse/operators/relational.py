"""The relational basics that tree queries rest on, over any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions.cnf import cnf


def file_scan(table: DataFrame, clauses: list[list[tuple]] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Scan, filter, project; filter and projection reach the Parquet reader."""
    found = table.filter(cnf(clauses)) if clauses else table
    return found.select(*fields) if fields else found


def key_range(table: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Keys between two bounds, both included; None is no bound."""
    clauses = [[(F.col(key), op, x)] for op, x in ((">=", low), ("<=", high)) if x is not None]
    return file_scan(table, clauses)


def project(table: DataFrame, *fields: str | int) -> DataFrame:
    """By name, or by position from 1."""
    return table.select(*[table.columns[f - 1] if isinstance(f, int) else f for f in fields])


def theta_join(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """Inner join on any condition; none: the product. Catalyst picks the algorithm."""
    return left.crossJoin(right) if on is None else left.join(right, on)


def merge_join(left: DataFrame, right: DataFrame, on: Column, residual: Column | None = None) -> DataFrame:
    """Equi-join by sorting both sides, then a residual condition."""
    joined = left.hint("merge").join(right, on)
    return joined if residual is None else joined.filter(residual)


def sort(table: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    return table.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def distinct(table: DataFrame) -> DataFrame:
    """Rows equal in every column are one, wherever they stand."""
    return table.distinct()
