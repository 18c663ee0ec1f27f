"""Record operations on stored tables. Parquet files are never changed in place: a change is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Columns keep their types: a value that doesn't cast is an error."""
    unknown = set(values) - set(table.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in table.dtypes])


def get(table: DataFrame, **key) -> DataFrame:
    for c, v in key.items():
        table = table.filter(F.col(c) == v)
    return table


def count(table: DataFrame) -> int:
    return table.count()


def materialise(table: DataFrame, path: str) -> DataFrame:
    """Stores a result and reads it back, so that what follows doesn't compute it again, and lost executors cost nothing."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
