"""The node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from copse.functions.interval import Label, invalid

NODE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("parent_start", T.IntegerType()),
        T.StructField("ancestors", T.ArrayType(T.IntegerType())),
    ]
)


def faulty(nodes: DataFrame) -> DataFrame:
    """Rows whose label no tree has."""
    return nodes.filter(invalid(Label.of()))
