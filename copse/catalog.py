"""Relations, their columns and statistics, through Spark's own catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTS = {"int": T.IntegerType(), "float": T.FloatType(), "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType()}


def create(spark: SparkSession, name: str, columns: list[tuple[str, str]], rows: list[tuple] = ()) -> DataFrame:
    """A relation from attributes (name, type) and rows of strings, each checked and cast to its type."""
    unknown = [t for _, t in columns if t not in CASTS]
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    for r in rows:
        if len(r) != len(columns):
            raise ValueError(f"a row of {len(r)} values for {len(columns)} attributes")
    raw = spark.createDataFrame([tuple(map(str, r)) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c, _ in columns]))
    df = raw.select(*[F.col(c).cast(CASTS[t]).alias(c) for c, t in columns])
    df.createOrReplaceTempView(name)
    return df


def drop(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def relations(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def attributes(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def statistics(df: DataFrame) -> DataFrame:
    """(attribute, tuples, distinct, least, greatest), a row a column. Distinct values are counted exactly; null is none."""
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    one = df.agg(F.count("*").alias("n"), *[F.struct(F.count_distinct(c).alias("d"), F.min(c).cast("string").alias("a"), F.max(c).cast("string").alias("b")).alias(f"s_{i}") for i, c in enumerate(simple)])
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col("n").alias("tuples"), F.col(f"s_{i}.d").alias("distinct"), F.col(f"s_{i}.a").alias("least"), F.col(f"s_{i}.b").alias("greatest")) for i, c in enumerate(simple)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def analyze(df: DataFrame, path: str) -> DataFrame:
    """Stores the statistics of a table, and reads them back."""
    statistics(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def add_index(df: DataFrame, path: str, *keys: str, folders: bool = False) -> DataFrame:
    """A copy of any table that look-ups by the keys read little of: sorted by ranges of them, so that Parquet statistics skip
    row groups and files, or, for few different values, with a folder for each value of the first key."""
    if folders:
        df.hint("rebalance", keys[0]).sortWithinPartitions(*keys).write.partitionBy(keys[0]).mode("overwrite").parquet(path)
    else:
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def io_counters(spark: SparkSession) -> dict[str, int]:
    """Bytes that tasks of this application have read and shuffled so far."""
    out = {"input": 0, "shuffle_read": 0, "shuffle_write": 0}
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for i in range(listed.size()):
        e = listed.apply(i)
        out["input"] += e.totalInputBytes()
        out["shuffle_read"] += e.totalShuffleRead()
        out["shuffle_write"] += e.totalShuffleWrite()
    return out
