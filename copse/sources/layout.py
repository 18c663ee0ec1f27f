"""How node tables are stored, and look-ups that a layout makes cheap.

By tag: one folder a tag, so a tag predicate reads its own files only. By folder: for trees whose texts and attribute values
are tags, tags are dealt to a fixed number of folders by hash and sorted in them, so a tag predicate reads one folder and
skips row groups. By interval: range-partitioned and sorted by (doc_id, start), so Parquet statistics skip row groups
outside a range of starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.functions.interval import Label, is_child, is_descendant, same
from copse.sources.schema import NODE
from copse.sources.shared import state, temporary


def store_by_tag(nodes: DataFrame, path: str) -> DataFrame:
    """For trees with few tags. Rows are rebalanced by tag: a frequent tag is split over as many tasks and files as its size asks for."""
    nodes.hint("rebalance", "tag").sortWithinPartitions("tag", "doc_id", "start").write.partitionBy("tag").mode("overwrite").parquet(path)
    return read_nodes(nodes.sparkSession, path)


#: Folders of the layout for many tags.
FOLDERS = 64


def folder_of(tag: Column) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(FOLDERS)).cast("int")


def store_by_folder(nodes: DataFrame, path: str) -> DataFrame:
    """For trees with many tags, however many there are. The column `folder` stays in the table, and by_tag() uses it."""
    dealt = nodes.withColumn("folder", folder_of(F.col("tag"))).hint("rebalance", "folder").sortWithinPartitions("folder", "tag", "doc_id", "start")
    dealt.write.partitionBy("folder").mode("overwrite").parquet(path)
    return read_folders(nodes.sparkSession, path)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*NODE.fields, T.StructField("folder", T.IntegerType())])).parquet(path)


def store_by_interval(nodes: DataFrame, path: str) -> DataFrame:
    nodes.repartitionByRange("doc_id", "start").sortWithinPartitions("doc_id", "start").write.mode("overwrite").parquet(path)
    return read_nodes(nodes.sparkSession, path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path).select(*NODE.names)


def scan(nodes: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    found = nodes if where is None else nodes.filter(where)
    return found.select(*columns) if columns else found


def by_tag(nodes: DataFrame, tag: str, ignore_case: bool = False) -> DataFrame:
    """Point search; the tag is literal, there are no wildcards."""
    if "folder" in nodes.columns and not ignore_case:
        nodes = nodes.filter(F.col("folder") == folder_of(F.lit(tag)))
    return nodes.filter(F.lower("tag") == tag.lower() if ignore_case else F.col("tag") == tag)


def by_tag_range(nodes: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Both bounds included; None is no bound."""
    if low is not None:
        nodes = nodes.filter(F.col("tag") >= low)
    return nodes if high is None else nodes.filter(F.col("tag") <= high)


def by_interval(nodes: DataFrame, of: Label, relation: str = "descendant", tag: str | None = None) -> DataFrame:
    """Nodes that stand in the relation to a literal node: same, child or descendant. The range of starts prunes the scan."""
    me = Label.of()
    tests = {"same": same, "child": is_child, "descendant": is_descendant}
    if relation not in tests:
        raise ValueError(f"no range of starts for {relation}")
    found = nodes.filter(F.col("start").between(of.start, of.end)).filter(tests[relation](me, of))
    return found if tag is None else by_tag(found, tag)


def index_only(nodes: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """The key column alone; ordered: in its order, which takes a sort of the whole column."""
    keys = nodes.select(key)
    return keys.orderBy(key) if ordered else keys


def in_tag_order(nodes: DataFrame) -> DataFrame:
    """All rows by tag, then document and start: a range sort of the table."""
    return nodes.orderBy("tag", "doc_id", "start")


_loaded: dict[tuple, str] = {}


def load_once(spark: SparkSession, name: str, sf_dir: str, build, by: str = "tag") -> DataFrame:
    """A node table that is built and stored (by tag, folder or interval) once in an application, like loading a database, and then queried.

    It is built again if the files under sf_dir have changed since.
    """
    key = (spark.sparkContext.applicationId, name, by, sf_dir, state(spark, sf_dir))
    if key not in _loaded:
        path = temporary(spark, f"{name}-by-{by}")
        {"tag": store_by_tag, "folder": store_by_folder, "interval": store_by_interval}[by](build(spark, sf_dir), path)
        _loaded[key] = path
    return read_folders(spark, _loaded[key]) if by == "folder" else read_nodes(spark, _loaded[key])
