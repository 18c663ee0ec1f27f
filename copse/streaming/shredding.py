"""Streams of documents as streams of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.sources.layout import folder_of
from copse.sources.xml import WIDTH, shred


def shred_stream(documents: DataFrame, kind: str = "xml", width: int | None = WIDTH) -> DataFrame:
    """The nodes of a stream of documents (doc_id, text). Stateless: a document is whole, so its labels need no other row."""
    if not documents.isStreaming:
        raise ValueError("documents is no stream")
    return shred(documents, kind, width)


def store_stream(nodes: DataFrame, path: str, checkpoint: str):
    """Appends a stream of nodes to a table by folder (see layout), as their texts are tags; files are written exactly once."""
    dealt = nodes.withColumn("folder", folder_of(F.col("tag")))
    return dealt.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("folder").outputMode("append")
