"""A corpus pipeline of five stages: language ID, exact dedup, SimHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the shared
folder and reads it again as the next one's documents. All stages but the last return the columns of documents; the
last returns one row for each piece of a document in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import exact_dedup, langid, packing, pii, simhash
from copse.llm.common import materialise, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or ambiguous go; the others get a language where they had none.

    Without any labelled document, only texts without a letter are unknown.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    known = langid.predict(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("personal data", personal_data),
    ("packing", pack),
]

#: SQL has neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
