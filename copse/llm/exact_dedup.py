"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Digests (SHA-256) stand for texts.
Misra-Gries summaries, one a partition and merged by key, name every digest that more than N / (k + 1) of the N rows
may hold. Their true counts are then taken (verified), and the at most k winners are broadcast, so that their rows
are settled on the map side. The remaining digests, none of them frequent, go through an ordinary shuffle.

Defined results:
- null or empty text: the empty text, so all such rows are one group;
- ties: of equal texts the row with the largest doc_id stays; a null doc_id loses against any other;
- repeated rows (same doc_id, same text): one document, all its rows are marked alike by decide(); dedup() returns one;
- empty table: empty result; further columns, whatever their names, pass through dedup() untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.llm.common import LOWER_TABLE, discard, free_name, materialise, read, ship, without

#: Counters of one Misra-Gries summary; also the most rows that are ever broadcast.
COUNTERS = 2048


def _with_digest(text: str, name: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            at = b.schema.get_field_index(text)
            out = pa.array([sha((t.as_py() or b"").translate(LOWER_TABLE)).digest() for t in b.column(at).cast(pa.binary())], pa.binary())
            kept = [i for i in range(b.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), out], [*(b.schema.names[i] for i in kept), name])

    return run


def with_digest(docs: DataFrame, text: str = "text", name: str = "digest", keep_text: bool = True) -> DataFrame:
    """docs with the SHA-256 of each normalised text; the text column has to be the only one of its name.

    Without keep_text the digest takes the text's place, so that no text travels back from Python.
    """
    ship(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema.fields if keep_text or f.name != text), T.StructField(name, T.BinaryType())])
    return docs.mapInArrow(_with_digest(text, name, keep_text), schema)


def merge_counts(counts: dict, k: int) -> dict:
    """The Misra-Gries reduction: no more than k counters stay, each lowered by the (k + 1)th largest."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def _summary(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = pc.value_counts(b.column(0))
            for d, c in zip(v.field("values").to_pylist(), v.field("counts").to_pylist(), strict=True):
                counts[d] = counts.get(d, 0) + c
            counts = merge_counts(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "least"])

    return run


def heavy_hitters(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, n, keep_id) of every digest that more than 2 N / (k + 1) of the N rows hold, at most k rows.

    A merged counter falls short of the true count by N / (k + 1) at most, so the k largest counters hold them all.
    """
    ship(digests.sparkSession)
    least = digests.select("digest").mapInArrow(_summary(k), "digest binary, least long").groupBy("digest").agg(F.sum("least").alias("least"))
    candidates = least.orderBy(F.desc("least"), "digest").limit(k).select("digest")
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    floor = max(32, 2 * digests.count() // (k + 1))
    return counted.filter(F.col("n") > floor)


def decide(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of a stored table (doc_id, digest)."""
    heavy = materialise(heavy_hitters(digests, k).coalesce(1), "dedup-heavy")
    settled = digests.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"))
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    shuffled = rest.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return settled.unionByName(shuffled).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def digest_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return materialise(with_digest(rows, keep_text=False), "dedup-digests")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with the columns they came with.

    Where doc_ids are unique, they tell which rows go, and nothing else of a document is read again or joined. Where some
    repeat, digests tell rows apart, and only losers are joined against, so no frequent text is shuffled.
    """
    digests = digest_table(docs, doc_id, text)
    decided = materialise(decide(digests, k), "dedup-decided")
    if digests.groupBy("doc_id").count().filter("count > 1").isEmpty():
        losers = materialise(decided.filter(~F.col("kept")).select(F.col("doc_id").alias(free_name(docs.columns, "l_id"))), "dedup-losers")
        return without(docs, docs[doc_id], losers)
    name, h_digest, h_keep, l_digest, l_id, r_digest, r_id = (free_name(docs.columns, x) for x in ("digest", "h_digest", "h_keep", "l_digest", "l_id", "r_digest", "r_id"))
    full = with_digest(docs, text, name)
    heavy = decided.filter(~F.col("kept")).groupBy("digest").agg(F.count("*").alias("n"), F.max("keep_id").alias("keep")).orderBy(F.desc("n"), "digest").limit(k)
    heavy = materialise(heavy.select(F.col("digest").alias(h_digest), F.col("keep").alias(h_keep)).coalesce(1), "dedup-removal")
    first = full.join(F.broadcast(heavy), full[name] == F.col(h_digest), "left").filter(F.col(h_digest).isNull() | full[doc_id].eqNullSafe(F.col(h_keep))).drop(h_digest, h_keep)
    losers = decided.filter(~F.col("kept")).join(F.broadcast(heavy), F.col("digest") == F.col(h_digest), "left_anti").select(F.col("digest").alias(l_digest), F.col("doc_id").alias(l_id)).distinct()
    left = first.join(losers, (first[name] == F.col(l_digest)) & first[doc_id].eqNullSafe(F.col(l_id)), "left_anti")
    repeated = materialise(decided.filter("kept").groupBy("digest", "doc_id").count().filter("count > 1").select(F.col("digest").alias(r_digest), F.col("doc_id").alias(r_id)), "dedup-repeated")
    if repeated.isEmpty():
        discard(repeated)
        return left.drop(name)
    same = (left[name] == F.col(r_digest)) & left[doc_id].eqNullSafe(F.col(r_id))
    once = left.join(repeated, same, "left_semi").dropDuplicates([name, doc_id])
    return left.join(repeated, same, "left_anti").unionByName(once).drop(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decide(digest_table(read(spark, sf_dir, "documents")))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.translate(F.hex("digest"), "ABCDEF", "abcdef").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
