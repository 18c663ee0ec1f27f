"""Mixture-controlled packing of token sequences.

Every source has a queue; deficit round-robin serves the queues window by window, so that each window of
WINDOW_SEQUENCES sequences holds the target proportions of tokens. What a source gets too little or too much of in
one window (a queue ran empty, whole tokens) is carried as its deficit into the next window, and over the border of a
block into the next block: a block's opening deficits follow from the totals of the blocks before it, so blocks are
packed in parallel and yet continue one another.

Documents are dealt to blocks by hash, which spreads hot sources, and a block has a bounded number of tokens; very
long documents are dealt in segments. Within a block all sequences are full but the last few: what is left over
is cut into sequences whose lengths are powers of two, so nothing is padded.

Defined results: a null or empty text is its end token alone; null sources form one queue; repeated rows are packed
once each; proportions that name no source of the data leave the order to the queues' lengths; an empty table gives an
empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.llm.bpe import byte_alphabet
from copse.llm.common import materialise, read, ship

LENGTH = 1024
WINDOW_SEQUENCES = 16
#: Tokens in a block, on average; a task holds one block at a time.
BLOCK_TOKENS = 1 << 21
#: Blocks whose running sums one task takes.
CHUNK = 1 << 12
#: Tokens of a document that stay together when it is dealt to blocks.
SEGMENT = 1 << 16
#: How byte-level BPE files of this kind split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\n -~\xa1-\xac\xae-\xff]*")


class ByteBPE:
    """Ids as the tokenizers library gives them.

    Texts of plain Latin-1 characters are encoded by tiktoken from the same vocabulary, which gives the same ids several
    times as fast; texts with other characters, or with special tokens, go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"  # of little-endian machines, as all that Spark runs on

    def encode(self, text: str) -> bytes:
        """Packed ids."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return array(self.code, self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        from copse.llm.packing import byte_bpe

        gc.disable()
        bpe, at = byte_bpe(path), 0
        tail = np.array([end], bpe.kind).tobytes()
        size = bpe.kind.itemsize
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                out: list[list] = [[], [], [], [], [], []]
                for d, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    ids = bpe.encode(t or "") + tail
                    n = len(ids) // size
                    for start in range(0, n, SEGMENT):
                        part = ids[start * size : (start + SEGMENT) * size]
                        for column, value in zip(out, (d, s, at, start, n, part), strict=True):
                            column.append(value)
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "source", "at", "start", "doc_tokens", "ids"])

    return run


def serve(lengths: np.ndarray, share: np.ndarray, deficit: np.ndarray, window: int) -> np.ndarray:
    """Deficit round-robin: what each queue gives to each window, as an array (windows, queues); every token is served."""
    left, deficit, out = lengths.astype(np.int64).copy(), deficit.astype(float).copy(), []
    while (total := int(left.sum())) > 0:
        room = min(window, total)
        deficit += share * room
        take = np.clip(np.floor(deficit + 1e-9), 0, left).astype(np.int64)
        if (over := int(take.sum()) - room) > 0:  # opening deficits exceed the window: the largest are served first
            for i in np.argsort(deficit, kind="stable"):
                cut = min(over, int(take[i]))
                take[i] -= cut
                over -= cut
                if not over:
                    break
        short = room - int(take.sum())
        while short > 0:  # queues ran empty, or fractions of tokens are left
            free = np.flatnonzero(left > take)
            weight = share[free] if share[free].sum() > 0 else left[free].astype(float)
            more = np.minimum(np.floor(short * weight / weight.sum()).astype(np.int64), (left - take)[free])
            if not more.any():
                best = free[np.argsort(take[free] - deficit[free], kind="stable")][:short]
                take[best] += 1
                short -= len(best)
                continue
            take[free] += more
            short -= int(more.sum())
        left -= take
        deficit -= take
        out.append(take)
    return np.array(out).reshape(-1, len(lengths))


def pack_block(queues: list[list[tuple]], share: np.ndarray, deficit: np.ndarray, kind: np.dtype, length: int = LENGTH, window: int = WINDOW_SEQUENCES * LENGTH) -> dict[str, np.ndarray]:
    """queues: of each source its rows (doc_id, start, doc_tokens, packed ids). Pieces in the order of the sequences."""
    rows = [r for q in queues for r in q]
    ids = np.frombuffer(b"".join(r[3] for r in rows), kind)
    sizes = np.array([len(r[3]) // kind.itemsize for r in rows], np.int64)
    begins = np.cumsum(sizes) - sizes
    of_queue = np.repeat(np.arange(len(queues)), [len(q) for q in queues])
    lengths = np.bincount(of_queue, sizes, len(queues)).astype(np.int64)
    taken = serve(lengths, share, deficit, window)
    until = np.cumsum(taken, axis=0) + (np.cumsum(lengths) - lengths)
    runs = np.stack([(until - taken).ravel(), until.ravel()], 1)
    runs = runs[runs[:, 1] > runs[:, 0]]
    n = runs[:, 1] - runs[:, 0]
    order = np.repeat(runs[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = np.repeat(np.arange(len(rows)), sizes)[order]
    total = len(order)
    tail, at = [], total // length * length
    for power in reversed(range(length.bit_length())):
        if (total - at) >> power & 1:
            tail.append(at)
            at += 1 << power
    opens = np.array([*range(0, total // length * length, length), *tail], np.int64)
    starts = np.unique(np.concatenate([opens, np.flatnonzero((np.diff(row) != 0) | (np.diff(order) != 1)) + 1]))
    piece = np.diff(np.append(starts, total))
    sequence = np.searchsorted(opens, starts, "right") - 1
    flat = memoryview(ids[order].astype("<u4").tobytes())
    at_row = row[starts]
    return {
        "doc_id": [rows[i][0] for i in at_row.tolist()],
        "start": np.array([r[1] for r in rows], np.int64)[at_row] + order[starts] - begins[at_row],
        "length": piece,
        "ids_crc32": [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), (starts + piece).tolist(), strict=True)],
        "doc_tokens": np.array([r[2] for r in rows], np.int64)[at_row],
        "sequence": sequence,
        "offset": starts - opens[sequence],
        "ids": lambda: [np.frombuffer(flat[4 * a : 4 * b], "<u4").astype(np.int32) for a, b in zip(starts.tolist(), (starts + piece).tolist(), strict=True)],
    }


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(kind: str, length: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.packing import NAMES, pack_block

        def done(block: int, shares: dict, queues: dict) -> pa.RecordBatch:
            names = sorted(queues, key=lambda s: (s is not None, s or ""))
            p = pack_block([queues[s] for s in names], np.array([shares[s][0] for s in names]), np.array([shares[s][1] for s in names]), np.dtype(kind), length, window)
            p["sequence_id"] = p["sequence"] + (block << 24)
            columns = [pa.array(p[k], pa.int64()) for k in NAMES]
            if with_ids:
                columns.append(pa.array(p["ids"](), pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [*NAMES, *["ids"] * with_ids])

        block, shares, queues = None, {}, {}
        for b in batches:
            for k, s, d, start, n, ids, share, deficit in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                if k != block:
                    if queues:
                        yield done(block, shares, queues)
                    block, shares, queues = k, {}, {}
                if ids is None:
                    shares[s] = (share, deficit)
                else:
                    queues.setdefault(s, []).append((d, start, n, ids))
        if queues:
            yield done(block, shares, queues)

    return run


def running(table: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """table with the sum of value over all lesser blocks that have the same keys, null being one of them.

    Sums run over CHUNK blocks at a time, and over the chunks' totals, so no task has a row for every block.
    """
    chunk, base = f"_{name}_chunk", f"_{name}_base"
    cut = table.withColumn(chunk, F.floor(F.col("block") / CHUNK))
    before = lambda column, order, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    totals = cut.groupBy(*keys, chunk).agg(F.sum(value).alias(base))
    totals = totals.select(F.col(chunk).alias("_at"), *[F.col(k).alias(f"_of_{k}") for k in keys], before(base, chunk, *keys).alias(base))
    same = F.col(chunk) == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = cut.withColumn(name, before(value, "block", *keys, chunk))
    return inside.join(totals, same).withColumn(name, F.col(name) + F.col(base)).select(*table.columns, name)


def pack(docs: DataFrame, path: str, targets: dict[str, float] | None = None, end: int = 0, length: int = LENGTH, window: int = WINDOW_SEQUENCES, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence.

    targets: proportions of sources; None: those of the whole corpus. with_ids adds the piece's ids.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string"))
    tokens = materialise(rows.mapInArrow(_tokenise(path, end), "doc_id long, source string, at long, start long, doc_tokens long, ids binary"), "pack-tokens", compression="zstd")
    kind = byte_bpe(path).kind
    size = F.octet_length("ids") / kind.itemsize
    total = tokens.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_TOKENS))
    dealt = tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "at"), F.lit(blocks)))
    totals = materialise(dealt.groupBy("block", "source").agg(F.sum(size).alias("n")), "pack-totals")
    if targets is None:
        share = totals.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        weight = sum(targets.values()) or 1.0
        given = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v / weight))]) if targets else F.lit(None)
        share = totals.select("source").distinct().withColumn("share", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)) if targets else F.lit(0.0))
    served = running(totals, "n", "served", "source")
    passed = running(totals.groupBy("block").agg(F.sum("n").alias("n")), "n", "passed").select("block", "passed")
    carried = served.join(passed, "block").join(share.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    none = F.lit(None)
    opening = carried.select("block", "source", none.cast("long").alias("doc_id"), none.cast("long").alias("start"), none.cast("long").alias("doc_tokens"), none.cast("binary").alias("ids"), "share", (F.col("share") * F.col("passed") - F.col("served")).alias("deficit"), F.lit(0).alias("order"))
    body = dealt.select("block", "source", "doc_id", "start", "doc_tokens", "ids", none.cast("double").alias("share"), none.cast("double").alias("deficit"), F.lit(1).alias("order"))
    union = opening.unionByName(body).repartition("block").sortWithinPartitions("block", "order", "source", F.xxhash64("doc_id"), "doc_id", "start")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return union.drop("order").mapInArrow(_pack(kind.str, length, window * length, with_ids), schema)


def op2_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
