"""Language identification with error-correcting output codes.

Every language has a codeword; each bit of it is predicted by a binary classifier over hashed character n-grams, a
logistic regression on their relative frequencies. Decoding weighs each bit's logistic loss by how well that bit was
learned and takes the codeword of least loss. The score is the softmax of the negative losses at that codeword; a text
is flagged as ambiguous if the second best codeword is nearly as near.

The classifiers are fitted on a bounded sample of labelled rows (MAX_ROWS, dealt evenly to the languages, chosen by a
hash of the doc_id). Only features leave the executors, at most BUCKETS numbers a row. Prediction reads whole texts.

Defined results: null texts, and texts without a letter, are `und` with score 0; without any labelled row every text is
`und`; with one language every text with a letter is that language; null labels are not learned from; repeated rows are
predicted alike; an empty table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import read, ship

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Most labelled rows that the classifiers are fitted on.
MAX_ROWS = 2400
#: Steps of the fit.
STEPS = 150
#: Score under which a text is ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"
#: Bytes of lower-case UTF-8 that stay; all others are one gap.
_KEEP = np.zeros(256, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one a language: all ways to part up to 5 languages in two; beyond, bits of hashed codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        parts = [p for p in itertools.product((1, -1), repeat=n) if p[0] == 1 and -1 in p]
        return np.array(parts, float).T
    bits = max(15, 4 * int(np.ceil(np.log2(n))) + 7)
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(60):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (code[:, None] != code[None]).sum(2)
        apart[np.arange(n), np.arange(n)] = bits
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, int(apart.min())
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, and where each text's begin (an end follows the last)."""
    data = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    raw = _KEEP[np.frombuffer(b"".join(data), np.uint8)]
    gap = raw == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # runs of gaps are one
    last = np.cumsum(sizes) - 1
    keep[last - sizes + 1] = keep[last] = True
    x = raw[keep].astype(np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)[keep]
    n = np.bincount(of, minlength=len(texts))
    # every position but a text's last yields one n-gram of each order; none reaches beyond that gap and the next text's first
    pad = np.concatenate([x, np.zeros(max(ORDERS), np.uint32)])
    out, h = [], np.zeros(len(x), np.uint32)
    for order in ORDERS:
        h = (h * _MIX[0]) ^ (pad[order - 1 : order - 1 + len(x)] + np.uint32(257 * order)) * _MIX[1]
        g = (h ^ (h >> np.uint32(15))) * _MIX[2]
        out.append(((g >> np.uint32(13)) ^ g) & np.uint32(BUCKETS - 1))
    own = np.ones(len(x), bool)
    own[np.cumsum(n) - 1] = False
    return np.stack(out)[:, own], np.concatenate([[0], np.cumsum(n - 1)])


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.weights, self.bias, self.trust = langs, weights.astype(np.float32), bias, trust
        self.code = codewords(len(langs))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text and bit."""
        g, ends = grams(texts)
        out = np.zeros((len(texts), self.weights.shape[1]))
        n = np.maximum(np.diff(ends), 1)
        for order in g:
            for at in range(0, len(order), 1 << 20):  # sums of portions, so long texts stay small
                w = self.weights[order[at : at + (1 << 20)]]
                first = int(np.searchsorted(ends, at, "right")) - 1
                cuts = ends[first : int(np.searchsorted(ends, at + len(w), "left"))].clip(at) - at
                sums = np.add.reduceat(w, cuts, axis=0)
                out[first : first + len(cuts)] += np.where((np.diff(np.append(cuts, len(w))) > 0)[:, None], sums, 0)
        return out / n[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if spoken and self.langs:
            f = self.margins([texts[i] for i in spoken])
            loss = (self.trust * np.logaddexp(0, -f[:, None, :] * self.code[None])).sum(2)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            for i, k, s in zip(spoken, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                out[i] = (self.langs[k], s)
        return out


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, buckets, frequencies. Logistic regression of all bits at once, full batches, Adam."""
    langs = sorted({r[0] for r in rows})
    code = codewords(len(langs))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, b, v) in enumerate(rows):
        x[i, b] = v
    at = np.array([langs.index(r[0]) for r in rows], int)
    y = code[at].astype(np.float32) if rows else np.zeros((0, 1), np.float32)
    share = np.bincount(at, minlength=len(langs)).astype(np.float32)
    weight = (1 / share[at] / len(langs))[:, None].astype(np.float32) if rows else y
    w, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = (np.zeros_like(z) for z in (w, w, bias, bias))
    for t in range(1, STEPS + 1 if len(langs) > 1 else 1):
        f = x @ w + bias
        g = -y / (1 + np.exp(y * f)) * weight
        dw, db = x.T @ g + 1e-7 * w, g.sum(0)
        for z, d, first, second, rate in ((w, dw, m, v, 3.0), (bias, db, mb, vb, 0.05)):
            first *= 0.9
            first += 0.1 * d
            second *= 0.99
            second += 0.01 * d * d
            z -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    right = ((x @ w + bias) * y > 0).mean(0) if rows else np.ones(1)
    trust = np.log((right + 1e-3) / (1 - right + 1e-3)) if len(langs) > 1 else np.ones(1)
    trust = np.maximum(trust, 0.05)
    return Model(langs, w, bias, trust / trust.mean())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from copse.llm.langid import BUCKETS, grams

    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        buckets, values = [], []
        for t in texts:
            g, _ = grams([t])
            counts = np.bincount(g.ravel(), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            buckets.append(at.astype("<u2").tobytes())
            values.append((counts[at] / g.shape[1]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], ["lang", "spread", "h", "buckets", "values"])


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """labelled: doc_id, text, lang. About max_rows rows are used, by the least hashes of doc_id in each language.

    Never more than twice as many, however often doc_ids repeat: then those with the least hashes of doc_id and text.
    """
    ship(labelled.sparkSession)
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    each = max(1, max_rows // len(counts))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (spread < int(min(1.0, each / n) * (1 << 30))))
    picked = usable.filter(wanted).select("lang", "text", spread.alias("spread"), F.xxhash64("text", "lang").alias("h"))
    rows = picked.mapInArrow(_features, "lang string, spread long, h long, buckets binary, values binary").orderBy("spread", "h").limit(2 * max_rows).collect()
    return fit([(r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["values"], "<f4")) for r in sorted(rows, key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["values"])))])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    ship(docs.sparkSession)
    from pyspark.sql import types as T

    added = ["lang_pred", "score", "ambiguous"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                found = shared.value.predict(b.column(b.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < AMBIGUOUS for _, s in found], pa.bool_())], [*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
