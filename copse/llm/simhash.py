"""SimHash near-dedup with a bit-sliced comparison.

A fingerprint has a bit for each place: 1 if set in more than half of the hashes of the text's word shingles. Fingerprints
link at a radius or fewer differing bits; documents in one connected component are near-duplicates of one another.

op8 takes 64 bits of the XXH64 (seed 42) of four-word shingles, repeats included, and a radius of 4. Keys find every link:
the bits are cut into blocks, and two fingerprints within the radius agree on all blocks but RADIUS at least, so each choice
of that many blocks is a key.

dedup() is for pairs of a similarity, the Jaccard similarity of the sets of five-word shingles. One of 0.8 is too far for a
radius of 4 in 64 bits, so fingerprints have WORDS times 64 bits, from independent mixes of each shingle's hash. Two texts
of similarity j differ in a share acos(2 j / (1 + j)) / pi of the bits, and the radius is that of the wanted similarity and
MARGIN standard deviations more; in the first EARLY bits, early_radius() holds as well. Keys are slices of bits_of(n) bits, so many that such a pair shares one with a
probability of FOUND; for n times as many documents it takes about n ** 0.24 times as many. Texts of lesser similarity
link the more seldom the farther they are from it, unlike texts never do, and the README has measured shares.

Equal fingerprints are one node, however many documents share it. Nodes are put into buckets by keys. Inside a task the
buckets' fingerprints are stored as bit planes. One pass over the planes compares every fingerprint of 64 buckets with the
one `shift` places further on in its bucket, or some pivots of a large bucket with all others: differing bits are added up in carry-save counters, for 64 lanes a
machine word; a block of lanes is abandoned once all its distances exceed the radius. Large buckets are thinned: what lies
within the radius of a pivot joins its component and is compared as a pivot only. Buckets of more than TILE nodes are cut
into tiles, and pairs of tiles are separate tasks. A task gives back a forest of links, not all pairs; components follow by
alternating star contraction.

Defined results: texts without a word have fingerprint zero and link like any other; null counts as empty; repeated
doc_ids are separate rows with the same component; a null doc_id never names a component unless the component has no
other; an empty table gives an empty result; further columns pass through dedup() untouched.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.llm.common import LOWER_TABLE, discard, free_name, materialise, read, ship, without

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Words of 64 bits in the fingerprints of dedup().
WORDS = 8
#: Standard deviations of the distance by which the radius lies above that of the wanted similarity.
MARGIN = 1.8
#: Share of the pairs of just the wanted similarity that have a key in common.
FOUND = 0.97
#: Least bits of a slice, and expected nodes in a bucket of evenly spread fingerprints from which on slices are longer.
SLICE, SLICED = 10, 512
#: Bits after which unlike fingerprints of several words are first told apart, and the standard deviations that a pair within the radius is given.
EARLY, EARLY_MARGIN = 128, 5
#: Nodes of a bucket that one task compares with one another; beyond, pairs of tiles are compared.
TILE = 1 << 14
#: Words in a block that is abandoned as a whole; each has 64 lanes.
BLOCK_WORDS = 8
#: The same as SLICED for keys of blocks, from which on they take one more block.
BUCKET = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Rows whose bits are counted together in bytes.
_BYTE = 255


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(hashes, words): independent mixes of each 64-bit hash."""
    z = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, from the words' hashes; of all words if they are fewer."""
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + len(out)]
    return out


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows (rows, words) have each bit: a byte a bit, eight of them added at a time."""
    bits = np.unpackbits(np.ascontiguousarray(rows.astype("<u8")).view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return np.add.reduceat(bits, np.arange(0, len(rows), _BYTE), axis=0).view(np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, words: int = 0) -> list[int]:
    """Of UTF-8 text: one number of 64 bits, or `words` of them.

    With words, the shingles are a set, and a bit that is set in just half of them is as in the least hash: else texts of few
    shingles would have few bits set, and unlike ones would be near. Hashes are counted in bounded portions, so long texts
    need no more memory than their words.
    """
    found = _WORD.findall(text.translate(LOWER_TABLE))
    size = words or 1
    if not found:
        return [0] * size
    if words:
        hashes = np.unique(sequences(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), shingle))
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(found) > shingle:
            starts, ends = starts[: len(found) - shingle + 1], ends[shingle - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64 * size, np.int64)
    for at in range(0, len(hashes), 16 * _BYTE):
        part = hashes[at : at + 16 * _BYTE]
        counts += bit_counts(mixed(part, words) if words else part[:, None])
    set_ = 2 * counts > len(hashes)
    if words:
        least = np.unpackbits(mixed(hashes[:1], words).astype("<u8").view(np.uint8)[0], bitorder="little")
        set_ |= (2 * counts == len(hashes)) & (least == 1)
    return np.packbits(set_, bitorder="little").view("<u8").tolist()


def names(words: int) -> list[str]:
    """Columns of a fingerprint."""
    return [f"f{i}" for i in range(words or 1)]


def _fingerprints(shingle: int, words: int, text: str, called: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.simhash import fingerprint

        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle, words) for t in texts], np.uint64).reshape(-1, len(called)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.ascontiguousarray(f)) for f in found.T]], [*b.schema.names, *called])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """(doc_id, f0, f1, ...): the fingerprint as signed 64-bit integers."""
    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    called = names(words)
    return rows.mapInArrow(_fingerprints(shingle, words, "text", called), "doc_id long, text string, " + ", ".join(f"{f} long" for f in called)).drop("text")


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows, words): row b holds bit b of all of them, 64 lanes a word, with a word of padding."""
    n, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((64 * words, (-(-n // 64) + 1) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _add(one: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder for each lane: sum and carry."""
    x = a ^ b
    return one ^ x, (a & b) | (one & x)


def differences(left: np.ndarray, right: np.ndarray):
    """For within(): eight planes of the differing bits of left and right from a place on, of some words of lanes or all."""
    return lambda at, i: left[at : at + 8] ^ right[at : at + 8] if i is None else left[at : at + 8, i] ^ right[at : at + 8, i]


def within(differ, lanes: np.ndarray, total: int, radius: int = RADIUS, early: int | None = None) -> np.ndarray:
    """Lanes (a bit each) in which the differing bits of `total` planes are radius at most, and early at most in the first EARLY.

    Eight planes at a time go through carry-save adders into counters of radius.bit_length() bits at least; a count beyond
    them sticks. Now and then, blocks whose lanes all exceed the radius (or count for nothing in lanes) are abandoned.
    """
    each = 64 if total > 64 else 8  # planes between two looks at the counters
    alive, open_, out = None, lanes, np.zeros_like(lanes)
    counter = [np.zeros_like(lanes) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros_like(lanes)
    for at in range(0, total, 8):
        x = differ(at, alive)
        fours = []
        for half in (0, 4):
            counter[0], a = _add(counter[0], x[half], x[half + 1])
            counter[0], b = _add(counter[0], x[half + 2], x[half + 3])
            counter[1], c = _add(counter[1], a, b)
            fours.append(c)
        counter[2], carry = _add(counter[2], *fours)
        for k in range(3, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        done = at + 8
        if early is not None and done == EARLY:
            open_ = open_ & ~(over | exceeding(counter, early))
        elif done % each or done <= radius or done == total:
            continue
        busy = open_ & ~(over | exceeding(counter, radius))
        blocks = np.pad(busy, (0, -len(busy) % BLOCK_WORDS)).reshape(-1, BLOCK_WORDS).any(1)
        if not blocks.all():
            stay = np.flatnonzero(np.repeat(blocks, BLOCK_WORDS)[: len(busy)])
            if not len(stay):
                return out
            alive = stay if alive is None else alive[stay]
            open_, over, counter = open_[stay], over[stay], [c[stay] for c in counter]
    out[slice(None) if alive is None else alive] = open_ & ~(over | exceeding(counter, radius))
    return out


def exceeding(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, from its lowest bit on, is over radius."""
    over, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            over |= equal & counter[k]
            equal = equal & ~counter[k]
    return over


def lanes_of(mask: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(mask)
    found = np.flatnonzero(np.unpackbits(mask[words].view(np.uint8), bitorder="little"))
    return words[found >> 6] * 64 + (found & 63)


def packed(lanes: np.ndarray) -> np.ndarray:
    return np.packbits(lanes, bitorder="little").view("<u8")


def link_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, forest: Forest, radius: int = RADIUS, early: int | None = None) -> None:
    """Joins what lies within the radius inside each bucket. Buckets lie one after the other, the largest first.

    A bucket is one lane: 64 buckets of about one size lie side by side, and the n-th rows of all of them are one word. So
    the rows `shift` further on are the words `shift` further on, and planes are compared where they lie.
    """
    group = np.arange(len(sizes)) // 64
    high = sizes[::64]  # words of each group of lanes
    first = np.cumsum(high) - high
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - starts[bucket]
    slot = (first[group[bucket]] + place) * 64 + bucket % 64
    words = int(high.sum())
    row, after = np.zeros(words * 64, np.int64), np.full(words * 64, -1)
    row[slot], after[slot] = np.arange(len(fps)), sizes[bucket] - 1 - place
    spread = np.zeros((words * 64, fps.shape[1]), np.uint64)
    spread[slot] = fps
    p = planes(spread)
    for shift in range(1, int(high[0]) if len(high) else 0):
        n = int(high[: int(np.searchsorted(-high, -shift))].sum()) - shift  # words that groups of more than shift rows have
        lanes = packed(after[: n * 64] >= shift)
        for i in lanes_of(within(differences(p[:, :n], p[:, shift : n + shift]), lanes, len(p), radius, early)).tolist():
            forest.join(int(row[i]), int(row[i + 64 * shift]))


#: Pivots that are compared with a large bucket at a time.
PIVOTS = 128


def link_large(fps: np.ndarray, first: int, forest: Forest, radius: int = RADIUS, early: int | None = None) -> None:
    """The same for one large bucket, whose row 0 is the forest's member first.

    Pivots are compared with all open rows at once, side by side in the lanes. What lies within the radius of one closes,
    as its component is known, and becomes a pivot later on, so a component that is found whole is compared no more; the
    planes are packed anew when half of the rows are closed.
    """
    rows, open_, queue, seen = np.arange(len(fps)), np.ones(len(fps), bool), [], 0
    p = planes(fps)[:, : -(-len(fps) // 64)]
    while True:
        held = open_[rows]
        if not held.any():
            return
        if 2 * held.sum() < len(rows) and len(rows) > 1024:
            rows = rows[held]
            p, held = planes(fps[rows])[:, : -(-len(rows) // 64)], np.ones(len(rows), bool)
        # the first pivot of a bucket may hold most of it, so it goes alone
        take = 1 if seen == 0 else PIVOTS
        pivots, queue = queue[-take:], queue[:-take]
        seeds = np.flatnonzero(held)[: take - len(pivots)]
        open_[rows[seeds]] = False
        pivots += rows[seeds].tolist()
        seen += len(pivots)
        bits = np.unpackbits(np.ascontiguousarray(fps[pivots].astype("<u8")).view(np.uint8), axis=1, bitorder="little").T
        left, words = np.where(bits == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)), p.shape[1]

        def differ(at: int, i: np.ndarray | None, left=left, p=p, words=words) -> np.ndarray:
            if i is None:
                return (left[at : at + 8, :, None] ^ p[at : at + 8, None, :]).reshape(8, -1)
            return left[at : at + 8, i // words] ^ p[at : at + 8, i % words]

        ok = np.zeros(words * 64, np.uint8)
        ok[: len(rows)] = held
        mask = within(differ, np.tile(packed(ok), len(pivots)), len(p), radius, early)
        near = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(len(pivots), -1)[:, : len(rows)]
        hit = np.flatnonzero(near.any(0))
        if not len(hit):
            continue
        near = near[:, hit].astype(np.float32)
        shared = near @ near.T  # pivots with a near row in common
        for i, j in zip(*np.nonzero(np.triu(shared, 1)), strict=True):
            forest.join(first + pivots[i], first + pivots[j])
        for i, j in zip(near.argmax(0).tolist(), rows[hit].tolist(), strict=True):
            forest.join(first + pivots[i], first + j)
            if open_[j]:
                open_[j] = False
                queue.append(j)


#: Buckets of more nodes are searched one by one.
SMALL = 1024
#: Nodes whose planes are held at a time.
HELD = 1 << 17


def links(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, early: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links inside buckets of fingerprints (rows, words) that lie one after the other: the places (root, member) of each row that is no root."""
    starts = np.cumsum(sizes) - sizes
    forest = Forest(len(fps))
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        link_large(fps[a : a + n], a, forest, radius, early)
    order = np.argsort(-sizes, kind="stable")
    order = order[(sizes[order] <= SMALL) & (sizes[order] > 1)]
    if len(order):
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[order].tolist(), sizes[order].tolist(), strict=True)])
        inner = Forest(len(at))
        link_small(fps[at], np.cumsum(sizes[order]) - sizes[order], sizes[order], inner, radius, early)
        roots = inner.roots()
        for i in np.flatnonzero(roots != np.arange(len(at))).tolist():
            forest.join(int(at[roots[i]]), int(at[i]))
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return roots[moved], moved


def _links(radius: int, early: int | None):
    """Over batches (c, k, pair, id, f0, ...) in the order of the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.simhash import HELD, links

        def done(keys: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
            fps = np.stack(keys[4:], axis=1).view(np.uint64)
            a, b = links(fps, np.diff(np.concatenate([[0], cut, [len(fps)]])), radius, early)
            return pa.RecordBatch.from_arrays([pa.array(keys[3][a]), pa.array(keys[3][b])], ["a", "b"])

        def joined(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
            keys = [np.concatenate(c) for c in zip(*held, strict=True)]
            return keys, np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)) + 1

        held: list[tuple] = []
        n = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= HELD:
                keys, change = joined(held)
                if len(change):  # the last bucket may go on in the next batch
                    yield done([k[: change[-1]] for k in keys], change[:-1])
                    held = [tuple(k[change[-1] :] for k in keys)]
                    n = len(held[0][0])
                else:
                    held = [tuple(keys)]
        if n:
            yield done(*joined(held))

    return run


def key_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the keys: blocks of nearly equal width, and all choices of all but radius of them."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > BUCKET and blocks < radius + 4:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(block, blocks - radius)]


def differing(similarity: float) -> float:
    """Share of the bits in which two texts of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float, words: int = WORDS) -> int:
    """Distance that texts of the similarity keep within, but for a normal deviation of MARGIN."""
    n, p = 64 * words, differing(similarity)
    return int(n * p + MARGIN * math.sqrt(n * p * (1 - p)))


def early_radius(radius: int, words: int = WORDS) -> int:
    """Distance in the first EARLY bits beyond which a pair doesn't link; one at the radius goes beyond in less than one of a million cases."""
    p = radius / (64 * words)
    return int(EARLY * p + EARLY_MARGIN * math.sqrt(EARLY * p * (1 - p)))


def bits_of(n: int) -> int:
    return max(SLICE, math.ceil(math.log2(max(1, n / SLICED))))


def slices(n: int, similarity: float, words: int = WORDS) -> list[list[tuple[int, int]]]:
    """The keys for n fingerprints: slices of bits that don't overlap while there are any, then random bits of all words.

    A key is a list of (word, mask), whose masks have no bit in common.
    """
    bits = bits_of(n)
    count = math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - differing(similarity)) ** bits))
    rng, out = random.Random(bits), []
    for i in range(count):
        at, word = divmod(i, words)
        if (at + 1) * bits <= 64:
            out.append([(word, ((1 << bits) - 1) << (at * bits))])
            continue
        masks = [0] * words
        for b in rng.sample(range(64), bits):
            masks[rng.randrange(words)] |= 1 << b
        out.append([(w, m) for w, m in enumerate(masks) if m])
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(nodes: DataFrame, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(a, b): a forest, in each bucket, of the links between nodes (id, f0, ...), by id.

    Keys are blocks that no pair within the radius escapes, or, for fingerprints of several words, slices for pairs of a similarity.
    """
    ship(nodes.sparkSession)
    fps, n = [c for c in nodes.columns if c != "id"], nodes.count()
    masks = [[(0, m)] for m in key_masks(n, radius)] if similarity is None else slices(n, similarity, len(fps))
    bits = lambda key: reduce(Column.bitwiseOR, (F.col(fps[w]).bitwiseAND(F.lit(signed(m))) for w, m in key))
    keys = [F.struct(F.lit(i).alias("c"), bits(key).alias("k")) for i, key in enumerate(masks)]
    dealt = nodes.select("id", *fps, F.explode(F.array(*keys)).alias("key")).select("key.c", "key.k", "id", *fps)
    hot = materialise(dealt.groupBy("c", "k").count().filter(F.col("count") > TILE).select(F.col("c").alias("hc"), F.col("k").alias("hk"), F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "simhash-hot")
    pair = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = dealt.withColumn("pair", pair)
    else:
        mine, other = F.pmod(F.xxhash64("id"), F.col("tiles")), F.col("other").cast("long")
        dealt = dealt.join(hot, (F.col("c") == F.col("hc")) & (F.col("k") == F.col("hk")), "left")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)))
        dealt = dealt.withColumn("pair", F.when(F.col("tiles").isNull(), pair).otherwise(F.least(mine, other) * 2**31 + F.greatest(mine, other)))
    sorted_ = dealt.select("c", "k", "pair", "id", *fps).repartition("c", "k", "pair").sortWithinPartitions("c", "k", "pair")
    return sorted_.mapInArrow(_links(radius, None if similarity is None else early_radius(radius, len(fps))), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex v of edges (a, b) that is not the least of its component, by alternating stars."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        # each vertex u with its neighbours v; the small star looks at lesser neighbours only
        e = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # stored, so that adaptive execution can split the rows of a vertex that most edges share
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "simhash-stars")
        used.append(least)
        joined = both.join(least, F.col("u") == F.col("w"))
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now, before = materialise(edges.filter("a <> b").distinct(), "simhash-edges"), None
    used: list[DataFrame] = []
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before, last = state, now
        half = materialise(stars(now, True), "simhash-edges")
        now = materialise(stars(half, False), "simhash-edges")
        for table in (last, half, *used):
            discard(table)
        used.clear()


#: Nodes whose documents find their component by broadcast: the most frequent ones, if they have so many documents.
HOT, HOT_ROWS = 1000, 1000


def assign(prints: DataFrame, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(doc_id, f0, ..., label, component_id) for each row of a stored table (doc_id, f0, ...).

    label is the least id of a component's nodes, which no two components share, as they may share a doc_id.
    """
    fps = [c for c in prints.columns if c != "doc_id"]
    grouped = prints.groupBy(*fps).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "simhash-nodes")
    roots = components(near_pairs(nodes.select("id", *fps), radius, similarity))
    labelled = materialise(nodes.join(roots, nodes["id"] == roots["v"], "left").select(*fps, "least", "n", F.coalesce("root", "id").alias("label")), "simhash-labelled")
    # a stored table of the components of several nodes only: small, or met by a join whose hot keys can be split
    least = materialise(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("m")).filter("m > 1").drop("m"), "simhash-least")
    named = materialise(labelled.join(least, "label", "left").select(*fps, "n", "label", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    hot = named.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *fps).limit(HOT).select(*fps, "label", "component_id")
    columns = ["doc_id", *fps, "label", "component_id"]
    settled = prints.join(F.broadcast(hot), fps).select(*columns)
    rest = prints.join(F.broadcast(hot.select(*fps)), fps, "left_anti").join(named.select(*columns[1:]), fps).select(*columns)
    return settled.unionByName(rest)


def dedup(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays: the row with its least doc_id, of several such rows one with the least fingerprint.

    similarity: of the shingle sets of linked documents; None: 64 bits and the radius, as in op8.
    """
    ship(docs.sparkSession)
    words = 0 if similarity is None else WORDS
    prints = materialise(fingerprints(docs, shingle, doc_id, text, words), "simhash-prints")
    assigned = materialise(assign(prints, radius if similarity is None else radius_of(similarity), similarity), "simhash-assigned")
    keep = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if prints.groupBy("doc_id").count().filter("count > 1").isEmpty():
        losers = materialise(assigned.filter(~keep).select(F.col("doc_id").alias(free_name(docs.columns, "l_id"))), "simhash-losers")
        return without(docs, docs[doc_id].cast("long"), losers)
    # doc_ids repeat: fingerprints tell their rows apart
    fps = names(words)
    called, key = [free_name(docs.columns, f) for f in fps], free_name(docs.columns, "id")
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = T.StructType([*inner.schema.fields, *[T.StructField(f, T.LongType()) for f in fps]])
    full = inner.mapInArrow(_fingerprints(shingle, words, f"c{docs.columns.index(text)}", fps), schema).toDF(*docs.columns, *called)
    full = full.withColumn(key, F.col(doc_id).cast("long"))
    w_id, *w_fps = (free_name([*docs.columns, *called, key], f"w_{x}") for x in ("id", *fps))
    winners = assigned.filter(keep).groupBy("label").agg(F.min(F.struct(*fps)).alias("w"), F.first("component_id").alias("c")).select(F.col("c").alias(w_id), *[F.col(f"w.{f}").alias(w) for f, w in zip(fps, w_fps, strict=True)])
    same = full[key].eqNullSafe(F.col(w_id))
    for c, w in zip(called, w_fps, strict=True):
        same = same & (full[c] == F.col(w))
    return full.join(winners, same, "left_semi").dropDuplicates([key, *called]).drop(key, *called)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialise(fingerprints(read(spark, sf_dir, "documents")), "simhash-prints")
    return assign(prints).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
