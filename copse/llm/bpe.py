"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match over the vocabulary. A sequence of tokens is what the merges
yield exactly when every adjacent pair is: replaying the merges, no merge ever joins a part of the left token with a
part of the right one. That test runs in numpy over all adjacent pairs of all new words at once; only words with a
failing pair are merged exactly, side by side, a merge a word at a time. Proposals, tests and results are kept per word.

Normalisation and splitting follow the tokenizer file: NFC, white space to blanks, lower case, split into
contractions, letters, single digits and other marks, then bytes as printable characters. Texts of plain Latin-1
characters take a short way; any other text is normalised and split by the tokenizers library itself.

Defined results: null and empty texts have no token (n_tokens 0, digests of the empty string); the strings of special
tokens inside a text give those tokens, as the library does; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import read, ship

#: Entries in each of the two generations that a worker keeps; the older one goes when the newer one is full.
CACHE = 350_000
#: Characters for which Python's lower(), split() and the pattern below agree with the library.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xff]*")
_NO_MERGE = int(np.iinfo(np.int64).max)
_NONE = (_NO_MERGE, -1)
#: Symbols from which on merging uses a heap.
LONG_WORD = 400
#: Symbols of words that are merged side by side.
MERGED = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class WordBPE:
    """Encodes one word at a time with the vocabulary of a tokenizer file that marks word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.alphabet = byte_alphabet()
        self.map = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        n = len(self.vocab)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y = self.vocab[a], self.vocab[b]
            self.rank.setdefault((x, y), (r, self.vocab[a + b]))
        keys = np.array([x * n + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank, self.n = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order], n
        self.yields = np.zeros(max((r for r, _ in self.rank.values()), default=0) + 1, np.int64)
        for r, made in self.rank.values():
            self.yields[r] = made
        #: Ids of base symbols by character, inside a word and at its end; -1: not in the vocabulary.
        self.inner, self.final = (np.array([self.vocab.get(chr(c) + e, -1) for c in range(512)], np.int64) for e in ("", self.end))
        # How the merges build each token: its last merge and the two parts. -1: a base token, or one that merges never yield.
        self.made, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        whole: dict[int, bool] = {}
        for t, i in sorted(self.vocab.items(), key=lambda x: len(x[0])):
            ids, last = self.merge(self.pieces(t), trace=True)
            whole[i] = len(ids) == 1
            if last:
                self.made[i], self.left[i], self.right[i] = last
        self.automaton, self.length = ahocorasick.Automaton(), np.zeros(n, np.int64)
        for t, i in self.vocab.items():
            if whole[i]:  # a line feed stands for the word's end; no mapped byte is one
                shown = t[: -len(self.end)] + "\n" if t.endswith(self.end) else t
                self.length[i] = len(shown)
                self.automaton.add_word(shown, i)
        self.automaton.make_automaton()
        self.kind = np.dtype("<u2" if max(self.token) < 1 << 16 else "<u4")
        self.texts = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.numbers = [str(i) for i in range(len(self.texts))]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        import regex

        self.split = regex.compile(split)
        self.exact_merges = 0
        #: Ids, packed, of pieces of normalised text without white space, in two generations.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, token: str) -> list[str]:
        """A vocabulary entry as base symbols."""
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str], trace: bool = False):
        """Exact merging: the merge of least rank first, the leftmost of equals."""
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        if len(ids) > LONG_WORD and not trace:
            return self.merge_long(ids)
        rank, last = self.rank, None
        ranks = [rank.get(p, _NONE)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == _NO_MERGE:
                break
            i = ranks.index(r)
            last = (r, ids[i], ids[i + 1])
            ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), _NONE)[0]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), _NONE)[0]
        return (ids, last if len(ids) == 1 else None) if trace else ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """merge() by a heap, for words of thousands of symbols."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.rank[x, y][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, *p))
        return [x for x in ids if x >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the merges of pairs of tokens; _NO_MERGE where there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NO_MERGE)

    def merge_many(self, words: list[str]) -> list[np.ndarray]:
        """merge() for many words of mapped bytes: all of their symbols in one array, and one merge in each word at a time."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths) - 1
        ids, of = self.inner[codes], np.repeat(np.arange(len(words)), lengths)
        ids[last] = self.final[codes[last]]
        ids, of = ids[ids >= 0], of[ids >= 0]
        rank = np.full(len(ids), _NO_MERGE)  # of each symbol with the next one in its word
        inside = np.flatnonzero(of[1:] == of[:-1])
        rank[inside] = self.ranks(ids[inside], ids[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = least == _NO_MERGE
            if over.any():
                done.append((of[over], ids[over]))
                ids, of, rank, least = ids[~over], of[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            at = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]  # the leftmost one of each word
            ids[at] = self.yields[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, of, rank = ids[stay], of[stay], rank[stay]
            at = at - np.arange(len(at))
            new = np.concatenate([at, at[at > 0] - 1])
            new = new[new + 1 < len(ids)]
            joined = of[new] == of[new + 1]
            rank[at] = _NO_MERGE
            rank[new[joined]] = self.ranks(ids[new[joined]], ids[new[joined] + 1])
        if not done:
            return [np.zeros(0, self.kind)] * len(words)
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return np.split(ids[order].astype(self.kind), np.searchsorted(of[order], np.arange(1, len(words))))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave a boundary between tokens a and b, for arrays of pairs.

        Walks back in time from the finished tokens: the part made last is taken apart, on the left to its right half,
        on the right to its left half. At each step the two parts face each other until one of them is used up; a
        merge of the two with an earlier rank (on equal ranks the leftmost goes first) would cross the boundary.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), _NO_MERGE), np.full(len(a), _NO_MERGE)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks(x, y)
            crossed = (rank < until_a[live]) & (rank <= until_b[live]) & (rank != _NO_MERGE)
            good[live[crossed]] = False
            ma, mb = self.made[x], self.made[y]
            live_next = ~crossed & ((ma >= 0) | (mb >= 0))
            on_left = live_next & (ma > mb)
            on_right = live_next & ~on_left
            la, lb = live[on_left], live[on_right]
            until_a[la], a[la] = ma[on_left], self.right[x[on_left]]
            until_b[lb], b[lb] = mb[on_right], self.left[y[on_right]]
            live = live[live_next]
        return good

    def learn(self, words: list[str]) -> list[bytes]:
        """The packed ids of words of mapped bytes: all are proposed and tested at once, the failing ones merged exactly."""
        if not words:
            return []
        found = np.array(list(self.automaton.iter_long("\n".join(words) + "\n")), np.int64).reshape(-1, 2)
        ends, ids = found[:, 0], found[:, 1]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        of = np.searchsorted(np.cumsum(lengths) - 1, ends)
        good = np.bincount(of, self.length[ids], len(words)) == lengths  # greedy matching found no gap
        beside = np.flatnonzero(of[1:] == of[:-1])
        pairs, which = np.unique(ids[beside] * self.n + ids[beside + 1], return_inverse=True)
        fits = self.compatible(pairs // self.n, pairs % self.n)[which]
        good[of[beside[~fits]]] = False
        starts, packed, size = np.searchsorted(of, np.arange(len(words) + 1)).tolist(), ids.astype(self.kind).tobytes(), self.kind.itemsize
        failing = [i for i, ok in enumerate(good.tolist()) if not ok]
        self.exact_merges += len(failing)
        out = [packed[size * a : size * b] for a, b in zip(starts, starts[1:], strict=False)]
        portion: list[int] = []
        symbols = 0
        for i in failing:
            w = words[i]
            if len(w) > LONG_WORD:
                out[i] = np.array(self.merge([*w[:-1], w[-1] + self.end]), self.kind).tobytes()
                continue
            portion.append(i)
            symbols += len(w)
            if symbols > MERGED:
                self._settle(words, portion, out)
                portion, symbols = [], 0
        self._settle(words, portion, out)
        return out

    def _settle(self, words: list[str], portion: list[int], out: list[bytes]) -> None:
        for i, merged in zip(portion, self.merge_many([words[i] for i in portion]) if portion else [], strict=True):
            out[i] = merged.tobytes()

    def mapped(self, word: str) -> str:
        if word.isascii():
            return word
        return "".join([self.alphabet[b] for b in word.encode()])

    def fill(self, chunks: set[str]) -> None:
        """Makes known hold these pieces of normalised text without white space."""
        if len(self.known) + len(chunks) > CACHE:
            self.older, self.known = self.known, {}
        known, older, split, words = self.known, self.older, {}, {}
        for c in chunks:
            if c in older:
                known[c] = older[c]
                continue
            ws = [c] if c.isascii() and c.isalpha() else [self.mapped(w) for w in self.split.findall(c)]
            split[c] = ws
            words.update(dict.fromkeys(ws, b""))
        for w in words:
            if len(w) < 64 and w in known and w.isalpha() and w.isascii():
                words[w] = known[w]
        new = [w for w, ids in words.items() if not ids]
        words.update(zip(new, self.learn(new), strict=True))
        for c, ws in split.items():
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def words_of(self, text: str) -> list[list[str] | int]:
        """Any text as runs of mapped words and ids of special tokens between them, split by the library."""
        out: list = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                out.append([w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)])
        return out

    def encode(self, text: str) -> list[int]:
        """Any text, normalised and split by the library."""
        ids: list[int] = []
        for run in self.words_of(text):
            if isinstance(run, int):
                ids.append(run)
                continue
            words = list(dict.fromkeys(run))
            of = dict(zip(words, self.learn(words), strict=True))
            ids += np.frombuffer(b"".join([of[w] for w in run]), self.kind).tolist()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder; the library then joins the tokens by blanks."""
        return " ".join(map(self.texts.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        plain = [t.lower().split() if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        out: list[list[int]] = []
        for i, chunks in enumerate(plain):
            if chunks is None:
                out.append(self.encode(texts[i]))
                continue
            try:
                packed = b"".join(map(self.known.__getitem__, chunks))
            except KeyError:
                if len(chunks) > CACHE // 2:
                    out.append(self.encode(texts[i]))
                    continue
                new, held = set(chunks), len(chunks)
                for more in plain[i + 1 :]:
                    if held + len(more or ()) > CACHE // 2:
                        break
                    held += len(more or ())
                    new.update(more or ())
                self.fill({c for c in new if c not in self.known})
                if missing := {c for c in chunks if c not in self.known}:  # a new generation began meanwhile
                    self.fill(missing)
                packed = b"".join(map(self.known.__getitem__, chunks))
            out.append(np.frombuffer(packed, self.kind).tolist())
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts by a few hundred, without pauses of the collector, which would walk the caches again and again."""
    gc.disable()
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            b = whole.slice(start, 512)
            yield b.column(0), [t or "" for t in b.column(1).to_pylist()]
        gc.collect(0)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.bpe import word_bpe

        bpe, sha = word_bpe(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for ids, texts in _batches(batches):
            rows = [(len(x), sha(bpe.written(x)), sha(bpe.decode(x))) for x in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.string()), pa.array([d for _, _, d in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.bpe import word_bpe

        bpe = word_bpe(path)
        for ids, texts in _batches(batches):
            rows = bpe.encode_all(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32())), pa.array(map(bpe.decode, rows), pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each document."""
    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_ids(path), f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() with digests in place of ids and text, which are made where the ids are and never leave the task."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_digests(read(spark, sf_dir, "documents"), path)
