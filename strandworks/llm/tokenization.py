"""Encoding a corpus with a public byte-level BPE vocabulary.

Two tiers resolve a pre-token.  A minimal perfect hash over the vocabulary finds
those that are tokens as a whole; it is built once on the driver, has exactly one
slot per token, and a batch's distinct pre-tokens go through it as arrays.  The
others are merged from their bytes: the pieces form a linked list, and a heap
yields the adjacent pair of least rank until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from strandworks.plans.spread import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary splits a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Resolved pre-tokens a worker remembers before it starts anew, and the longest of
#: them; both bound memory only.
MEMO, MEMO_CHARS = 1 << 16, 24


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """Tokens by id from a file of ``base64 id`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


def _mix(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over hash and seed, as arrays."""
    x = h ^ (np.atleast_1d(seed) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots.

    Keys fall into n buckets; from the largest down, a bucket gets the first seed
    that sends its keys to free slots, and a bucket of one gets a free slot itself,
    stored as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashes = self.hash(keys)
        home = (hashes % np.uint64(n)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(n + 1))
        sizes = np.diff(bounds)
        self.seeds = np.zeros(n, np.int64)
        self.slots = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) < 2:
                break
            seed = 1
            while True:
                at = (_mix(hashes[members], np.uint64(seed)) % np.uint64(n)).astype(np.int64)
                if not taken[at].any() and len(set(at.tolist())) == len(at):
                    break
                seed += 1
            taken[at], self.seeds[b], self.slots[at] = True, seed, members
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.seeds[single] = -free[: len(single)] - 1
        self.slots[free[: len(single)]] = order[bounds[single]]

    @staticmethod
    def hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only index it can have; the caller compares the key."""
        h = self.hash(keys)
        seed = self.seeds[(h % np.uint64(self.n)).astype(np.int64)]
        far = (_mix(h, np.maximum(seed, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return self.slots[np.where(seed < 0, -seed - 1, far)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token by merging the adjacent pair of least rank,
    leftmost first, in n log n."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        j = after[i]
        if j >= n or end[i] < 0 or end[j] != stop or end[i] != j:
            continue  # one of the two was merged in the meantime
        end[i], end[j] = stop, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                push(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            push(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids; keeps what it has resolved."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str = PATTERN):
        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def resolve(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        keys = [w.encode() for w in words]
        tokens, ranks = self.tokens, self.ranks
        found = self.table.lookup(keys).tolist()
        return {w: (i,) if tokens[i] == key else tuple(merge_bytes(key, ranks)) for w, key, i in zip(words, keys, found)}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """One list of ids per text; the empty list for null and empty."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = self.resolve(list({w for words in split for w in words}.difference(self.memo)))
        self.memo.update((w, ids) for w, ids in new.items() if len(w) <= MEMO_CHARS)
        new.update((w, self.memo[w]) for words in split for w in words if w not in new)
        return [[i for w in words for i in new[w]] for words in split]


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``(key, ids array<int>)`` of every row; map-only, but that a table
    too small to fill all cores is spread over them first.

    * Null and empty texts give the empty list; no text is cut.
    * Strings of special tokens are ordinary text.
    * Repeated keys give repeated rows; other columns are not read.

    The vocabulary (a file of fixed size, well under 100,000 tokens) and its hash
    are broadcast; texts stay in their partitions.
    """
    tokens = read_vocabulary(vocabulary)
    if len(tokens) > 1_000_000:
        raise ValueError("a vocabulary of more than a million tokens is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return spread(docs.select(key, text), key, 2).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(rows: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)``: the texts that rows of ids stand for; null for null, bytes that are
    no UTF-8 replaced.  An id outside the vocabulary raises."""
    tokens = read_vocabulary(vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = [None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
