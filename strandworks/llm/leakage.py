"""Passages of held-out texts inside a corpus, found with an FM-index per shard.

A shard is a bounded run of normalised documents within one task.  Its suffix
array gives the Burrows-Wheeler transform, kept as a wavelet tree (in matrix
layout) with rank directories; every window of a held-out text is searched
backwards, all windows at once as arrays, and what is found is located by
walking back to sampled suffix positions.  Hits next to each other merge into
the spans to remove.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandworks.plans.spread import spread

WINDOW = 32
#: Normalised characters of a shard; longer documents are cut into overlapping
#: pieces, so that no window is lost.  Three ranks of its suffixes fit into 63 bits.
SHARD_CHARS = 2_000_000
SAMPLE = 32
#: Held-out windows searched at a time, of 4 bytes a character: 32 MB.  Each index
#: meets all blocks of windows in turn.
BLOCK_WINDOWS = 1 << 18
#: Held-out characters that go to the tasks at a time; more are searched in rounds.
ROUND_CHARS = 1 << 24


class _Letters:
    """By code point: whether it is a letter or digit, and how many of the characters of
    its lower-case form are; filled in for those met."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.kept = np.zeros(0x110000, bool)
        self.count = np.zeros(0x110000, np.uint8)

    def meet(self, points: np.ndarray) -> None:
        new = ~self.known[points]
        for c in np.unique(points[new]).tolist():
            self.kept[c] = unicodedata.category(chr(c))[0] in "LN"
            self.count[c] = sum(unicodedata.category(x)[0] in "LN" for x in chr(c).lower())
            self.known[c] = True


_LETTERS = _Letters()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def normalise_all(texts: list[str | None]) -> list[np.ndarray]:
    """Code points of each text in lower case, letters and digits only; none for null."""
    low = [t.lower() if isinstance(t, str) else "" for t in texts]
    points = _points("".join(low))
    _LETTERS.meet(points)
    keep = _LETTERS.kept[points]
    ends = np.cumsum([len(t) for t in low])
    cuts = np.concatenate([[0], np.cumsum(keep)])[ends]
    return np.split(points[keep], cuts[:-1]) if len(texts) else []


def normalise(text: str | None) -> str:
    """Lower case, letters and digits only; empty for null."""
    return normalise_all([text])[0].tobytes().decode("utf-32-le")


def _origins(text: str) -> np.ndarray:
    """The place in ``text`` of each normalised character."""
    points = _points(text)
    _LETTERS.meet(points)
    return np.repeat(np.arange(len(points)), _LETTERS.count[points])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of integers by prefix doubling over unsettled groups only; a round
    triples the prefix where three ranks fit into one key."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length()) if n else 1
    per = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(min(per, n)):
        key <<= bits
        key[: n - j] |= s[j:]
    if per > n:
        key <<= bits * (per - n)
    order = np.argsort(key)
    triple = (n + 2) ** 3 < 1 << 63
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots, k, h = np.arange(n), key[order], per
    while True:
        first = np.empty(len(slots), bool)
        if len(slots):
            first[0] = True
            np.not_equal(k[1:], k[:-1], out=first[1:])
        start = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))] if len(slots) else slots
        rank[order[slots]] = start
        alone = first & np.append(first[1:], True)
        slots, start = slots[~alone], start[~alone]
        if not len(slots):
            return order
        which = order[slots]
        k = start * (n + 1) + rank[np.minimum(which + h, n)] + 1
        if triple:
            k = k * (n + 1) + rank[np.minimum(which + 2 * h, n)] + 1
        by = np.argsort(k)
        order[slots], k = which[by], k[by]
        h *= 3 if triple else 2


class WaveletTree:
    """Rank and access over symbols, one bit level after the other."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, (sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(self.n - int(ones.sum()))
            mask = bit.astype(bool)
            symbols = np.concatenate([symbols[~mask], symbols[mask]])
        self.start = self.descend(np.zeros(sigma, np.int64), np.arange(sigma))

    def _rank(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = self.words[level][i >> 6]
        off = (i & 63).astype(np.uint64)
        below = word & ((np.uint64(1) << off) - np.uint64(1))
        return self.counts[level][i >> 6] + np.bitwise_count(below), (word >> off) & np.uint64(1)

    def descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where position i goes along the symbol's bits; less ``start``, its rank."""
        for level in range(self.levels):
            ones, _ = self._rank(level, i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions i, and where these go."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.levels):
            ones, bit = self._rank(level, i)
            symbol = (symbol << 1) | bit.astype(np.int64)
            i = np.where(bit.astype(bool), self.zeros[level] + ones, i - ones)
        return symbol, i


class FMIndex:
    """Index of several texts given as arrays of code points."""

    def __init__(self, texts: list[np.ndarray], sample: int = SAMPLE):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        flat = np.zeros(int((sizes + 1).sum()), np.uint32)
        for t, at in zip(texts, self.starts.tolist()):
            flat[at : at + len(t)] = t
        ends = self.starts + sizes
        letter = np.ones(len(flat), bool)
        letter[ends] = False
        self.alphabet, codes = np.unique(flat[letter], return_inverse=True)
        sigma = len(self.alphabet) + 1
        s = np.zeros(len(flat), np.int64)
        s[letter] = codes + 1
        # ends differ from each other for sorting, so that copies need no long comparison
        apart = s + len(texts)
        apart[ends] = np.arange(len(texts))
        sa = suffix_array(apart)
        self.tree = WaveletTree(s[sa - 1], sigma)
        less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))[:-1]])
        self.step = less - self.tree.start
        place = sa - self.starts[np.searchsorted(self.starts, sa, "right") - 1]
        self.sampled = place % sample == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.n = len(flat)

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; 0 for those the index does not hold."""
        if not len(self.alphabet):
            return np.zeros(points.shape, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of the patterns (rows of symbols) that occur, and which."""
        alive = np.flatnonzero((patterns > 0).all(1))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[alive, j]
            both = self.step[c] + self.tree.descend(np.stack([lo, hi]), c)
            keep = both[0] < both[1]
            alive, lo, hi = alive[keep], both[0][keep], both[1][keep]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.samples[self.sample_at[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol, at = self.tree.access(rows)
            rows, steps = self.step[symbol] + at, steps + 1
        return out


class Windows:
    """The distinct windows of held-out texts, and the items each stands in."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW):
        parts, owners = [], []
        for item, points in items:
            if len(points) >= window:
                parts.append(np.lib.stride_tricks.sliding_window_view(points, window))
                owners.append(np.full(len(points) - window + 1, item, np.int64))
        self.window = window
        if not parts:
            self.points, self.owners, self.bounds = np.zeros((0, window), np.uint32), np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        rows, who = np.concatenate(parts), np.concatenate(owners)
        as_bytes = np.ascontiguousarray(rows).view(f"V{4 * window}").ravel()
        _, first, which = np.unique(as_bytes, return_index=True, return_inverse=True)
        self.points = rows[first]
        pairs = np.unique(np.stack([which, who], 1), axis=0)
        self.owners = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))


def window_blocks(items: list[tuple[int, np.ndarray]], window: int, most: int) -> Iterator[Windows]:
    """All windows of the items, at most ``most`` at a time; a long item is cut into
    overlapping parts."""
    block: list[tuple[int, np.ndarray]] = []
    room = most
    for item, points in items:
        at, n = 0, len(points) - window + 1
        while at < n:
            take = min(room, n - at)
            block.append((item, points[at : at + take + window - 1]))
            at, room = at + take, room - take
            if not room:
                yield Windows(block, window)
                block, room = [], most
    if block:
        yield Windows(block, window)


def _hits(index: FMIndex, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, item, position)`` of every window in every text of the index."""
    which, lo, hi = index.search(index.encode(windows.points))
    sizes = hi - lo
    rows = np.repeat(lo, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, window = index.locate(rows), np.repeat(which, sizes)
    n_items = windows.bounds[window + 1] - windows.bounds[window]
    item = windows.owners[np.repeat(windows.bounds[window], n_items) + np.arange(int(n_items.sum())) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
    at = np.repeat(at, n_items)
    return np.searchsorted(index.starts, at, "right") - 1, item, at


def _shard_hits(shard: list[tuple[int, np.ndarray, int]], blocks: Iterator[Windows], window: int) -> tuple[np.ndarray, ...]:
    """``(document, item, start, end)`` of the merged spans, in normalised offsets; the
    shard is ``(document, piece, offset)``.  One index meets all blocks."""
    index = FMIndex([t for _, t, _ in shard])
    found = [_hits(index, w) for w in blocks]
    doc, item, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    by = np.lexsort((at, item, doc))
    doc, item, at = doc[by], item[by], at[by]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + window)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    key, offset = np.array([k for k, _, _ in shard], np.int64), np.array([o for _, _, o in shard], np.int64)
    base = offset[doc[first]] - index.starts[doc[first]]
    return key[doc[first]], item[first], at[first] + base, at[last] + base + window


def _shards(pieces: Iterator[tuple[int, np.ndarray, int]], most: int) -> Iterator[list]:
    shard, size = [], 0
    for piece in pieces:
        if size + len(piece[1]) > most and shard:
            yield shard
            shard, size = [], 0
        shard.append(piece)
        size += len(piece[1])
    if shard:
        yield shard


def leaked_spans(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW,
    places: bool = True, shard_chars: int = SHARD_CHARS, block_windows: int = BLOCK_WINDOWS, round_chars: int = ROUND_CHARS,
) -> DataFrame:
    """``(doc_key, item_key, span_start, span_end)``: where held-out passages stand.

    A span is a stretch of the document, in code points of the text as it is, all
    of whose windows of ``window`` normalised characters stand in the item; without
    ``places`` both ends are null.  Null, empty and short texts on either side have no
    span; items that occur under two ids are reported under both; repeated documents
    are reported each.  Documents are not shuffled, unless they are too few to fill
    all cores.  The held-out set is the query side: ``round_chars`` characters of it
    at a time are broadcast as they are, and each index of ``shard_chars`` characters
    is built once for them and searched with blocks of ``block_windows`` windows.
    """
    spark = docs.sparkSession
    schema = f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, span_start int, span_end int"

    def searched(part: list[tuple[int, np.ndarray]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys: list = []  # of the documents in the shard at hand
            bodies: list = []

            def pieces() -> Iterator[tuple[int, np.ndarray, int]]:
                for batch in batches:
                    texts = batch.iloc[:, 1].tolist()
                    for key, body, norm in zip(batch.iloc[:, 0].tolist(), texts, normalise_all(texts)):
                        if len(norm) < window:
                            continue
                        keys.append(key)
                        bodies.append(body if places else None)
                        for at in range(0, len(norm) - window + 1, shard_chars - window + 1):
                            yield len(keys) - 1, norm[at : at + shard_chars], at

            few = sum(len(p) for _, p in shared.value) <= block_windows
            kept = list(window_blocks(shared.value, window, block_windows)) if few else None
            for shard in _shards(pieces(), shard_chars):
                doc, item, a, b = _shard_hits(shard, iter(kept) if few else window_blocks(shared.value, window, block_windows), window)
                if places:
                    for d in np.unique(doc).tolist():
                        origin, mine = _origins(bodies[d]), doc == d
                        a[mine], b[mine] = origin[a[mine]], origin[b[mine] - 1] + 1
                ends = {"span_start": a, "span_end": b} if places else {"span_start": None, "span_end": None}
                yield pd.DataFrame({doc_key: [keys[d] for d in doc.tolist()], item_key: item, **ends}, columns=[doc_key, item_key, "span_start", "span_end"])
                for k in range(shard[-1][0]):  # a later shard may hold the rest of the last one
                    bodies[k] = None

        return spread(docs.select(doc_key, text), doc_key).mapInPandas(run, schema)

    rounds: list[list] = [[]]
    size = 0
    for r in items.select(item_key, text).where(f"`{item_key}` is not null").toLocalIterator():
        norm = normalise_all([r[1]])[0]
        if size + len(norm) > round_chars and rounds[-1]:
            rounds.append([])
            size = 0
        rounds[-1].append((r[0], norm))
        size += len(norm)
    out = searched(rounds[0])
    for part in rounds[1:]:
        out = out.unionByName(searched(part))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` pairs of :func:`leaked_spans`."""
    spans = leaked_spans(docs, items, places=False, **options)
    return spans.select(*spans.columns[:2]).distinct()
